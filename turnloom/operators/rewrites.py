"""Rewrites of single results, and walks over a session that have no set form."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators import sessions

HEAD_SHARE, TRIES, CHARS = 0.8, 6, 4
#: Roles that stay in a slimmed snapshot.
INTERACTIVE = ("button", "link", "textbox", "checkbox", "combobox", "radio", "tab", "menuitem")


def tokens(text: str) -> int:
    return -(-len(text) // CHARS)


def truncated(text: str, room: int) -> str:
    """Head and tail within room tokens, cut at line ends near by, and a marker with the counts of what is left out.

    The marker's own cost depends on what it says, so the share is corrected a few times; if nothing fits, the marker
    stands alone.
    """
    if tokens(text) <= room:
        return text
    chars = room * CHARS
    for _ in range(TRIES):
        head, tail = int(chars * HEAD_SHARE), chars - int(chars * HEAD_SHARE)
        a, z = text[:head], text[len(text) - tail :] if tail > 0 else ""
        if "\n" in a[-(head // 4) or len(a) :]:
            a = a[: a.rindex("\n") + 1]
        if "\n" in z[: tail // 4]:
            z = z[z.index("\n") + 1 :]
        left = len(text) - len(a) - len(z)
        out = f"{a}[{left} characters, {text.count(chr(10), len(a), len(text) - len(z))} lines left out]\n{z}"
        if tokens(out) <= room:
            return out
        chars -= (tokens(out) - room) * CHARS
        if chars <= 0:
            break
    return f"[{len(text)} characters left out]"


def slimmed(text: str, room: int) -> str:
    """The lines of a page snapshot that fit: its header, then interactive elements, then the rest in order."""
    if tokens(text) <= room:
        return text
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if x.startswith("- Page Snapshot:")), -1) + 1
    rank = [0 if i < at else 1 if re.match(rf"\s*- (?:{'|'.join(INTERACTIVE)})\b", x) else 2 for i, x in enumerate(lines)]
    kept, used = set(), 12 * CHARS
    for i in sorted(range(len(lines)), key=lambda i: (rank[i], i)):
        if rank[i] and used + len(lines[i]) + 1 > room * CHARS:
            continue
        kept.add(i)
        used += len(lines[i]) + 1
    return "\n".join(lines[i] for i in sorted(kept)) + f"\n[{len(lines) - len(kept)} lines left out]"


def _by_text(rewrite: Callable[[str, int], str], text: Column, room: int) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([rewrite(t or "", room) for t in texts])

    return F.pandas_udf(run, "string")(text)


def truncate(text: Column, room: int) -> Column:
    return _by_text(truncated, text, room)


def slim(text: Column, room: int) -> Column:
    return _by_text(slimmed, text, room)


def tabs(events: list[tuple[str, str]]) -> tuple[list[str], int]:
    """Open tabs and the current one after navigate(url), new(url), select(i), close(i) and list(json of urls)."""
    urls, now = ["about:blank"], 0
    for kind, value in events:
        if kind == "navigate":
            urls[now] = value
        elif kind == "new":
            urls.append(value)
            now = len(urls) - 1
        elif kind == "select" and int(value) < len(urls):
            now = int(value)
        elif kind == "close" and int(value) < len(urls):
            i = int(value)
            del urls[i]
            urls = urls or ["about:blank"]
            now = min(now - (i < now), len(urls) - 1) if now else 0
        elif kind == "list":
            urls = json.loads(value) or ["about:blank"]
            now = min(now, len(urls) - 1)
    return urls, now


def tab_states(events: DataFrame) -> DataFrame:
    """session_id, tabs, current from events(session_id, n, kind, value)."""

    def fold(session: int, rows: list[tuple]) -> list[tuple]:
        urls, now = tabs([r[1:] for r in rows])
        return [(session, len(urls), urls[now])]

    return sessions.walk(events, ["kind", "value"], fold, "session_id long, tabs long, current string", "n")


def pair_unit(calls: list[str], results: list[str | None]) -> list[int | None]:
    """The call that each result of a unit answers: the first unused one with its id, else the first unused one."""
    used: set[int] = set()
    out: list[int | None] = []
    for r in results:
        free = [i for i in range(len(calls)) if i not in used]
        hit = next((i for i in free if calls[i] == r), free[0] if free else None)
        out.append(hit)
        if hit is not None:
            used.add(hit)
    return out


def unit_pairs(log: DataFrame) -> DataFrame:
    """session_id, idx (of the result), call_idx, pos by pair_unit, unit by unit."""

    def fold(session: int, rows: list[tuple]) -> list[tuple]:
        out, unit, calls, results = [], None, [], []

        def close() -> None:
            for (idx, _), pos in zip(results, pair_unit(calls, [r for _, r in results]), strict=True):
                out.append((session, idx, unit if pos is not None else None, pos))

        for idx, role, a, b in rows:
            if role == "tool" and unit is not None:
                results.append((idx, a))
            elif role != "tool":
                close()
                unit, calls, results = (idx, [x for x in (a, b) if x], []) if role == "assistant" else (None, [], [])
        close()
        return out

    return sessions.walk(log, ["role", "call_id", "call_id2"], fold, "session_id long, idx int, call_idx long, pos long")


def client_compaction(log: DataFrame, limit: int, reply: int) -> DataFrame:
    """What a client that compacts by itself would send: per session the requests, rejections, summaries and tokens.

    Each assistant message is preceded by a request with all that came before. A request over the limit is rejected; the
    client then keeps the newest units within a quarter of the usable room (2,000 to 15,000 tokens) behind a summary.
    """
    usable = limit - reply
    preserve = min(15000, max(min(2000, usable // 2), usable // 4))

    def fold(session: int, rows: list[tuple]) -> list[tuple]:
        main = rejected = summaries = requests = 0
        sent: list[int] = []
        whole = 0
        for _, role, size in rows:
            if role == "assistant":
                requests += 1
                if whole + reply > limit:
                    rejected += whole
                    summaries += 1
                    at, tail = len(sent), 0
                    while at and tail + sent[at - 1] <= preserve:
                        at -= 1
                        tail += sent[at]
                    sent = [min(1500, 50 + (whole - tail) // 10), *sent[at:]]
                    whole = sent[0] + tail
                main += whole
            sent.append(size)
            whole += size
        return [(session, requests, main, rejected, summaries)]

    return sessions.walk(log, ["role", "tokens"], fold, "session_id long, requests long, main long, rejected long, summaries long")
