"""Personal data: fixed patterns, and spans that a character-level BiLSTM-CRF adds.

Patterns are searched in whole texts, from the left, by kind. Each is written so that its search is linear: a match can
only start where a run of its characters starts, and runs are never tried again from their middle. Matches that fail
their check (parts of an address over 255, number of digits, Luhn) are dropped.

The tagger reads the whole of every text in overlapping windows. Windows are decoded one by one and reconciled over the
whole text: each character takes the tag of the window in whose middle it stands, and spans are read from the joined tags.
Besides the kinds of the patterns the tagger knows credentials (kind ``secret``), which no pattern looks for. A tagged span
that touches a pattern's span adds nothing, nor does one of a pattern's kind that touches a dropped match, as the pattern has
judged that place (a run of digits within a credential is no such judgement); the others are added if they have MINIMUM characters, and card numbers if their digits are 14 to 19 and pass Luhn, as the kind says.

Counts by kind are of the patterns' spans; n_secret and n_added count the tagger's.

Edge cases: null and empty texts have no spans; very long texts are read whole, their windows in batches of fixed size;
spans that touch go by start, kind and end; repeated rows are judged each; null doc_ids are kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .tagger import DIGITS, KINDS, PAD, STRIDE, WINDOW, codes, decode, trained
from .tokens import text_batches

MINIMUM, BATCH = 7, 2048
#: Bytes of text whose windows are decoded together.
SLICE = 4 << 20
#: Texts whose spans a task remembers, by digest.
REMEMBERED = 8192
#: What the patterns must equal (fixed values): local part, domain, address, card, telephone number.
LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = KINDS[:4]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign with the run of local characters before it; a run is read once, as it ends at its at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", end)


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _number(s: str) -> int:
    """The value of a run of digits, 999 for any above three digits but leading zeros."""
    s = s.lstrip("0")
    return int(s or "0") if len(s) <= 3 else 999


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Valid matches by kind, and all matches of any pattern."""
    kept: list[tuple[str, int, int]] = []
    seen: list[tuple[int, int]] = []
    if "@" in text:
        kept += [("email", a, z) for a, z in _emails(text)]
        seen += [(a, z) for _, a, z in kept]
    for m in IP.finditer(text):
        seen.append(m.span())
        if all(_number(p) <= 255 for p in m.groups()):
            kept.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 64 else ""
        if len(digits) >= 8 or not digits:
            seen.append(m.span())
        if 14 <= len(digits) <= 19 and luhn(digits):
            kept.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        seen.append(m.span())
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            kept.append(("phone", *m.span()))
    return kept, seen


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows, which cover the whole text, and the codes of all of them."""
    c = codes(text)
    starts = np.arange(0, max(1, len(c) - (WINDOW - STRIDE) // 2), STRIDE) if len(c) else np.zeros(0, np.int64)
    padded = np.concatenate([c, np.full(WINDOW, PAD, np.uint8)])
    return starts, padded[starts[:, None] + np.arange(WINDOW)] if len(starts) else np.zeros((0, WINDOW), np.uint8)


def reconciled(length: int, starts: np.ndarray, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a text from its windows' tags; each character belongs to the window in whose middle it stands."""
    if not tags.any():
        return []
    whole = np.zeros(int(starts[-1]) + WINDOW, np.int64)
    margin = (WINDOW - STRIDE) // 2
    for s, row in zip(starts.tolist(), tags, strict=True):
        # the first window has no other before it; what a window says of its end, the next one says again
        a = margin if s else 0
        whole[s + a : s + WINDOW] = row[a:]
    out, inked = [], np.flatnonzero(whole)
    i = 0
    while i < len(inked):
        a = int(inked[i])
        kind = (whole[a] - 1) // 2
        z = a + 1
        while z < len(whole) and whole[z] == 2 + 2 * kind:
            z += 1
        if whole[a] % 2 and z <= length:
            out.append((KINDS[kind], a, z))
        i += max(1, z - a)
    return out


def tagged(texts: list[str], model: dict[str, np.ndarray]) -> Iterator[list[tuple[str, int, int]]]:
    """The tagger's spans of each text; windows of many texts are decoded together, and a long text's in several batches."""
    cuts = [windows(t) for t in texts]
    x = np.concatenate([w for _, w in cuts]) if cuts else np.zeros((0, WINDOW), np.uint8)
    # windows of like length together: what is padding in all of a batch is not read
    size = (x != PAD).sum(1)
    order = np.argsort(size, kind="stable")
    tags = np.zeros(x.shape, np.int8)
    for s in range(0, len(x), BATCH):
        at = order[s : s + BATCH]
        used = max(1, int(size[at[-1]]))
        tags[at, :used] = decode(model, x[at, :used])
    at = 0
    for text, (starts, _) in zip(texts, cuts, strict=True):
        yield reconciled(len(text), starts, tags[at : at + len(starts)])
        at += len(starts)


def added(text: str, spans: list[tuple[str, int, int]], kept: list[tuple[int, int]], seen: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Tagged spans, in order, clear of the patterns' spans and, for kinds of the patterns, of all their matches; one sweep for each."""
    secrets = _clear(text, [s for s in spans if s[0] == "secret"], kept)
    return sorted(secrets + _clear(text, [s for s in spans if s[0] != "secret"], seen), key=lambda s: s[1])


def _clear(text: str, spans: list[tuple[str, int, int]], seen: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The spans, trimmed to letters and digits, that touch none of seen."""
    out, seen, i = [], merged(seen), 0
    for kind, a, z in spans:
        while z > a and not text[z - 1].isalnum() and not (kind == "secret" and text[z - 1] == "="):
            z -= 1
        while i < len(seen) and seen[i][1] <= a:
            i += 1
        if z - a < MINIMUM or (i < len(seen) and seen[i][0] < z):
            continue
        digits = "".join(c for c in text[a:z] if c in DIGITS)
        if kind != "card" or (14 <= len(digits) <= 19 and luhn(digits)):
            out.append((kind, a, z))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same characters."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def judged(text: str, spans: list[tuple[str, int, int]]) -> tuple:
    """The columns of SCHEMA behind doc_id, from the text and the tagger's spans."""
    kept, seen = base_spans(text)
    more = added(text, spans, [s[1:] for s in kept], seen)
    n = [sum(s[0] == k for s in kept) for k in BASE]
    return (*n, sha256(joined(kept).encode()).hexdigest(), joined(kept + more), sum(s[0] == "secret" for s in more), len(more))


def find(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text), as SCHEMA says."""
    model = model or trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in text_batches(batches, SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            # equal texts have equal spans: each is read once, as long as the task remembers it
            if len(known) > REMEMBERED:
                known.clear()
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
            for (key, text), spans in zip(new.items(), tagged(list(new.values()), model), strict=True):
                known[key] = judged(text, spans)
            out = [(doc_id, *known[key]) for doc_id, key in zip(batch.column("doc_id").to_pylist(), keys, strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
