"""What refused requests teach about a server: limits that only tighten, kept by server and model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.hashing import is_prefix

#: Largest share of the budget that tightening may take, changes kept, share of a refused body that is safe.
MOST_TIGHTEN, LOG, SAFE_BYTES, CAP, DAY = 0.5, 32, 0.9, 1.05, 24 * 3600 * 1000
LEARNED = "key string, n long, window long, max_prompt long, max_bytes long, correction double, tighten long, changes long"


def strictly_smaller(raw: Column, reply: Column, size: Column, raw0: Column, reply0: Column, size0: Column, too_large: Column) -> Column:
    """A next attempt is smaller than the one before in tokens (or in the reply), and no larger in bytes; smaller in bytes after a refusal for size."""
    return ((raw < raw0) | ((raw == raw0) & (reply < reply0))) & F.when(too_large, size < size0).otherwise(size <= size0)


def within_original(raw: Column, size: Column, raw0: Column, size0: Column) -> Column:
    return (raw <= raw0) & (size <= size0)


def retry_reply(window: Column, margin: Column, tighten: Column, counted: Column) -> Column:
    """The reply that fits behind a prompt after max_tokens was refused."""
    return window - margin - tighten - counted


def body_limit(size: Column) -> Column:
    return F.floor(size * SAFE_BYTES + 1e-9).cast("long")


def tightened(now: int, budget: int, raw: int) -> int:
    """After a refusal that names no number: what the budget exceeds 95% of the count by, in steps of 256, never down, capped."""
    most = int(budget * MOST_TIGHTEN + 1e-9)
    return max(0, min(most, max(now, -(-(budget - raw * 95 // 100) // 256) * 256)))


def learn(entry: dict, kind: str, raw: int, size: int, window: int | None, max_prompt: int | None, prompt: int | None, budget: int) -> dict:
    """The entry after one refusal; the same object if it teaches nothing."""
    new = dict(entry)
    if kind == "payload_too_large":
        limit = size * 9 // 10
        new["max_bytes"] = limit if entry["max_bytes"] is None else min(entry["max_bytes"], limit)
        return entry if new == entry else new
    if window is not None:
        new["window"] = window if entry["window"] is None else min(entry["window"], window)
    if max_prompt is not None:
        new["max_prompt"] = max_prompt if entry["max_prompt"] is None else min(entry["max_prompt"], max_prompt)
    if prompt is not None and raw > 0:
        new["correction"] = max(entry["correction"], min(CAP, -(-prompt * 100 // raw) / 100))
    if window is None and max_prompt is None and kind != "max_tokens_too_large":
        new["tighten"] = tightened(entry["tighten"], budget, raw)
    return entry if new == entry else new


def learned(refusals: DataFrame, budget: int) -> DataFrame:
    """LEARNED after the last of refusals(key, seq, kind, raw, bytes, window, max_prompt, prompt) of each key."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, changes = {"window": None, "max_prompt": None, "max_bytes": None, "correction": 1.0, "tighten": 0}, 0
        whole = lambda x: None if pd.isna(x) else int(x)
        for r in pdf.sort_values("seq").itertuples(index=False):
            new = learn(entry, r.kind, int(r.raw), int(r.bytes), whole(r.window), whole(r.max_prompt), whole(r.prompt), budget)
            entry, changes = new, changes + (new is not entry)
        return pd.DataFrame([(pdf["key"].iloc[0], len(pdf), entry["window"], entry["max_prompt"], entry["max_bytes"], entry["correction"], entry["tighten"], changes)], columns=[c.split()[0] for c in LEARNED.split(", ")])

    return refusals.groupBy("key").applyInPandas(fold, LEARNED)


def client_compactions(requests: DataFrame, marker: str, trigger: int) -> DataFrame:
    """Requests(session_id, step, last_user, prompt) by which a client compacts: its last message is the marker. early says that the prompt before was below the trigger."""
    before = F.lag("prompt").over(Window.partitionBy("session_id").orderBy("step"))
    return requests.withColumn("before", before).where(F.trim("last_user") == marker).select("session_id", "step", "before", F.coalesce(F.col("before") < trigger, F.lit(False)).alias("early"))


def replan(client_before: Column, inputs_before: Column, client: Column, inputs: Column) -> Column:
    """Why a step was planned anew, from the messages (digests or places) and inputs of this request and the one before."""
    return F.when(client_before.isNull(), "new_session").when(~inputs_before.eqNullSafe(inputs), "inputs_changed").when(~is_prefix(client_before, client), "client_mutation").otherwise("none")
