"""Streaming forms of the timeline, the calibration and the session fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.operators import planner


def timeline(records: DataFrame, unit: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Requests and compactions by tumbling UTC bucket, over a stream with ts and compacted.

    The batch report keeps the newest 2,000 buckets whatever their age; a watermark drops by delay instead.
    """
    w = records.withWatermark("ts", late).groupBy(F.window("ts", unit))
    return w.agg(F.count(F.lit(1)).alias("requests"), F.count_if("compacted").alias("compactions")).select(F.col("window.start").alias("bucket"), "requests", "compactions")


def session_plans(messages: DataFrame, window: int, reply: int) -> DataFrame:
    """planner.OUT for a stream of messages(session_id, idx, role, tokens, snapshot), the plan as state.

    Messages of a session come in order from one micro-batch to the next. A boundary is stepped when the assistant's
    message behind it comes; a session that ends is not closed, as more may follow.
    """
    limits = planner.Limits.of(window, reply)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plan = planner.Plan.load(state.get[0]) if state.exists else planner.Plan()
        new = pd.concat(list(batches)).sort_values("idx")
        rows = planner.advance(plan, list(zip(new["idx"].tolist(), new["role"], new["tokens"].tolist(), new["snapshot"].tolist(), strict=True)), limits, False)
        state.update((plan.dump(),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in planner.OUT.split(", ")])

    return messages.groupBy("session_id").applyInPandasWithState(run, planner.OUT, "plan string", "append", GroupStateTimeout.NoTimeout)


#: Ratios kept, least samples, largest correction, the change that counts.
RATIOS, SAMPLES, CAP, QUANTA = 64, 5, 2.5, 0.02


def corrected(ratios: list[float], now: float) -> float:
    """The correction after the last RATIOS ratios: their nearest-rank 90th percentile, up only, in steps that count."""
    best = sorted(ratios)[-(-9 * len(ratios) // 10) - 1]
    new = max(now, min(CAP, max(1.0, -(-round(best * 100, 7) // 1) / 100)))
    return new if abs(new - now) >= QUANTA - 1e-9 else now


def calibration(samples: DataFrame) -> DataFrame:
    """key, samples, correction over a stream of accepted samples(key, seq, ratio)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratios, n, now = state.get if state.exists else ([], 0, 1.0)
        ratios = list(ratios)
        for r in pd.concat(list(batches)).sort_values("seq")["ratio"].tolist():
            ratios, n = [*ratios, r][-RATIOS:], n + 1
            now = corrected(ratios, now) if n >= SAMPLES else now
        state.update((ratios, n, now))
        yield pd.DataFrame({"key": [key[0]], "samples": [n], "correction": [now]})

    return samples.groupBy("key").applyInPandasWithState(run, "key long, samples long, correction double", "ratios array<double>, n long, now double", "update", GroupStateTimeout.NoTimeout)


def calibration_batch(samples: DataFrame) -> DataFrame:
    """The same over a table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ratios, now = pdf.sort_values("seq")["ratio"].tolist(), 1.0
        for n in range(SAMPLES, len(ratios) + 1):
            now = corrected(ratios[max(0, n - RATIOS) : n], now)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "samples": [len(ratios)], "correction": [now]})

    return samples.groupBy("key").applyInPandas(run, "key long, samples long, correction double")
