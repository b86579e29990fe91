"""Queries whose steps depend on one another: supersession, session plans, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import tokens
from turnloom.operators import planner, rewrites, supersede
from turnloom.plans.metrics import upstream
from turnloom.sources.transcript import WITH_TRANSCRIPT, log, transcript
from turnloom.streaming import calibration_batch


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (tokens.estimate(F.col("content")) + tokens.MESSAGE_OVERHEAD).alias("tokens")
    return log(spark, sf_dir, "role", "content").select("session_id", "idx", "role", size, F.coalesce(F.col("content").contains("- Page Snapshot:"), F.lit(False)).alias("snapshot"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small window, so that the sessions at hand outgrow it."""
    return planner.fold(sized(spark, sf_dir), 1050, 300)


def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans(spark, sf_dir).groupBy("action", "rungs").agg(F.count(F.lit(1)).alias("boundaries"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of actions of a replay, with the requests whose second plan differs."""
    r = planner.replay(sized(spark, sf_dir), 1050, 300)
    return r.groupBy("action").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if(~F.col("same")).alias("mismatches"))


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supersede.superseded(log(spark, sf_dir, "role", "content", role="user"))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = upstream(spark, sf_dir).where("status = 200")
    return calibration_batch(good.select(F.col("session_id").alias("key"), "seq", (F.col("prompt") * 2 / F.col("bytes")).alias("ratio")))


def tab_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser events: a snapshot navigates, other tools open, select or close tabs by their part."""
    results = log(spark, sf_dir, "role", "content", "tool_name").where("role = 'tool'")
    kind = F.when(F.col("tool_name") == "browser_snapshot", "navigate").when(F.col("idx") % 4 == 0, "new").when(F.col("idx") % 4 == 2, "select").otherwise("close")
    value = F.when(kind.isin("navigate", "new"), F.regexp_extract("content", r"(https?://\S+|^\S+)", 1)).otherwise((F.col("idx") % 3).cast("string"))
    return rewrites.tab_states(results.select("session_id", F.col("idx").alias("n"), kind.alias("kind"), value.alias("value")))


def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = transcript(spark, sf_dir).where("role = 'tool'")
    return results.select("session_id", "idx", rewrites.truncate(F.col("content"), 25).alias("truncated"))


def slimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = transcript(spark, sf_dir).where("tool_name = 'browser_snapshot' and role = 'tool'")
    return shots.select("session_id", "idx", rewrites.slim(F.col("content"), 60).alias("slimmed"))


QUERIES = {
    "w10_tab_states": tab_states,
    "f19_truncated": truncations,
    "x11_slimmed": slimmed,
    "j02_unit_pairs": lambda spark, sf_dir: rewrites.unit_pairs(log(spark, sf_dir, "role", "call_id", "call_id2")),
    "st15_client_compaction": lambda spark, sf_dir: rewrites.client_compaction(sized(spark, sf_dir), 900, 300),
    "st03_session_plans": plans, "a11_plan_actions": plan_actions, "x19_superseded": replaced, "st07_calibration": calibrated,
}
#: In the derived log a session's correction names its order, which only the first sentence of the task names too.
SQL: dict[str, str] = {
    "x19_superseded": f"""{WITH_TRANSCRIPT} SELECT session_id, CAST(0 AS INTEGER) AS idx, CAST(0 AS INTEGER) AS sentence, max(idx) AS by_idx, 'id' AS rule FROM transcript WHERE role = 'user' GROUP BY session_id HAVING count(*) > 1""",
}
