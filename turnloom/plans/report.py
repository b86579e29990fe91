"""Traffic report over request-log records: totals, coverage and the UTC timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.stats import STATS_SQL
from turnloom.sources.tables import views


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    return spark.sql(STATS_SQL.replace("VARCHAR(32)", "STRING"))


def failed() -> F.Column:
    return (F.col("client_status") >= 400) | F.col("upstream_incomplete") | ((F.col("n_attempts") > 0) & (F.col("last_status") != 200))


def eligible() -> F.Column:
    """Records whose volumes count for the reduction."""
    return (
        (F.col("n_attempts") > 0)
        & ~F.col("shadow")
        & ~F.col("action").isin("impossible", "guard_reject")
        & F.col("tokens_in").isNotNull()
        & F.col("tokens_out").isNotNull()
    )


def _measures() -> list[F.Column]:
    long = lambda c: c.cast("long")
    given = F.sum(F.when(eligible(), F.col("tokens_in")))
    sent = F.sum(F.when(eligible(), F.col("tokens_out")))
    return [
        long(F.count(F.lit(1))).alias("requests"),
        long(F.count_if("compacted")).alias("compactions"),
        long(F.sum(F.greatest(F.col("n_attempts") - 1, F.lit(0)))).alias("retries"),
        long(F.count_if(failed())).alias("failures"),
        long(F.coalesce(F.sum("tokens_in"), F.lit(0))).alias("tokens_in"),
        long(F.coalesce(F.sum("tokens_out"), F.lit(0))).alias("tokens_out"),
        F.try_divide(100.0 * (given - sent), given).cast("double").alias("reduction_percent"),
    ]


_SQL_MEASURES = """
CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE compacted) AS BIGINT) AS compactions,
CAST(sum(greatest(n_attempts - 1, 0)) AS BIGINT) AS retries,
CAST(count(*) FILTER (WHERE client_status >= 400 OR upstream_incomplete OR (n_attempts > 0 AND last_status <> 200)) AS BIGINT) AS failures,
CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out,
CAST(100.0 * CAST(sum(tokens_in - tokens_out) FILTER (WHERE ok) AS DOUBLE) / nullif(CAST(sum(tokens_in) FILTER (WHERE ok) AS DOUBLE), 0) AS DOUBLE) AS reduction_percent
"""
_SQL_FROM = f"""
FROM (SELECT *, n_attempts > 0 AND NOT shadow AND action NOT IN ('impossible', 'guard_reject') AND tokens_in IS NOT NULL AND tokens_out IS NOT NULL AS ok
      FROM ({STATS_SQL}))
"""


def timeline(records: DataFrame, unit: str) -> DataFrame:
    return records.groupBy(F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz").alias("bucket")).agg(*_measures())


def timeline_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(stats(spark, sf_dir), "day")


def timeline_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(stats(spark, sf_dir), "hour")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).agg(*_measures())


QUERIES = {"st01_timeline_day": timeline_day, "st01_timeline_hour": timeline_hour, "a01_report_totals": totals}
SQL = {
    "st01_timeline_day": f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, {_SQL_MEASURES} {_SQL_FROM} GROUP BY 1",
    "st01_timeline_hour": f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, {_SQL_MEASURES} {_SQL_FROM} GROUP BY 1",
    "a01_report_totals": f"SELECT {_SQL_MEASURES} {_SQL_FROM}",
}
