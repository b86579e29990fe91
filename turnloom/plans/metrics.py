"""Metrics over upstream attempts: steps, retries, rewrites, prefixes, timings, gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from turnloom.sources.requests import UPSTREAM_SQL
from turnloom.sources.store import written
from turnloom.sources.tables import views


#: Fixed value: buckets that a timeline keeps.
BUCKETS = 2000


def by_step() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("step")



def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        views(spark, sf_dir, "orders", "lineitem")
        return spark.sql(UPSTREAM_SQL)

    return written(spark, "upstream", sf_dir, make)


def steps(u: DataFrame) -> DataFrame:
    """One row per session and step: its last attempt, and the last accepted prompt before it."""
    per = u.groupBy("session_id", "step").agg(
        F.max_by("status", "attempt").cast("long").alias("status"),
        F.max_by("prompt", "attempt").alias("prompt"),
        F.max_by("lcp", "attempt").alias("lcp"),
        F.max_by("completion", "attempt").alias("completion"),
        F.first("kind").alias("kind"),
        F.count(F.lit(1)).alias("attempts"),
    )
    accepted = F.when(F.col("status") == 200, F.col("prompt"))
    return per.withColumn("before", F.last(accepted, ignorenulls=True).over(by_step().rowsBetween(Window.unboundedPreceding, -1)))


def basics(u: DataFrame) -> DataFrame:
    ok = F.col("status") == 200
    s = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).cast("long")
    return u.groupBy("kind").agg(
        F.count_if(ok).cast("long").alias("accepted"), F.count_if(~ok).cast("long").alias("rejected"), s(ok, "prompt").alias("prompt_accepted"), s(~ok, "prompt").alias("prompt_rejected"),
        s(ok, "completion").alias("completion"), F.max("prompt").alias("peak"),
    )


def rewrites(u: DataFrame) -> DataFrame:
    """Steps whose prompt shrank against the last accepted one, and runs of such steps back to back."""
    s = steps(u).where("before is not null and prompt < before").withColumn("prev", F.lag("step").over(by_step()))
    s = s.withColumn("island", F.sum((~F.col("prev").eqNullSafe(F.col("step") - 1)).cast("int")).over(by_step()))
    return s.groupBy("session_id", "island").agg(F.min("step").alias("first"), F.count(F.lit(1)).alias("length")).select("session_id", F.col("island").cast("long").alias("island"), "first", "length")


def retries(u: DataFrame) -> DataFrame:
    """Steps that recovered, attempts that did not shrink, most attempts of a step."""
    w = Window.partitionBy("session_id", "step").orderBy("attempt")
    a = u.withColumn("prev", F.lag("prompt").over(w))
    per = a.groupBy("session_id", "step").agg(F.max_by("status", "attempt").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("prompt") >= F.col("prev")).alias("grown"))
    return per.groupBy("session_id").agg(F.count_if((F.col("last") == 200) & (F.col("n") > 1)).cast("long").alias("recoveries"), F.sum("grown").cast("long").alias("violations"), F.max("n").alias("most"))


def distribution(values: Column) -> list[Column]:
    """Nearest-rank percentiles, maximum and mean, each to one decimal."""
    p = lambda q: F.round(F.expr(f"percentile_disc({q}) within group (order by cast(v as double))"), 1)
    return [F.count("v").alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("v").cast("double").alias("max"), F.round(F.avg("v"), 1).alias("mean")]


def timing(u: DataFrame) -> DataFrame:
    return u.withColumn("v", F.col("ms")).groupBy("kind").agg(*distribution(F.col("v")))


def errors(u: DataFrame) -> DataFrame:
    kind = F.when(F.col("status") == 429, "rate_limited").when(F.col("status") >= 500, "server_error").when(F.col("status") >= 400, "overflow").when(F.col("completion") < 25, "length_no_tool").otherwise("ok")
    return u.groupBy(kind.alias("error"), "kind").agg(F.count(F.lit(1)).alias("n"))


def headroom(u: DataFrame) -> DataFrame:
    """The attempt of each session with most prompt and completion together, against 8,000 usable tokens."""
    total = F.col("prompt") + F.col("completion")
    return u.groupBy("session_id").agg((F.max(total) - 8000).alias("headroom"), F.max_by("seq", F.struct(total, "seq")).alias("seq"))


def histogram(u: DataFrame) -> DataFrame:
    return u.groupBy(F.col("status").cast("long").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2(F.col("session_id").cast("string"), 256)).alias("sessions"))


def wilson(u: DataFrame) -> DataFrame:
    """Share of good steps by kind with its 95% score interval."""
    z = 1.96
    g = steps(u).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 200).cast("long").alias("passes"))
    p, n = F.col("passes") / F.col("n"), F.col("n")
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return g.select("kind", "n", "passes", F.round(F.greatest(F.lit(0.0), centre - half), 9).alias("low"), F.round(F.least(F.lit(1.0), centre + half), 9).alias("high"))


def ring(u: DataFrame) -> DataFrame:
    """Percentiles of the newest 64 attempts of each kind."""
    newest = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("seq"), F.desc("session_id")))
    # the newest 64 of each task first, so that no task sorts a whole kind
    per = Window.partitionBy("kind", F.pmod("session_id", F.lit(256))).orderBy(F.desc("seq"), F.desc("session_id"))
    top = u.withColumn("r", F.row_number().over(per)).where("r <= 64").withColumn("r", newest).where("r <= 64").withColumn("v", F.col("ms"))
    return top.groupBy("kind").agg(*distribution(F.col("v")))


def running_p90(u: DataFrame) -> DataFrame:
    """Nearest-rank 90th percentile and mean over the last 64 accepted attempts of each session."""
    w = Window.partitionBy("session_id").orderBy("seq")
    good = u.where("status = 200")
    last = F.array_sort(F.collect_list("ms").over(w.rowsBetween(-63, 0)))
    return good.select("session_id", "seq", F.element_at(last, F.ceil(F.size(last) * 0.9).cast("int")).alias("p90"), F.round(F.avg("ms").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("mean"))


def chunk_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between events of a user: worst and 99th percentile in seconds."""
    views(spark, sf_dir, "events")
    e = spark.table("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    g = e.withColumn("gap", gap).where("gap is not null")
    return g.groupBy("user_id").agg(F.max("gap").alias("worst"), F.expr("cast(percentile_disc(0.99) within group (order by gap) as bigint)").alias("p99"))


def lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays between any two events of a day: their 99th percentile in microseconds, and how many stall (an hour and more)."""
    views(spark, sf_dir, "events")
    e = spark.table("events").select(F.to_date("ts").cast("string").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    g = e.withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("day").orderBy("us", "event_id"))).where("gap is not null")
    return g.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.expr("cast(percentile_disc(0.99) within group (order by gap) as bigint)").alias("p99"), F.count_if(F.col("gap") >= 3_600_000_000).alias("stalls"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's spans (each event lasts ten minutes) that overlap.

    A span belongs to the slots of ten minutes that it touches; spans meet in an equi-join on user and slot, and a pair
    counts in the slot where the later one starts.
    """
    views(spark, sf_dir, "events")
    width = 600 * 1_000_000
    e = spark.table("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    e = e.withColumn("slot", F.floor(F.col("start") / width))
    first = e.select("user_id", F.col("event_id").alias("a"), F.col("start").alias("a_start"), F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    pairs = first.join(e, ["user_id", "slot"]).where(f"(a_start < start or (a_start = start and a < event_id)) and start < a_start + {width}")
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


def distinct_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user had two or more distinct types within the last 24 hours."""
    views(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    e = spark.table("events").select("event_id", F.size(F.collect_set("event_type").over(w)).cast("long").alias("types"))
    return e.where("types >= 2")


def newest_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 newest hours with their requests, and how many requests older hours held."""
    views(spark, sf_dir, "events")
    h = spark.table("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    r = h.withColumn("r", F.row_number().over(Window.orderBy(F.desc("bucket"))))
    dropped = F.sum(F.when(F.col("r") > BUCKETS, F.col("n")).otherwise(0)).over(Window.partitionBy())
    return r.withColumn("dropped", dropped.cast("long")).where(F.col("r") <= BUCKETS).select("bucket", "n", "dropped")


def judged(u: DataFrame) -> DataFrame:
    """Calibration samples: reported against counted tokens, judged by completeness, size and band."""
    counted, reported = F.col("bytes"), F.col("prompt") * 2
    verdict = (
        F.when(F.col("status") != 200, "filtered: incomplete")
        .when(counted < F.greatest(F.lit(4000), 0.1 * F.lit(61000)), "filtered: too small")
        .when((reported / counted < 0.5) | (reported / counted > 2.5), "mismatch")
        .otherwise("accepted")
    )
    return u.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def _on(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(upstream(spark, sf_dir))


QUERIES = {
    "a13_basics": _on(basics), "a15_back_to_back": _on(rewrites), "a16_retries": _on(retries), "a21_timing": _on(timing), "a24_client_errors": _on(errors),
    "a23_headroom": _on(headroom), "a06_status_histogram": _on(histogram), "a22_wilson": _on(wilson), "w15_ring_percentiles": _on(ring), "w16_running_p90": _on(running_p90),
    "a28_chunk_gaps": chunk_gaps, "a35_event_lag": lag, "j13_interval_overlap": overlaps, "w23_distinct_24h": distinct_days, "t05_newest_buckets": newest_buckets, "m12_judge_samples": _on(judged),
    "j10_step_views": _on(lambda u: steps(u).select("session_id", "step", "status", "prompt", "before", "attempts")),
}

_U = f"WITH u AS ({UPSTREAM_SQL})"
_STEPS = f"""{_U}, per AS (
  SELECT session_id, step, CAST(arg_max(status, attempt) AS BIGINT) AS status, arg_max(prompt, attempt) AS prompt, arg_max(lcp, attempt) AS lcp, any_value(kind) AS kind, count(*) AS attempts FROM u GROUP BY 1, 2
), steps AS (
  SELECT *, last_value(CASE WHEN status = 200 THEN prompt END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM per
)"""
_DIST = "count(v) AS n, round(quantile_disc(CAST(v AS DOUBLE), 0.5), 1) AS p50, round(quantile_disc(CAST(v AS DOUBLE), 0.9), 1) AS p90, round(quantile_disc(CAST(v AS DOUBLE), 0.99), 1) AS p99, CAST(max(v) AS DOUBLE) AS max, round(avg(v), 1) AS mean"

SQL = {
    "a13_basics": f"""{_U} SELECT kind, count(*) FILTER (WHERE status = 200) AS accepted, count(*) FILTER (WHERE status <> 200) AS rejected, CAST(coalesce(sum(prompt) FILTER (WHERE status = 200), 0) AS BIGINT) AS prompt_accepted,
  CAST(coalesce(sum(prompt) FILTER (WHERE status <> 200), 0) AS BIGINT) AS prompt_rejected, CAST(coalesce(sum(completion) FILTER (WHERE status = 200), 0) AS BIGINT) AS completion, max(prompt) AS peak FROM u GROUP BY 1""",
    "a15_back_to_back": f"""{_STEPS}, s AS (SELECT *, lag(step) OVER (PARTITION BY session_id ORDER BY step) AS prev FROM steps WHERE before IS NOT NULL AND prompt < before),
i AS (SELECT *, CAST(sum(CASE WHEN prev IS NOT DISTINCT FROM step - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY step) AS BIGINT) AS island FROM s)
SELECT session_id, island, min(step) AS first, count(*) AS length FROM i GROUP BY 1, 2""",
    "a16_retries": f"""{_U}, a AS (SELECT *, lag(prompt) OVER (PARTITION BY session_id, step ORDER BY attempt) AS prev FROM u),
p AS (SELECT session_id, step, arg_max(status, attempt) AS last, count(*) AS n, count(*) FILTER (WHERE prompt >= prev) AS grown FROM a GROUP BY 1, 2)
SELECT session_id, count(*) FILTER (WHERE last = 200 AND n > 1) AS recoveries, CAST(sum(grown) AS BIGINT) AS violations, max(n) AS most FROM p GROUP BY 1""",
    "a21_timing": f"{_U} SELECT kind, {_DIST} FROM (SELECT *, ms AS v FROM u) GROUP BY 1",
    "a24_client_errors": f"""{_U} SELECT CASE WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'overflow' WHEN completion < 25 THEN 'length_no_tool' ELSE 'ok' END AS error, kind, count(*) AS n FROM u GROUP BY ALL""",
    "a23_headroom": f"{_U} SELECT session_id, max(prompt + completion) - 8000 AS headroom, arg_max(seq, (prompt + completion) * 100000 + seq) AS seq FROM u GROUP BY 1",
    "a06_status_histogram": f"{_U} SELECT CAST(status AS BIGINT) AS status, count(*) AS n, count(DISTINCT session_id) AS sessions FROM u GROUP BY 1",
    "a22_wilson": f"""{_STEPS}, g AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE status = 200) AS passes FROM steps GROUP BY 1), p AS (SELECT *, CAST(passes AS DOUBLE) / n AS p, CAST(1.96 AS DOUBLE) AS z FROM g)
SELECT kind, n, passes, round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS low,
  round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS high FROM p""",
    "w15_ring_percentiles": f"{_U} SELECT kind, {_DIST} FROM (SELECT *, ms AS v FROM u QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seq DESC, session_id DESC) <= 64) GROUP BY 1",
    "w16_running_p90": f"""{_U}, g AS (SELECT *, list_sort(list(ms) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) AS l, avg(ms) OVER (PARTITION BY session_id ORDER BY seq) AS m FROM u WHERE status = 200)
SELECT session_id, seq, l[CAST(ceil(len(l) * CAST(0.9 AS DOUBLE)) AS BIGINT)] AS p90, round(m, 6) AS mean FROM g""",
    "a28_chunk_gaps": """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, max(gap) AS worst, quantile_disc(gap, 0.99) AS p99 FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "a35_event_lag": """WITH g AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY epoch_us(ts), event_id) AS gap FROM events)
SELECT day, count(*) AS n, quantile_disc(gap, 0.99) AS p99, count(*) FILTER (WHERE gap >= 3600000000) AS stalls FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "j13_interval_overlap": """SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND b.ts < a.ts + INTERVAL 10 MINUTE GROUP BY 1""",
    "w23_distinct_24h": """WITH w AS (SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS types FROM events) SELECT * FROM w WHERE types >= 2""",
    "t05_newest_buckets": """WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY bucket DESC) AS r FROM h)
SELECT bucket, n, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM r WHERE r > 2000) AS dropped FROM r WHERE r <= 2000""",
    "m12_judge_samples": f"""{_U} SELECT CASE WHEN status <> 200 THEN 'filtered: incomplete' WHEN bytes < greatest(4000, 6100) THEN 'filtered: too small'
  WHEN CAST(prompt * 2 AS DOUBLE) / bytes < 0.5 OR CAST(prompt * 2 AS DOUBLE) / bytes > 2.5 THEN 'mismatch' ELSE 'accepted' END AS verdict, count(*) AS n FROM u GROUP BY 1""",
    "j10_step_views": f"{_STEPS} SELECT session_id, step, status, prompt, before, attempts FROM steps",
}
