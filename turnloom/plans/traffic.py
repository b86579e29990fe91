"""Reports over request records and upstream attempts. The SQL for the second engine is written apart from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators.logs import ACTIONS
from turnloom.plans.metrics import steps, upstream
from turnloom.plans.report import stats
from turnloom.sources.requests import UPSTREAM_SQL
from turnloom.sources.stats import STATS_SQL

#: Sessions counted exactly, keys counted by name, newest requests shown, samples of a ring, days kept.
MOST_SESSIONS, MOST_KEYS, LATEST, RING, DAYS = 10_000, 64, 64, 2048, 14


def is_valid() -> Column:
    """seq is whole, the action is known, the client's status is a status, and something was measured."""
    told = F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull() | (F.col("n_attempts") > 0)
    return F.coalesce((F.col("seq") >= 0) & F.col("action").isin(ACTIONS) & F.col("client_status").between(100, 599) & told, F.lit(False))


def valid_records(r: DataFrame) -> DataFrame:
    return r.where(is_valid()).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.max("client_status").cast("long").alias("top_status"))


def failures(r: DataFrame) -> DataFrame:
    tried = F.col("n_attempts") > 0
    n = lambda c, name: F.count_if(c).alias(name)
    return r.groupBy("action").agg(
        n(F.col("client_status") >= 400, "by_status"), n(F.col("upstream_incomplete"), "incomplete"), n(tried & (F.col("last_status") != 200), "by_attempt"), n(~tried & (F.col("client_status") >= 400), "local_rejects"), n(F.col("shadow"), "shadow"),
    )


def coverage(r: DataFrame) -> DataFrame:
    """How many records hold each field."""
    fields = ("seq", "ts", "session", "action", "client_status", "tokens_in", "tokens_out", "transient_retries")
    return r.agg(F.count(F.lit(1)).alias("records"), *(F.count(c).alias(c) for c in fields), F.count_if(F.col("n_attempts") > 0).alias("attempts"))


def distinct_sessions(r: DataFrame) -> DataFrame:
    """Exact up to MOST_SESSIONS, then that many and a flag; ids are compared by their digests."""
    some = r.where("session is not null").select(F.sha2("session", 256).alias("d")).distinct().limit(MOST_SESSIONS + 1).agg(F.count(F.lit(1)).alias("n"))
    missing = r.agg(F.count_if(F.col("session").isNull()).alias("missing"))
    return some.crossJoin(F.broadcast(missing)).select(F.least("n", F.lit(MOST_SESSIONS)).cast("long").alias("sessions"), (F.col("n") > MOST_SESSIONS).alias("lower_bound"), "missing")


def counters(r: DataFrame) -> DataFrame:
    """Requests by session: the MOST_KEYS sessions seen first by name, all others as one. No task holds all keys."""
    per = r.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    named = per.orderBy("first", "session").limit(MOST_KEYS).select(F.col("session").alias("name"))
    return per.join(F.broadcast(named), per["session"].eqNullSafe(named["name"]), "left").groupBy(F.coalesce("name", F.lit("other")).alias("session")).agg(F.sum("n").alias("n"))


def latest(r: DataFrame) -> DataFrame:
    """The LATEST newest requests, whatever gaps seq has: the best of each task, then of all."""
    return r.select("seq", "action").orderBy(F.desc("seq")).limit(LATEST)


def outcomes(r: DataFrame) -> DataFrame:
    """How each request ended: refused here, failed upstream, cut short, left by the client, or well."""
    outcome = (
        F.when(F.col("n_attempts") == 0, "refused").when(F.col("last_status") >= 400, "upstream_error").when(F.col("upstream_incomplete"), "incomplete").when(F.col("client_status").isin(499, 599), "aborted").otherwise("ok")
    )
    return r.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def retention_days(r: DataFrame) -> DataFrame:
    """Records of the newest DAYS UTC days."""
    day = F.to_date("ts")
    newest = r.agg(F.max(day).alias("newest"))
    return r.withColumn("day", day).crossJoin(F.broadcast(newest)).where(F.col("day") > F.date_sub("newest", DAYS)).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def records(r: DataFrame) -> DataFrame:
    """The derived row of each record: attempts, retries, volumes, savings, flags."""
    failed = (F.col("client_status") >= 400) | F.col("upstream_incomplete") | ((F.col("n_attempts") > 0) & (F.col("last_status") != 200))
    saved = F.col("tokens_in") - F.col("tokens_out")
    return r.select(
        "seq", "ts", "action", "client_status", "n_attempts", F.greatest(F.col("n_attempts") - 1, F.lit(0)).cast("long").alias("retries"), F.col("compacted").alias("compacted"), failed.alias("failed"),
        saved.alias("saved"), F.floor(F.lit(1000) * F.col("tokens_out") / F.col("tokens_in")).cast("long").alias("ratio_permille"), F.coalesce(F.col("tokens_out") > F.col("tokens_in"), F.lit(False)).alias("grew"),
    )


# ---------------------------------------------------------------- attempts


def session_summary(u: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    s = F.col("status")
    return steps(u).groupBy("session_id").agg(F.count(F.lit(1)).alias("steps"), n(s == 200, "ok"), n(s == 400, "rejections"), n(s >= 500, "errors"), F.sum("prompt").alias("sent"), F.max("prompt").alias("peak"))


def sweep(u: DataFrame) -> DataFrame:
    """The setting of each kind with fewest failures, then least cost."""
    cells = steps(u).groupBy("kind", F.pmod("session_id", F.lit(10)).alias("setting")).agg(F.count_if(F.col("status") != 200).alias("failed"), F.sum("prompt").alias("cost"))
    best = F.min(F.struct("failed", "cost", "setting")).alias("m")
    return cells.groupBy("kind").agg(best).select("kind", "m.setting", "m.cost")


def overshoot(u: DataFrame, window: int = 1500) -> DataFrame:
    """By how much refused attempts were over the window: prompt and completion together, or prompt alone by kind."""
    over = F.when(F.col("kind") == "main", F.col("prompt") + F.col("completion")).otherwise(F.col("prompt")) - window
    return u.where("status = 400").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(over).alias("overshoot"), F.min(over).alias("least"))


def scores(u: DataFrame) -> DataFrame:
    """Per run: steps put right by another attempt, overflow attempts, accepted attempts with a usage."""
    s = steps(u).groupBy(F.pmod("session_id", F.lit(20)).alias("run")).agg(F.count_if((F.col("attempts") > 1) & (F.col("status") == 200)).alias("corrected"), F.count_if(F.col("status") == 400).alias("ended_refused"), F.count_distinct("session_id").alias("sessions"))
    a = u.groupBy(F.pmod("session_id", F.lit(20)).alias("run")).agg(F.count_if(F.col("status") == 400).alias("overflows"), F.count_if((F.col("status") == 200) & (F.col("completion") > 25)).alias("with_usage"))
    return s.join(a, "run")


def baseline(u: DataFrame) -> DataFrame:
    """Cost of each session against a recorded one: exact, within a half more, beyond, or on one side only."""
    s = steps(u)
    now = s.where("session_id % 5 <> 0").groupBy("session_id").agg(F.sum("prompt").alias("now"))
    base = s.where("session_id % 7 <> 0").groupBy("session_id").agg(F.sum(F.when(F.col("session_id") % 3 == 0, F.col("prompt")).otherwise(F.col("completion") * 8)).alias("base"))
    verdict = F.when(F.col("base").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("base"), "equal").when(2 * F.col("now") > 3 * F.col("base"), "slower").otherwise("ok")
    return now.join(base, "session_id", "full").select("session_id", verdict.alias("verdict"))


def zipped(u: DataFrame) -> DataFrame:
    """The k-th main attempt of a session with its k-th auxiliary one."""
    k = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("seq")).cast("long")
    n = u.select("session_id", "kind", "seq", k.alias("k"))
    return n.where("kind = 'main'").drop("kind").join(n.where("kind = 'aux'").select("session_id", "k", F.col("seq").alias("aux_seq")), ["session_id", "k"])


def manifest(u: DataFrame) -> DataFrame:
    """Steps 1, 3 and 5 of every session, run or not."""
    s = steps(u)
    wanted = s.select("session_id").distinct().select("session_id", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 3, 5)))).alias("step"))
    return s.select("session_id", "step", "status").join(wanted, ["session_id", "step"], "right").select("session_id", "step", F.coalesce(F.col("status").cast("string"), F.lit("NOT RUN")).alias("state"))


#: Shares by kind; the root's where a kind has none.
PROFILES, ROOT = {"aux": 4}, 9


def profiles(u: DataFrame) -> DataFrame:
    table = u.sparkSession.createDataFrame(list(PROFILES.items()), "kind string, share int")
    return u.join(F.broadcast(table), "kind", "left").groupBy("kind", F.coalesce("share", F.lit(ROOT)).alias("share")).agg(F.count(F.lit(1)).alias("n"))


def allowance(u: DataFrame, most: int = 700) -> DataFrame:
    """The 99th percentile of each kind's newest RING completions, and whether it is over the allowance."""
    # the newest of each slice first, so that no task sorts a whole kind
    new = lambda *keys: F.row_number().over(Window.partitionBy("kind", *keys).orderBy(F.desc("seq"), F.desc("session_id"), F.desc("step"), F.desc("attempt")))
    ring = u.where("status = 200").withColumn("r", new(F.pmod("session_id", F.lit(256)))).where(F.col("r") <= RING).withColumn("r", new()).where(F.col("r") <= RING)
    p99 = F.expr("cast(percentile_disc(0.99) within group (order by completion) as bigint)")
    return ring.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), p99.alias("p99")).withColumn("warn", F.col("p99") > most)


def reduction(r: DataFrame) -> DataFrame:
    both = r.where("tokens_in is not null and tokens_out is not null")
    return both.groupBy("action").agg((1 - F.sum("tokens_out") / F.sum("tokens_in")).alias("ratio"))


def span(r: DataFrame) -> DataFrame:
    return r.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def transient(r: DataFrame) -> DataFrame:
    n = F.when(F.col("transient_retries") > 0, F.col("transient_retries"))
    return r.agg(F.count(n).alias("requests"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("retries"))


def _stats(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(stats(spark, sf_dir))


def _up(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(upstream(spark, sf_dir))


QUERIES = {
    "sc02_valid_records": _stats(valid_records), "a02_failures": _stats(failures), "a05_field_coverage": _stats(coverage), "a07_distinct_sessions": _stats(distinct_sessions), "a08_time_span": _stats(span),
    "a09_transient_retries": _stats(transient), "a12_counters": _stats(counters), "a25_reduction_by_action": _stats(reduction), "t06_latest_requests": _stats(latest), "st11_outcomes": _stats(outcomes),
    "d05_retention_days": _stats(retention_days), "sk02_record_projection": _stats(records), "a17_session_summary": _up(session_summary), "a27_sweep_choice": _up(sweep), "a30_overshoot": _up(overshoot),
    "a31_retention_scores": _up(scores), "a33_baseline_compare": _up(baseline), "j09_zip": _up(zipped), "j15_manifest": _up(manifest), "j17_profiles": _up(profiles), "st13_allowance_warnings": _up(allowance),
}

_S = f"WITH stats AS ({STATS_SQL})"
_U = f"""WITH upstream AS ({UPSTREAM_SQL}), steps AS (
  SELECT session_id, step, arg_max(status, attempt) AS status, arg_max(prompt, attempt) AS prompt, arg_max(completion, attempt) AS completion, min(kind) AS kind, count(*) AS attempts FROM upstream GROUP BY 1, 2)"""
_KNOWN = ", ".join(f"'{a}'" for a in ACTIONS)

SQL = {
    "sc02_valid_records": f"""{_S} SELECT action, count(*) AS n, CAST(max(client_status) AS BIGINT) AS top_status FROM stats WHERE seq >= 0 AND action IN ({_KNOWN}) AND client_status >= 100 AND client_status < 600
  AND NOT (tokens_in IS NULL AND tokens_out IS NULL AND n_attempts = 0) GROUP BY 1""",
    "a02_failures": f"""{_S} SELECT action, count(*) FILTER (WHERE client_status >= 400) AS by_status, count(*) FILTER (WHERE upstream_incomplete) AS incomplete, count(*) FILTER (WHERE n_attempts > 0 AND last_status <> 200) AS by_attempt,
  count(*) FILTER (WHERE n_attempts = 0 AND client_status >= 400) AS local_rejects, count(*) FILTER (WHERE shadow) AS shadow FROM stats GROUP BY action""",
    "a05_field_coverage": f"""{_S} SELECT count(*) AS records, count(seq) AS seq, count(ts) AS ts, count("session") AS "session", count(action) AS action, count(client_status) AS client_status, count(tokens_in) AS tokens_in, count(tokens_out) AS tokens_out,
  count(transient_retries) AS transient_retries, count(*) FILTER (WHERE n_attempts > 0) AS attempts FROM stats""",
    "a07_distinct_sessions": f"{_S} SELECT least(count(DISTINCT session), 10000) AS sessions, count(DISTINCT session) > 10000 AS lower_bound, count(*) FILTER (WHERE session IS NULL) AS missing FROM stats",
    "a08_time_span": f"{_S} SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM stats",
    "a09_transient_retries": f"{_S} SELECT count(*) FILTER (WHERE transient_retries > 0) AS requests, CAST(sum(CASE WHEN transient_retries > 0 THEN transient_retries ELSE 0 END) AS BIGINT) AS retries FROM stats",
    "a12_counters": f"""{_S}, c AS (SELECT session, count(*) AS n, row_number() OVER (ORDER BY min(seq), session) AS rank FROM stats GROUP BY session) SELECT CASE WHEN rank <= 64 THEN session ELSE 'other' END AS session, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "a25_reduction_by_action": f"{_S} SELECT action, CAST(1 - CAST(sum(tokens_out) AS DOUBLE) / CAST(sum(tokens_in) AS DOUBLE) AS DOUBLE) AS ratio FROM stats WHERE tokens_in IS NOT NULL AND tokens_out IS NOT NULL GROUP BY action",
    "t06_latest_requests": f"{_S} SELECT seq, action FROM stats QUALIFY row_number() OVER (ORDER BY seq DESC) <= 64",
    "st11_outcomes": f"""{_S} SELECT CASE WHEN n_attempts = 0 THEN 'refused' WHEN last_status >= 400 THEN 'upstream_error' WHEN upstream_incomplete THEN 'incomplete' WHEN client_status IN (499, 599) THEN 'aborted' ELSE 'ok' END AS outcome, count(*) AS n FROM stats GROUP BY 1""",
    "d05_retention_days": f"{_S} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM stats WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM stats) - INTERVAL 14 DAY GROUP BY 1",
    "sk02_record_projection": f"""{_S} SELECT seq, ts, action, client_status, n_attempts, CAST(greatest(n_attempts - 1, 0) AS BIGINT) AS retries, compacted, client_status >= 400 OR upstream_incomplete OR (n_attempts > 0 AND last_status <> 200) AS failed,
  tokens_in - tokens_out AS saved, CAST(floor(1000 * CAST(tokens_out AS DOUBLE) / tokens_in) AS BIGINT) AS ratio_permille, coalesce(tokens_out > tokens_in, FALSE) AS grew FROM stats""",
    "a17_session_summary": f"""{_U} SELECT session_id, count(*) AS steps, count(*) FILTER (WHERE status = 200) AS ok, count(*) FILTER (WHERE status = 400) AS rejections, count(*) FILTER (WHERE status >= 500) AS errors, CAST(sum(prompt) AS BIGINT) AS sent, max(prompt) AS peak FROM steps GROUP BY 1""",
    "a27_sweep_choice": f"""{_U}, c AS (SELECT kind, session_id % 10 AS setting, count(*) FILTER (WHERE status <> 200) AS failed, CAST(sum(prompt) AS BIGINT) AS cost FROM steps GROUP BY 1, 2) SELECT kind, setting, cost FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY failed, cost, setting) = 1""",
    "a30_overshoot": f"""{_U}, o AS (SELECT kind, prompt + CASE WHEN kind = 'main' THEN completion ELSE 0 END - 1500 AS o FROM upstream WHERE status = 400) SELECT kind, count(*) AS n, max(o) AS overshoot, min(o) AS least FROM o GROUP BY 1""",
    "a31_retention_scores": f"""{_U} SELECT run, corrected, ended_refused, sessions, overflows, with_usage FROM (SELECT session_id % 20 AS run, count(*) FILTER (WHERE attempts > 1 AND status = 200) AS corrected, count(*) FILTER (WHERE status = 400) AS ended_refused, count(DISTINCT session_id) AS sessions FROM steps GROUP BY 1)
  JOIN (SELECT session_id % 20 AS run, count(*) FILTER (WHERE status = 400) AS overflows, count(*) FILTER (WHERE status = 200 AND completion > 25) AS with_usage FROM upstream GROUP BY 1) USING (run)""",
    "a33_baseline_compare": f"""{_U}, n AS (SELECT session_id, sum(prompt) AS now FROM steps WHERE session_id % 5 <> 0 GROUP BY 1), b AS (SELECT session_id, sum(CASE WHEN session_id % 3 = 0 THEN prompt ELSE completion * 8 END) AS base FROM steps WHERE session_id % 7 <> 0 GROUP BY 1)
SELECT session_id, CASE WHEN base IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN now = base THEN 'equal' WHEN now > 1.5 * base THEN 'slower' ELSE 'ok' END AS verdict FROM n FULL JOIN b USING (session_id)""",
    "j09_zip": f"""{_U}, n AS (SELECT session_id, kind, seq, row_number() OVER (PARTITION BY session_id, kind ORDER BY seq) AS k FROM upstream) SELECT a.session_id, a.k, a.seq, b.seq AS aux_seq FROM n a JOIN n b ON a.session_id = b.session_id AND a.k = b.k AND a.kind = 'main' AND b.kind = 'aux'""",
    "j15_manifest": f"""{_U}, m AS (SELECT DISTINCT session_id, CAST(unnest([1, 3, 5]) AS BIGINT) AS step FROM steps) SELECT m.session_id, m.step, coalesce(CAST(s.status AS VARCHAR), 'NOT RUN') AS state FROM m LEFT JOIN steps s ON s.session_id = m.session_id AND s.step = m.step""",
    "j17_profiles": f"""{_U} SELECT kind, CASE kind WHEN 'aux' THEN 4 ELSE 9 END AS share, count(*) AS n FROM upstream GROUP BY ALL""",
    "st13_allowance_warnings": f"""{_U}, r AS (SELECT kind, completion FROM upstream WHERE status = 200 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seq DESC, session_id DESC, step DESC, attempt DESC) <= 2048) SELECT kind, count(*) AS n, quantile_disc(completion, 0.99) AS p99, quantile_disc(completion, 0.99) > 700 AS warn FROM r GROUP BY 1""",
}
