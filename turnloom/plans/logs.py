"""Error bodies, masking, retry headers, and parsing of request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import errors, masking
from turnloom.operators import logs
from turnloom.sources.tables import read, views

_BODIES = [
    "This model''s maximum context length is ~ tokens. However, you requested 12 output tokens and your prompt contains at least ~ input tokens",
    "This model''s maximum context length is ~ tokens. However, your request has ~ input tokens",
    "You passed ~ input tokens and requested 7 output tokens. However, the model''s context length is only ~ tokens, resulting in a maximum input length of ~ tokens",
    "The input (~ tokens) is longer than the model''s context length (~ tokens)",
    "request (~ tokens) exceeds the available context size (~ tokens)",
    "`inputs` must have less than ~ tokens. Given: ~",
    "rate limit reached, context length ~",
    "Please reduce the length of the messages ~",
    "upstream ~ is away",
    "max_tokens=~ cannot be greater than max_model_len=~",
    "context_length_exceeded",
    "This model''s maximum context length is ~ tokens",
]
#: One body for each event, in Spark and DuckDB alike; reads the view ``events``.
BODIES_SQL = (
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 400 WHEN 1 THEN 413 WHEN 2 THEN 502 WHEN 3 THEN 422 ELSE 500 END AS status, replace(CASE event_id % 12 "
    + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BODIES))
    + " END, '~', CAST(1000 + event_id AS STRING)) AS body FROM events"
)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    found = errors.classify(F.col("status"), F.col("body"), F.col("message"))
    # Spark reads '' within a literal as two literals side by side
    bodies = spark.sql(BODIES_SQL.replace("''", "\\'")).withColumn("message", errors.message_of(F.col("body")))
    return bodies.select("event_id", *(found[k].alias(n) for k, n in (("rule", "rule"), ("kind", "kind"), ("window", "limit_tokens"), ("prompt", "prompt_tokens"), ("completion", "completion_tokens"), ("maxInput", "max_input"))))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", masking.mask_hosts(F.concat("url", F.lit(" /home/me/x"))).alias("masked"))


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays asked for by a header: whole seconds, or a date against a fixed clock; never negative."""
    views(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 100).cast("string")).when(F.col("event_id") % 3 == 1, F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    e = spark.table("events").select("event_id", value.alias("value"))
    return e.select("event_id", logs.retry_after(F.col("value"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("seconds"))


def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 41).select(F.col("id").alias("attempt"))
    return n.select("attempt", F.least(F.lit(30000), F.lit(500) * F.power(F.lit(2), F.greatest(F.col("attempt") - 2, F.lit(0)))).cast("long").alias("ms"))


QUERIES = {"x24_error_rules": classified, "f24_hosts": hosts, "d03_retry_after": retry_after, "d04_backoff": backoff}


#: What each body is, stated apart from the rules: rule, kind, and where the body's number or a fixed one stands.
_KNOWN = """(0, 'vllm.v018.total', 'overflow_total', 1, 1, 12, 0), (1, 'vllm.v011.prompt', 'overflow_prompt', 1, 1, 0, 0), (2, 'vllm.v016.tokens', 'overflow_total', 1, 1, 7, 1), (3, 'sglang.prompt', 'overflow_prompt', 1, 1, 0, 0),
(4, 'llamacpp.new', 'overflow_prompt', 1, 1, 0, 0), (5, 'tgi.prompt', 'overflow_prompt', 0, 1, 0, 1), (9, 'vllm.max_tokens_gt_window', 'max_tokens_too_large', 1, 0, -1, 0), (10, 'openai.code', 'overflow_unknown', 0, 0, 0, 0), (11, 'vllm.any', 'overflow_total', 1, 0, 0, 0)"""
SQL = {
    "x24_error_rules": f"""WITH known(k, rule, kind, w, p, c, m) AS (VALUES {_KNOWN}), e AS (SELECT event_id, event_id % 12 AS k, event_id % 5 AS s, 1000 + event_id AS n FROM events)
SELECT event_id, CASE WHEN e.k IN (7, 8) THEN CASE WHEN s = 1 THEN 'http.413' WHEN s = 2 THEN 'gateway.5xx' WHEN e.k = 7 AND s IN (0, 3) THEN 'generic.suspect' END ELSE rule END AS rule,
  CASE WHEN e.k IN (7, 8) THEN CASE WHEN s = 1 THEN 'payload_too_large' WHEN s = 2 THEN 'gateway_error' WHEN e.k = 7 AND s IN (0, 3) THEN 'overflow_suspect' END ELSE kind END AS kind,
  CAST(CASE WHEN w = 1 THEN n END AS BIGINT) AS limit_tokens, CAST(CASE WHEN p = 1 THEN n END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN c > 0 THEN c WHEN c < 0 THEN n END AS BIGINT) AS completion_tokens, CAST(CASE WHEN m = 1 THEN n END AS BIGINT) AS max_input
FROM e LEFT JOIN known ON known.k = e.k""",
    "f24_hosts": r"""SELECT page_id, regexp_replace(regexp_replace(url || ' /home/me/x', '(https?://)[^/\s"'']+', '\1host', 'g'), '(/home/|/Users/)[^/\s"'']+', '\1user', 'g') AS masked FROM pages""",
    "d03_retry_after": """SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN event_id % 100 WHEN 1 THEN greatest(0, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-15 00:00:00')) END AS BIGINT) AS seconds FROM events""",
    "d04_backoff": "SELECT CAST(range AS BIGINT) AS attempt, CAST(least(30000, 500 * power(2, greatest(range - 2, 0))) AS BIGINT) AS ms FROM range(1, 41)",
}
