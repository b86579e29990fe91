"""Captured requests, response streams, error bodies and config checks, shaped from conversations, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import errors, wire
from turnloom.operators import logs
from turnloom.plans import budget
from turnloom.plans.report import _SQL_FROM, _SQL_MEASURES, stats, timeline
from turnloom.sources.tables import read

#: For each case (conv_id % 9): what is made of the plain body {0}; {1} is the body as JSON text.
CASES = ("{0}", '{{"body":{0}}}', '{{"id":7,"request":"{1}"}}', None, "[1,2]", '{{"model":"m"}}', '{{"messages":[{{"role":"user"}},1]}}', '{{"messages":[],"seed":9007199254740993}}', '{{"messages":[{{"role":"user"}}],"x":1e400}}')


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, body: a captured record for each conversation."""
    c = read(spark, sf_dir, "conversations")
    message = F.concat(F.lit('{"role":"'), "role", F.lit('","content":"turn '), F.col("turn").cast("string"), F.lit('"}'))
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("l"))
    plain = F.concat(F.lit('{"messages":['), F.array_join(F.transform("l", lambda x: x["m"]), ","), F.lit('],"max_tokens":'), (F.col("conv_id") * 37).cast("string"), F.lit("}"))
    escaped = F.replace(plain, F.lit('"'), F.lit('\\"'))
    body = F.substring(plain, F.lit(1), F.length(plain) - 3)
    for i, form in enumerate(CASES):
        if form is not None:
            parts = form.replace("{{", "{").replace("}}", "}")
            a, mark, z = parts.partition("{0}") if "{0}" in parts else parts.partition("{1}")
            text = F.concat(F.lit(a), plain if mark == "{0}" else escaped, F.lit(z)) if mark else F.lit(a)
            body = F.when(F.col("conv_id") % 9 == i, text).otherwise(body)
    return m.select("conv_id", body.alias("body"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("body")
    inner = wire.unwrapped(b)
    count = F.size(F.from_json(F.get_json_object(inner, "$.messages"), "array<string>"))
    return bodies(spark, sf_dir).select("conv_id", wire.body_defect(b).alias("defect"), wire.has_unsafe_number(b).alias("unsafe"), inner.isNotNull().alias("chat"), F.when(inner.isNotNull(), count).cast("long").alias("messages"), F.when(inner.isNotNull(), wire.request_bytes(inner)).alias("bytes"))


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string")
    made = F.when(k == 0, F.concat(F.lit('{"prompt":"order '), i, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"prompt":["a","order '), i, F.lit('"]}'))).when(k == 2, F.concat(F.lit('{"prompt":['), i, F.lit(",2,3]}"))).when(k == 3, F.lit('{"prompt":[[1,2],[3]]}'))
    made = made.when(k == 4, F.lit('{"prompt":[]}')).when(k == 5, F.concat(F.lit('{"n":'), i, F.lit("}"))).when(k == 6, F.lit('{"prompt":["a",1]}')).otherwise(F.lit('{"prompt":'))
    prompts, reason = wire.legacy_prompts(F.col("body"))
    return read(spark, sf_dir, "orders").select("o_orderkey", made.alias("body")).select("o_orderkey", reason.alias("reason"), F.size(prompts).cast("long").alias("n"), F.length(F.array_join(prompts, "")).cast("long").alias("chars"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body: a response stream for each user, one chunk an event: text, finish reasons, usage, errors; some are cut short."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    data = (
        F.when(k == 0, F.lit('{"choices":[{"finish_reason":null,"delta":{"content":"x"}}]}'))
        .when(k == 1, F.concat(F.lit('{"choices":[{"finish_reason":"stop"}],"n":'), F.col("event_id").cast("string"), F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"choices":[],"usage":{"prompt_tokens":'), F.col("event_id").cast("string"), F.lit(',"completion_tokens":5}}')))
        .when((k == 3) & (F.col("event_id") % 4 == 3), F.lit('{"error":{"code":"503","message":"busy"}}'))
        .otherwise(F.lit('{"choices":[{"finish_reason":"length"},{"finish_reason":null}]}'))
    )
    m = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", data.alias("d")))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: F.concat(F.lit("data: "), x["d"])), "\n\n")
    end = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.lit("\r\n\r\n: done\n\ndata: [DONE]\n\n"))
    return m.select(F.col("user_id").alias("id"), F.concat(lines, end).alias("body"))


def tapped(events: DataFrame) -> DataFrame:
    """What a relay reads from each stream: events, last usage, last finish reason, end mark, the first error and its status, completeness."""
    d = F.col("data")
    usage = wire.usage(d)
    return events.where("not comment").groupBy("id").agg(
        F.count(F.lit(1)).alias("events"), F.max_by(usage["prompt_tokens"], F.when(usage.isNotNull(), F.col("n"))).alias("prompt"), F.count_if(wire.usage_only(d)).alias("usage_only"),
        F.max_by(wire.finish_reason(d), F.when(wire.finish_reason(d).isNotNull(), F.col("n"))).alias("finish"), F.max(d == "[DONE]").alias("done"), F.min(F.when(wire.is_error(d), F.col("n"))).cast("long").alias("error_at"),
        F.min_by(wire.error_status(d, F.lit(200)), F.when(wire.is_error(d), F.col("n"))).alias("status"), F.min(F.col("terminated")).alias("terminated"),
    ).withColumn("complete", F.col("done") & F.col("terminated") & F.col("error_at").isNull()).drop("terminated")


def tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapped(logs.sse_events(streams(spark, sf_dir)))


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of refused requests that may be believed, from bodies of three servers."""
    k, n = F.col("o_orderkey") % 4, (F.col("o_custkey") + 1) * 1000
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    body = (
        F.when(k == 0, text("This model's maximum context length is ", F.lit(32000), " tokens. However, your request has ", n, " input tokens"))
        .when(k == 1, text("`inputs` must have less than ", n, " tokens. Given: ", n + 10))
        .when(k == 2, text("The input (", n, " tokens) is longer than the model's context length (", n - 50, " tokens)"))
        .otherwise(F.lit("too many tokens"))
    )
    o = read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), F.lit(100000).cast("long").alias("configured"), (F.col("o_custkey") * 900 + 500).cast("long").alias("raw"))
    o = o.withColumn("message", errors.message_of(F.col("body")))
    c = errors.classify(F.lit(400), F.col("body"), F.col("message"))
    told = o.select("o_orderkey", "configured", "raw", *(x.alias(name) for name, x in c.items()))
    v = errors.validated({name: F.col(name) for name in c}, F.col("configured"), F.col("raw"))
    return told.select("o_orderkey", "rule", *(x.alias(name) for name, x in v.items()))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * 4127
    return read(spark, sf_dir, "orders").select("o_orderkey", wire.thousands(n).alias("about"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as placeholders: nothing but sizes and line breaks is left."""
    t = F.coalesce("text", F.lit(""))
    m = wire.placeholder(t)
    return read(spark, sf_dir, "documents").select("doc_id", F.length(m).cast("long").alias("points"), F.octet_length(m).cast("long").alias("bytes"), F.regexp_count(m, F.lit("\n")).cast("long").alias("feeds"), m.rlike(r"[a-tA-Z0-9]").alias("leaks"))


def timeline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by day as lines of a CSV file, the head first."""
    t = timeline(stats(spark, sf_dir), "day")
    cells = [F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss'Z'"), *(F.col(c).cast("string") for c in ("requests", "compactions", "retries", "failures", "tokens_in", "tokens_out")), F.coalesce(F.format_string("%.2f", "reduction_percent"), F.lit(""))]
    head = spark.createDataFrame([("start,requests,compactions,retries,failures,input,forwarded,reduction_percent",)], "line string")
    n = F.row_number().over(Window.partitionBy(F.substring("line", 1, 4)).orderBy("line"))
    return head.unionByName(t.select(F.concat_ws(",", *cells).alias("line"))).withColumn("n", n).select("line")


def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that a client declares against the budgets they lead to."""
    b = budget.budgets(spark, sf_dir).where("max_prompt is null and tighten = 0")
    declared = F.col("window") - F.when(F.col("reply") % 3 == 0, F.lit(4096)).otherwise(0)
    verdict = F.when(F.col("budget") <= 0, "no room").when(declared < F.col("client_point"), "client compacts first").when(F.col("allowance") >= F.col("budget"), "allowance too large").otherwise("ok")
    return b.select("window", "reply", declared.cast("long").alias("declared"), verdict.alias("verdict"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of people: runs of digits count as numbers."""
    name = F.concat(F.lit("req-"), (F.col("p_partkey") * 7 % 1000).cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".json"))
    return read(spark, sf_dir, "part").select("p_partkey", wire.natural_key(name).alias("key"))


QUERIES = {
    "sc06_bodies": parsed, "sc08_legacy_prompts": legacy, "st10_stream_tap": tap, "x25_validated_numbers": learned, "f07_thousands": shown, "f22_placeholders": masked, "sk04_timeline_csv": timeline_csv, "a37_config_checks": config_checks, "t09_natural_sort": files,
}

_BODIES = """WITH l AS (
  SELECT conv_id, '{"messages":[' || string_agg('{"role":"' || role || '","content":"turn ' || turn || '"}', ',' ORDER BY turn) || '],"max_tokens":' || conv_id * 37 || '}' AS plain, count(*) AS turns,
    string_agg('{"role":"' || role || '","content":"turn ' || turn || '"}', ',' ORDER BY turn) AS list FROM conversations GROUP BY conv_id
)"""
_TAP = """WITH e AS (SELECT user_id AS id, event_id, event_id % 6 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), f AS (
  SELECT *, CASE WHEN k = 1 THEN 'stop' WHEN k IN (4, 5) OR (k = 3 AND event_id % 4 <> 3) THEN 'length' END AS finish, k = 3 AND event_id % 4 = 3 AS bad FROM e)"""

SQL = {
    "sc06_bodies": f"""{_BODIES} SELECT conv_id, CASE conv_id % 9 WHEN 1 THEN 'no_messages' WHEN 2 THEN 'no_messages' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'no_messages' WHEN 6 THEN 'message_not_an_object' END AS defect,
  conv_id % 9 IN (7, 8) AS unsafe, conv_id % 9 IN (0, 1, 2, 6, 7, 8) AS chat, CAST(CASE WHEN conv_id % 9 < 3 THEN turns WHEN conv_id % 9 = 6 THEN 2 WHEN conv_id % 9 = 7 THEN 0 WHEN conv_id % 9 = 8 THEN 1 END AS BIGINT) AS messages,
  CAST(CASE WHEN conv_id % 9 < 3 THEN strlen(list) + 2 + 512 WHEN conv_id % 9 = 6 THEN 512 + 19 WHEN conv_id % 9 = 7 THEN 514 WHEN conv_id % 9 = 8 THEN 512 + 17 END AS BIGINT) AS bytes FROM l""",
    "sc08_legacy_prompts": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN 'token_ids' WHEN 3 THEN 'token_ids' WHEN 4 THEN 'no_prompt' WHEN 5 THEN 'no_prompt' WHEN 6 THEN 'unsupported' WHEN 7 THEN 'not_json' END AS reason,
  CAST(CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS BIGINT) AS n, CAST(CASE o_orderkey % 8 WHEN 0 THEN 6 + length(CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN 7 + length(CAST(o_orderkey AS VARCHAR)) END AS BIGINT) AS chars FROM orders""",
    "st10_stream_tap": f"""{_TAP} SELECT id, count(*) + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS events, max(event_id) FILTER (WHERE k = 2) AS prompt, count(*) FILTER (WHERE k = 2) AS usage_only, arg_max(finish, n) FILTER (WHERE finish IS NOT NULL) AS finish, id % 3 <> 0 AS done, min(n) FILTER (WHERE bad) AS error_at,
  CAST(CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 503 END AS INTEGER) AS status, id % 3 <> 0 AND count(*) FILTER (WHERE bad) = 0 AS complete FROM f GROUP BY id""",
    "f22_placeholders": r"""SELECT doc_id, length(coalesce(text, '')) AS points, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS BIGINT) AS feeds, false AS leaks FROM documents""",
    "sk04_timeline_csv": f"""WITH t AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, {_SQL_MEASURES} {_SQL_FROM} GROUP BY 1) SELECT 'start,requests,compactions,retries,failures,input,forwarded,reduction_percent' AS line
UNION ALL SELECT concat_ws(',', strftime(bucket, '%Y-%m-%dT%H:%M:%SZ'), requests, compactions, retries, failures, tokens_in, tokens_out, coalesce(printf('%.2f', reduction_percent), '')) FROM t""",
    "a37_config_checks": budget.SQL["m02_budget_grid"].replace(" SELECT \"window\", reply, tighten", ", b AS (SELECT \"window\", reply, tighten", 1) + """) SELECT "window", reply, CAST("window" - CASE WHEN reply % 3 = 0 THEN 4096 ELSE 0 END AS BIGINT) AS declared,
  CASE WHEN budget <= 0 THEN 'no room' WHEN "window" - CASE WHEN reply % 3 = 0 THEN 4096 ELSE 0 END < client_point THEN 'client compacts first' WHEN allowance >= budget THEN 'allowance too large' ELSE 'ok' END AS verdict FROM b WHERE max_prompt IS NULL AND tighten = 0""",
    "x25_validated_numbers": """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST((o_custkey + 1) * 1000 AS BIGINT) AS n, CAST(o_custkey * 900 + 500 AS BIGINT) AS raw FROM orders), c AS (
  SELECT *, CASE k WHEN 0 THEN n WHEN 1 THEN n + 10 WHEN 2 THEN n END AS prompt, CASE k WHEN 0 THEN 32000 WHEN 2 THEN n - 50 END AS w, CASE k WHEN 1 THEN n - 1 END AS l FROM o), b AS (SELECT *, prompt IS NULL OR prompt BETWEEN 0.8 * raw AND 1.25 * raw AS band FROM c)
SELECT o_orderkey, CASE k WHEN 0 THEN 'vllm.v011.prompt' WHEN 1 THEN 'tgi.prompt' WHEN 2 THEN 'sglang.prompt' ELSE 'generic.suspect' END AS rule, CAST(CASE WHEN band AND w > 0 AND w < 100000 THEN w END AS BIGINT) AS "window", CASE WHEN band AND l >= 25000 AND l < 100000 THEN l END AS max_prompt,
  CASE WHEN band THEN prompt END AS prompt_exact, CAST(NULL AS BIGINT) AS prompt_least, CASE WHEN NOT band THEN 'prompt' WHEN w IS NOT NULL AND NOT (w > 0 AND w < 100000) THEN 'window' WHEN l IS NOT NULL AND NOT (l >= 25000 AND l < 100000) THEN 'limit' END AS refused FROM b""",
    "t09_natural_sort": "SELECT p_partkey, 'req-' || lpad(CAST(p_partkey * 7 % 1000 AS VARCHAR), 20, '0') || '-' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') || '.json' AS key FROM part",
    "f07_thousands": """WITH t AS (SELECT o_orderkey, CAST(round(o_orderkey * 4127 / 100.0) AS BIGINT) AS tenths FROM orders), w AS (SELECT *, tenths // 10 AS whole, (SELECT max(x) FROM range(0, 1100) AS r(d), LATERAL (SELECT tenths // 10 - d AS x) AS y WHERE x >= 0 AND NOT regexp_matches(CAST(x AS VARCHAR), '429|500|502|503|504|524')) AS best FROM t)
SELECT o_orderkey, best || '.' || CASE WHEN best = whole THEN tenths - whole * 10 ELSE 9 END || 'k' AS about FROM w""",
}
