"""Learning, replans, templates and lint, over the derived inputs; SQL for the second engine stated apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import templates
from turnloom.functions.let import let
from turnloom.operators import learning
from turnloom.plans.metrics import upstream
from turnloom.plans.runs import total, views
from turnloom.sources import files
from turnloom.sources.requests import UPSTREAM_SQL
from turnloom.sources.runs import RUN_SQL, run
from turnloom.sources.tables import read
from turnloom.sources.transcript import WITH_TRANSCRIPT, log, transcript

MARKER = "Correction for ORD-"


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = upstream(spark, sf_dir).where("status = 400")
    k = F.col("prompt") % 4
    rows = u.select(F.col("session_id").cast("string").alias("key"), "seq", F.when(k == 3, "payload_too_large").otherwise("overflow_prompt").alias("kind"), F.col("prompt").alias("raw"), "bytes", F.when(k == 0, F.col("prompt") - 50).alias("window"), F.when(k == 1, F.col("prompt") - 70).alias("max_prompt"), F.when(k == 0, F.col("prompt") + 20).alias("prompt"))
    return learning.learned(rows, 4000)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a step that are not strictly smaller than the one before, and those larger than the first."""
    u = upstream(spark, sf_dir)
    w = Window.partitionBy("session_id", "step").orderBy("attempt")
    prev = lambda c: F.lag(c).over(w)
    first = lambda c: F.first(c).over(w)
    smaller = learning.strictly_smaller(F.col("prompt"), F.col("completion"), F.col("bytes"), prev("prompt"), prev("completion"), prev("bytes"), prev("status") == 413)
    inside = learning.within_original(F.col("prompt"), F.col("bytes"), first("prompt"), first("bytes"))
    a = u.select("session_id", "attempt", smaller.alias("smaller"), inside.alias("inside"))
    return a.groupBy("session_id").agg(F.count_if(~F.col("smaller")).alias("not_smaller"), F.count_if(~F.col("inside")).alias("beyond"))


def replans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions change their inputs at step 4; some clients drop their oldest result from step 5 on."""
    s = F.col("session_id")

    def client(x: Column) -> Column:
        at = x["client"]
        dropped = F.concat(F.slice(at, F.lit(1), F.lit(2)), F.slice(at, F.lit(4), F.greatest(F.size(at) - 3, F.lit(0))))
        return F.struct(F.when((x["step"] >= 5) & (s % 4 == 0), dropped).otherwise(at).alias("client"), F.when((s % 5 == 0) & (x["step"] >= 4), 2).otherwise(1).alias("inputs"))

    mutated = F.transform(F.filter(views(F.col("steps")), lambda x: x["client"].isNotNull()), client)
    reasons = let(mutated, lambda l: F.transform(l, lambda x, i: let(F.get(l, i - 1), lambda b: learning.replan(b["client"], b["inputs"], x["client"], x["inputs"]))))
    return run(spark, sf_dir, ["idx"]).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose last message is the session's correction, taken as a client's marker."""
    tokens = F.transform("messages", lambda m: m["tokens"])
    told = lambda x: F.get(F.col("messages"), F.element_at(x["client"], -1))["content"]
    per = let(tokens, lambda t: F.transform(F.filter(views(F.col("steps")), lambda x: x["client"].isNotNull()), lambda x: F.struct(x["step"].alias("step"), total(x["client"], t).alias("prompt"), told(x).alias("last_user"))))
    per = run(spark, sf_dir, ["content", "tokens"]).select("session_id", F.explode(per).alias("x")).select("session_id", "x.*")
    per = per.withColumn("last_user", F.when(F.col("last_user").startswith(MARKER), "marker").otherwise(F.col("last_user")))
    return learning.client_compactions(per, "marker", 150)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a template writes it, and what it costs."""
    log = transcript(spark, sf_dir)
    name = F.when(F.col("role") == "assistant", F.col("tool_name"))
    args = (F.col("role"), F.col("content"), name, F.col("arguments"))
    text = templates.rendered(*args)
    return log.select("session_id", "idx", F.md5(text).alias("digest"), F.length(text).cast("long").alias("chars"), templates.glue_tokens(F.col("role"), name).alias("glue"), templates.fixed_chars(text).alias("plain"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's tokens by template and without; both share the estimates of the texts."""
    rows = log(spark, sf_dir, "role", "content", "tool_name", "arguments")
    name = F.when(F.col("role") == "assistant", F.col("tool_name"))
    both = templates.both(F.col("role"), F.col("content"), name, F.col("arguments"))
    return rows.select("session_id", both.alias("x")).groupBy("session_id").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.generic").alias("generic"))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths at which two states of an order's JSON differ."""
    o = read(spark, sf_dir, "orders")
    doc = lambda key, extra: F.to_json(F.struct("o_custkey", F.struct((F.col("o_orderkey") % key).alias("m"), F.array(F.col("o_orderkey"), F.col("o_orderkey") % 3).alias("l")).alias("in"), extra))
    a, b = o.select("o_orderkey", doc(7, F.lit(1).alias("only_a")).alias("json")), o.select("o_orderkey", doc(14, F.lit(1).alias("only_b")).alias("json"))
    return files.json_differences(a, b, "o_orderkey").select("o_orderkey", "path", "a", "b")


def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of facts outside the channel that is to hold them, by channel."""
    log = transcript(spark, sf_dir)
    markers = spark.createDataFrame([("order", "ORD-", "user"), ("decision", "DECISION:", "assistant"), ("page", "Page URL:", "tool"), ("review", "review", "user")], "marker string, text string, channel string")
    hits = log.select("session_id", "role", F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), F.lit(c).alias("channel"), F.col("content").contains(t).alias("has")) for m, t, c in [tuple(r) for r in markers.toLocalIterator()]))).alias("m"))
    return hits.where("m.has").groupBy(F.col("m.marker").alias("marker"), F.col("m.channel").alias("channel"), "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions")).withColumn("ok", F.col("channel") == F.col("role"))


QUERIES = {"st08_learned_limits": limits, "m16_attempt_order": attempts, "st05_replans": replans, "st12_client_compactions": compactions, "x05_rendered": prompts, "x04_measures": measures, "a34_json_differences": differences, "a36_marker_lint": lint}

_T = WITH_TRANSCRIPT
SQL = {
    "m16_attempt_order": f"""WITH u AS ({UPSTREAM_SQL}), p AS (SELECT *, lag(prompt) OVER w AS p0, lag(completion) OVER w AS c0, lag(bytes) OVER w AS b0, lag(status) OVER w AS s0, first_value(prompt) OVER w AS p1, first_value(bytes) OVER w AS b1 FROM u WINDOW w AS (PARTITION BY session_id, step ORDER BY attempt))
SELECT session_id, count(*) FILTER (WHERE p0 IS NOT NULL AND NOT ((prompt < p0 OR prompt = p0 AND completion < c0) AND CASE WHEN s0 = 413 THEN bytes < b0 ELSE bytes <= b0 END)) AS not_smaller, count(*) FILTER (WHERE prompt > p1 OR bytes > b1) AS beyond FROM p GROUP BY 1""",
    "st05_replans": f"""{_T}, {RUN_SQL}, c AS (SELECT session_id, step, list(digest ORDER BY pos) AS d FROM run WHERE attempt = 0 GROUP BY 1, 2), m AS (SELECT session_id, step, CASE WHEN step >= 5 AND session_id % 4 = 0 THEN list_concat(d[1:2], d[4:]) ELSE d END AS d, CASE WHEN session_id % 5 = 0 AND step >= 4 THEN 2 ELSE 1 END AS i FROM c),
b AS (SELECT *, lag(d) OVER w AS d0, lag(i) OVER w AS i0 FROM m WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT CASE WHEN d0 IS NULL THEN 'new_session' WHEN i <> i0 THEN 'inputs_changed' WHEN d[1:len(d0)] <> d0 THEN 'client_mutation' ELSE 'none' END AS reason, count(*) AS n FROM b GROUP BY 1""",
    "st12_client_compactions": f"""{_T}, {RUN_SQL}, r AS (SELECT session_id, step, CAST(sum(tokens) AS BIGINT) AS prompt, arg_max(content, pos) AS last FROM run WHERE attempt = 0 GROUP BY 1, 2), b AS (SELECT *, lag(prompt) OVER (PARTITION BY session_id ORDER BY step) AS before FROM r)
SELECT session_id, step, before, coalesce(before < 150, false) AS early FROM b WHERE starts_with(last, '{MARKER}')""",
    "x05_rendered": f"""{_T}, p AS (SELECT session_id, idx, role, CASE role WHEN 'assistant' THEN '<|im_start|>assistant' || chr(10) || content || chr(10) || '<tool_call>' || chr(10) || '{{"name": "' || tool_name || '", "arguments": ' || arguments || '}}' || chr(10) || '</tool_call><|im_end|>' || chr(10)
  WHEN 'tool' THEN '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || content || chr(10) || '</tool_response><|im_end|>' || chr(10) ELSE '<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10) END AS text FROM transcript)
SELECT session_id, idx, md5(text) AS digest, length(text) AS chars, CAST(CASE role WHEN 'user' THEN 5 ELSE 10 END AS BIGINT) AS glue, length(text) // 4 AS plain FROM p""",
    "a34_json_differences": """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS x, o_orderkey % 14 AS y FROM orders) SELECT o_orderkey, '$.in.m' AS path, CAST(x AS VARCHAR) AS a, CAST(y AS VARCHAR) AS b FROM o WHERE x <> y
UNION ALL SELECT o_orderkey, '$.only_a', '1', NULL FROM o UNION ALL SELECT o_orderkey, '$.only_b', NULL, '1' FROM o""",
    "a36_marker_lint": f"""{_T}, m(marker, t, channel) AS (VALUES ('order', 'ORD-', 'user'), ('decision', 'DECISION:', 'assistant'), ('page', 'Page URL:', 'tool'), ('review', 'review', 'user'))
SELECT marker, channel, role, count(*) AS n, count(DISTINCT session_id) AS sessions, channel = role AS ok FROM transcript JOIN m ON contains(content, t) GROUP BY ALL""",
}
