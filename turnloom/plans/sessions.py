"""Queries over the message log: repeats, references, ranking, orders, dispositions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text
from turnloom.operators import structure as s
from turnloom.plans.structure import _CALLS, _KEPT, _UNITS
from turnloom.sources.transcript import WITH_TRANSCRIPT, transcript

ERROR = r"(?i)\b(?:error|errors|exception|traceback|fatal|failed|failure|failures)\b"


def is_error(t: Column) -> Column:
    """The text speaks of an error, a tally of none aside."""
    return F.regexp_replace(t, r"(?i)\b0 (?:errors?|failed|failures?)\b", "").rlike(ERROR)


def first_answers(log: DataFrame) -> DataFrame:
    """Each call with the first result of its id behind it."""
    made = s.calls(log).select("session_id", F.col("idx").alias("call_idx"), "id")
    given = log.where("role = 'tool'").groupBy("session_id", F.col("call_id").alias("id")).agg(F.min("idx").alias("result_idx"))
    return made.join(given, ["session_id", "id"]).where("result_idx > call_idx").select("session_id", "call_idx", "result_idx").distinct()


def repeats(log: DataFrame) -> DataFrame:
    """Each message that the same role says again, and where next: one sort, no pairs."""
    said = log.where("content <> ''").withColumn("norm", F.lower(F.trim("content")))
    again = F.lead("idx").over(Window.partitionBy("session_id", "role", "norm").orderBy("idx"))
    return said.withColumn("repeated", again).where("repeated is not null").select("session_id", "idx", "repeated")


def paths(log: DataFrame) -> DataFrame:
    """Where a path is named: in the arguments of a call, or at the head of a result (then at its call's message)."""
    told = log.where("role = 'assistant' and arguments is not null").select("session_id", "idx", F.get_json_object("arguments", "$.path").alias("path")).where("path is not null")
    heads = log.where("role = 'tool'").select("session_id", "idx", F.regexp_extract("content", r"^((?:[\w.@-]+/)+[\w.@-]+\.[A-Za-z0-9]{1,8})", 1).alias("path")).where("path <> ''")
    calls = s.call_for(log).select("session_id", F.col("result_idx").alias("idx"), "call_idx")
    heads = heads.join(calls, ["session_id", "idx"]).select("session_id", F.coalesce("call_idx", "idx").alias("idx"), "path")
    return told.unionByName(heads).withColumn("key", text.path_key(F.col("path")))


def later_references(log: DataFrame) -> DataFrame:
    """Calls that name a path, with the number of later messages that name the same file, however it is spelt."""
    p = paths(log)
    item = p.join(log.where("role = 'assistant' and arguments like '%\"path\"%'").select("session_id", "idx"), ["session_id", "idx"], "left_semi").select("session_id", "idx", "key", "path").distinct()
    other = p.select("session_id", "key", F.col("idx").alias("at"), F.col("path").alias("other"))
    met = item.join(other, ["session_id", "key"]).where((F.col("at") > F.col("idx")) & text.same_path(F.col("path"), F.col("other")))
    return met.groupBy("session_id", "idx").agg(F.count_distinct("at").alias("later"))


def ranking(log: DataFrame) -> DataFrame:
    """For each call what ranks it among its like: an earlier copy of a later one, an error, later references, age."""
    calls = log.where("role = 'assistant' and call_id is not null")
    newest = F.max("idx").over(Window.partitionBy("session_id", "tool_name", "arguments"))
    bad = log.where("role = 'tool'").where(is_error(F.col("content"))).select("session_id", F.col("idx").alias("result_idx"))
    err = s.call_for(log).join(bad, ["session_id", "result_idx"]).select("session_id", F.col("call_idx").alias("idx"), F.lit(0).alias("no_error")).distinct()
    c = calls.select("session_id", "idx", (F.col("idx") < newest).cast("int").alias("is_older_copy"))
    c = c.join(err, ["session_id", "idx"], "left").join(later_references(log), ["session_id", "idx"], "left")
    return c.select("session_id", "idx", "is_older_copy", F.coalesce("no_error", F.lit(1)).alias("no_error"), (-F.coalesce("later", F.lit(0))).alias("neg_later"), (-F.col("idx")).alias("neg_idx"))


def item_order(log: DataFrame) -> DataFrame:
    """The total order of calls: by category, then the ranking as one array, then place."""
    r = ranking(log).join(log.select("session_id", "idx", "tool_name"), ["session_id", "idx"])
    category = F.when(F.col("tool_name") == "read_file", 0).when(F.col("tool_name") == "run_tests", 1).otherwise(2)
    rank = F.array(*(F.col(c).cast("long") for c in ("is_older_copy", "no_error", "neg_later", "neg_idx")))
    order = Window.partitionBy("session_id").orderBy("category", "rank", "idx")
    return r.withColumns({"category": category, "rank": rank}).withColumn("place", F.row_number().over(order).cast("long")).select("session_id", "idx", "category", "place")


def largest_first(log: DataFrame, most: int = 6) -> DataFrame:
    """The largest results of each session, ties to the lower index."""
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.length("content")), "idx"))
    return log.where("role = 'tool'").withColumn("r", r.cast("long")).where(F.col("r") <= most).select("session_id", "idx", "r")


def first_seen(log: DataFrame) -> DataFrame:
    """Each session's tools in the order of their first use."""
    f = log.where("tool_name is not null").groupBy("session_id", "tool_name").agg(F.min("idx").alias("first_idx"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("first_idx", "tool_name")))


def event_stream(log: DataFrame) -> DataFrame:
    """Calls and results as one stream in order."""
    made = s.calls(log).select("session_id", "idx", "pos", F.lit("call").alias("kind"), "id")
    given = log.where("role = 'tool'").select("session_id", "idx", F.lit(0).alias("pos"), F.lit("result").alias("kind"), F.col("call_id").alias("id"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("idx", "pos")).cast("long")
    return made.unionByName(given).withColumn("n", n).select("session_id", "n", "idx", "kind", "id")


def dispositions(log: DataFrame) -> DataFrame:
    """What becomes of each message when all before the four newest units is summarized.

    Kept as it is, replaced by an excerpt (stale snapshots in the tail), said in the summary (text, calls, and results of
    calls that are), or dropped.
    """
    placed = s.with_kept_start(log, 4)
    stale = s.superseded_snapshots(log).select("session_id", "idx", F.lit(True).alias("stale"))
    answered = s.call_for(log).where("call_idx is not null").select("session_id", F.col("result_idx").alias("idx"), F.lit(True).alias("paired"))
    d = placed.join(stale, ["session_id", "idx"], "left").join(answered, ["session_id", "idx"], "left")
    kept = (F.col("idx") < F.col("h")) | (F.col("idx") >= F.col("start"))
    said = (F.length("content") > 0) & (F.col("role") != "tool") | F.col("call_id").isNotNull() & (F.col("role") == "assistant") | F.coalesce("paired", F.lit(False))
    what = F.when(kept & F.coalesce("stale", F.lit(False)), "excerpted").when(kept, "verbatim").when(said, "summarized").otherwise("dropped")
    return d.select("session_id", "idx", what.alias("disposition"))


def marker_search(log: DataFrame) -> DataFrame:
    """Messages of a session that name its order, and those that name its customer's staging area."""
    order = F.col("content").contains(F.concat(F.lit("ORD-"), F.col("session_id").cast("string")))
    return log.groupBy("session_id").agg(F.count_if(order).alias("orders"), F.count_if(F.col("content").contains("staging area")).alias("areas")).where("orders > 0 or areas > 0")


def _on(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(transcript(spark, sf_dir))


QUERIES = {
    "j02_unique_id_pairs": _on(first_answers), "j08_repeats": _on(repeats), "j16_later_references": _on(later_references), "w19_ranking_signals": _on(ranking), "t01_item_order": _on(item_order), "t03_largest_first": _on(largest_first),
    "s05_first_seen": _on(first_seen), "s07_event_stream": _on(event_stream), "x23_dispositions": _on(dispositions), "x27_marker_search": _on(marker_search),
}

_ANSWER = """answer AS (
  SELECT r.session_id, r.idx, r.content, (SELECT max(c.idx) FROM calls c WHERE c.session_id = r.session_id AND c.id = r.call_id AND c.idx < r.idx
    AND NOT EXISTS (SELECT 1 FROM transcript u WHERE u.session_id = r.session_id AND u.role IN ('user', 'system', 'developer') AND u.idx > c.idx AND u.idx < r.idx)) AS call_idx FROM transcript r WHERE r.role = 'tool'
)"""
_STEM = "regexp_replace({0}, '^(?:\\./)+', '')"
_REFS = f"""{WITH_TRANSCRIPT}, {_CALLS}, {_ANSWER}, named AS (
  SELECT session_id, idx, true AS own, {_STEM.format("arguments->>'path'")} AS path FROM transcript WHERE role = 'assistant' AND arguments->>'path' IS NOT NULL
  UNION ALL SELECT session_id, coalesce(call_idx, idx), false, {_STEM.format("regexp_extract(content, '^((?:[\\w.@-]+/)+[\\w.@-]+\\.[A-Za-z0-9]{1,8})', 1)")} FROM answer WHERE regexp_matches(content, '^((?:[\\w.@-]+/)+[\\w.@-]+\\.[A-Za-z0-9]{{1,8}})')
), refs AS (
  SELECT a.session_id, a.idx, count(DISTINCT b.idx) AS later FROM named a JOIN named b ON a.session_id = b.session_id AND b.idx > a.idx AND (a.path = b.path OR ends_with(a.path, '/' || b.path) AND contains(b.path, '/') OR ends_with(b.path, '/' || a.path) AND contains(a.path, '/'))
  WHERE a.idx IN (SELECT idx FROM named n WHERE n.session_id = a.session_id AND n.own) GROUP BY 1, 2
)""".replace("{1,8})', 1)\")", "{1,8})', 1)")
_RANK = f"""{_REFS}, bad AS (
  SELECT DISTINCT session_id, call_idx AS idx FROM answer WHERE regexp_matches(regexp_replace(content, '\\b0 (?:errors?|failed|failures?)\\b', '', 'gi'), '\\b(?:error|errors|exception|traceback|fatal|failed|failure|failures)\\b', 'i')
), ranked AS (
  SELECT t.session_id, t.idx, t.tool_name, CASE WHEN EXISTS (SELECT 1 FROM transcript u WHERE u.session_id = t.session_id AND u.role = 'assistant' AND u.call_id IS NOT NULL AND u.idx > t.idx AND u.tool_name = t.tool_name AND u.arguments = t.arguments) THEN 1 ELSE 0 END AS is_older_copy,
    CASE WHEN b.idx IS NULL THEN 1 ELSE 0 END AS no_error, -coalesce(r.later, 0) AS neg_later, -t.idx AS neg_idx
  FROM transcript t LEFT JOIN bad b ON b.session_id = t.session_id AND b.idx = t.idx LEFT JOIN refs r ON r.session_id = t.session_id AND r.idx = t.idx WHERE t.role = 'assistant' AND t.call_id IS NOT NULL
)"""

SQL = {
    "j02_unique_id_pairs": f"""{WITH_TRANSCRIPT}, {_CALLS} SELECT DISTINCT c.session_id, c.idx AS call_idx, r.idx AS result_idx FROM calls c JOIN transcript r ON r.session_id = c.session_id AND r.call_id = c.id AND r.role = 'tool' AND r.idx > c.idx
  WHERE NOT EXISTS (SELECT 1 FROM transcript q WHERE q.session_id = r.session_id AND q.role = 'tool' AND q.call_id = r.call_id AND q.idx < r.idx)""",
    "j08_repeats": f"""{WITH_TRANSCRIPT} SELECT a.session_id, a.idx, min(b.idx) AS repeated FROM transcript a JOIN transcript b ON a.session_id = b.session_id AND lower(trim(a.content)) = lower(trim(b.content)) AND a.idx < b.idx AND a.role = b.role WHERE a.content <> '' GROUP BY 1, 2""",
    "j16_later_references": f"{_REFS} SELECT * FROM refs",
    "w19_ranking_signals": f"{_RANK} SELECT session_id, idx, is_older_copy, no_error, neg_later, neg_idx FROM ranked",
    "t01_item_order": f"""{_RANK}, c AS (SELECT *, CASE tool_name WHEN 'read_file' THEN 0 WHEN 'run_tests' THEN 1 ELSE 2 END AS category FROM ranked) SELECT session_id, idx, category, row_number() OVER (PARTITION BY session_id ORDER BY category, is_older_copy, no_error, neg_later, neg_idx, idx) AS place FROM c""",
    "t03_largest_first": f"{WITH_TRANSCRIPT} SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY length(content) DESC, idx) AS r FROM transcript WHERE role = 'tool' QUALIFY r <= 6",
    "s05_first_seen": f"""{WITH_TRANSCRIPT}, f AS (SELECT session_id, tool_name, min(idx) AS first_idx FROM transcript WHERE tool_name IS NOT NULL GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY first_idx, tool_name) AS INTEGER) AS place FROM f""",
    "s07_event_stream": f"""{WITH_TRANSCRIPT}, {_CALLS}, e AS (SELECT session_id, idx, pos, 'call' AS kind, id FROM calls UNION ALL SELECT session_id, idx, 0, 'result', call_id FROM transcript WHERE role = 'tool') SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx, pos) AS n, idx, kind, id FROM e""",
    "x23_dispositions": f"""{WITH_TRANSCRIPT}, {_UNITS}, {_KEPT}, {_CALLS}, {_ANSWER}, shots AS (SELECT session_id, idx, (SELECT count(*) FROM transcript p WHERE p.session_id = t.session_id AND p.role <> 'tool' AND p.idx <= t.idx) AS unit FROM transcript t WHERE role = 'tool' AND tool_name = 'browser_snapshot'),
stale AS (SELECT session_id, idx FROM shots a WHERE EXISTS (SELECT 1 FROM shots b WHERE b.session_id = a.session_id AND b.unit > a.unit))
SELECT t.session_id, t.idx, CASE WHEN (t.idx < h OR t.idx >= start) AND EXISTS (SELECT 1 FROM stale s WHERE s.session_id = t.session_id AND s.idx = t.idx) THEN 'excerpted' WHEN t.idx < h OR t.idx >= start THEN 'verbatim'
  WHEN t.role <> 'tool' AND (t.content <> '' OR t.call_id IS NOT NULL) OR EXISTS (SELECT 1 FROM answer a WHERE a.session_id = t.session_id AND a.idx = t.idx AND a.call_idx IS NOT NULL) THEN 'summarized' ELSE 'dropped' END AS disposition
FROM transcript t JOIN head ON head.session_id = t.session_id JOIN kept ON kept.session_id = t.session_id""",
    "x27_marker_search": f"""{WITH_TRANSCRIPT}, c AS (SELECT session_id, count(*) FILTER (WHERE content LIKE '%ORD-' || session_id || '%') AS orders, count(*) FILTER (WHERE content LIKE '%staging area%') AS areas FROM transcript GROUP BY 1) SELECT * FROM c WHERE orders > 0 OR areas > 0""",
}
