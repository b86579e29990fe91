"""Facts, ledger and summaries of the derived message log, with SQL written apart for the second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import facts
from turnloom.operators.structure import SUMMARY_HEADER
from turnloom.plans.sessions import _ANSWER
from turnloom.plans.structure import _CALLS, _KEPT, _UNITS
from turnloom.sources.transcript import WITH_TRANSCRIPT, log, sessions, transcript

#: Newest units kept, and cost that a summary may have, in these queries.
KEEP, BUDGET = 2, 60


def _on(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(transcript(spark, sf_dir))


def _rows(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Of sessions' rows, whose messages are made where they are read: lines travel once, and nothing is written."""
    place = lambda x, i: F.struct(i.alias("idx"), *(x[k].alias(k) for k in facts.FIELDS[1:]))
    return lambda spark, sf_dir: f(sessions(spark, sf_dir).select("session_id", F.transform("messages", place).alias("messages")))


def todo_lists(log: DataFrame) -> DataFrame:
    """A todo list made of each session's tagged points, in two spellings, its closure and its size."""
    point = F.concat(F.lit("- ["), F.when(F.col("idx") % 3 == 0, "x").when(F.col("idx") % 3 == 1, " ").otherwise("~"), F.lit("] "), F.regexp_replace("content", r"\.$", ""))
    state = F.when(F.col("idx") % 3 == 0, "done").when(F.col("idx") % 3 == 1, "pending").otherwise("canceled")
    entry = F.to_json(F.struct(F.col("content"), state.alias("status")))
    rows = log.where("role = 'assistant' and content like 'TODO:%'").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", point.alias("m"), entry.alias("j")))).alias("l"))
    value = F.when(F.col("session_id") % 2 == 0, F.array_join(F.transform("l", lambda x: x["m"]), "\n")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")))
    items = facts.todos(value)
    return rows.select("session_id", F.size(items).cast("long").alias("items"), facts.todo_closure(items).alias("closed"))


QUERIES = {
    "x14_user_facts": _on(lambda log: facts.user_facts(log).select("session_id", "idx", "fact", F.length("text").cast("long").alias("chars"))),
    "x15_said": _on(lambda log: facts.said(log).where("kind <> 'rest' or text <> ''").select("session_id", "idx", "kind", "text")),
    "x16_call_facts": _on(lambda log: facts.call_facts(log).select("session_id", "idx", "key_args", "path", "action", "url", "test")),
    "x09_result_kinds": _on(lambda log: facts.result_facts(log).select("session_id", "idx", "call_idx", "kind", "condensed")),
    "x20_ledger_items": _rows(lambda rows: facts.ordered(facts.listed(rows, KEEP)).select("session_id", "id", "category", "section", "place", "line")),
    "w12_prefix_cut": _rows(lambda rows: facts.kept(facts.listed(rows, KEEP), BUDGET, False).groupBy("session_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.max(F.when(F.col("kept"), F.col("spent"))).alias("spent"))),
    "x22_summaries": _rows(lambda rows: facts.summed_up(rows, KEEP, BUDGET, False)),
    "as_assembled": _rows(lambda rows: facts.put_together(rows, BUDGET, KEEP).select("session_id", "pos", "origin", "role", F.md5("content").alias("digest"))),
    "a29_todo_closure": _on(todo_lists),
    "x21_user_items": lambda spark, sf_dir: facts.user_items(log(spark, sf_dir, "role", "content", role="user")),
}

_FACTS = f"""{WITH_TRANSCRIPT}, {_UNITS}, {_KEPT.replace("age <= 4", f"age <= {KEEP}")}, {_CALLS}, {_ANSWER}, calls1 AS (
  SELECT session_id, idx, tool_name, coalesce(arguments->>'path', arguments->>'url', '`' || (arguments->>'command') || '`') AS key_args, arguments->>'path' AS path, CASE WHEN arguments->>'path' IS NOT NULL THEN 'read' END AS action, arguments->>'url' AS url,
    coalesce((arguments->>'command') LIKE 'npm test%', false) AS test FROM transcript WHERE role = 'assistant' AND call_id IS NOT NULL
), results AS (
  SELECT a.session_id, a.idx, a.call_idx, CASE WHEN (length(content) - length(replace(content, '[ref=', ''))) / 5 >= 10 THEN 'snapshot' WHEN c.test OR (c.idx IS NULL OR c.tool_name = 'run_tests') AND regexp_matches(content, '\\b\\d+ (passed|failed)\\b') THEN 'test' ELSE 'other' END AS kind, content
  FROM answer a LEFT JOIN calls1 c ON c.session_id = a.session_id AND c.idx = a.call_idx
), short AS (
  SELECT session_id, idx, call_idx, kind, CASE kind WHEN 'snapshot' THEN 'page ' || regexp_extract(content, 'Page URL: (\\S+)', 1) || ' (' || regexp_extract(content, 'Page Title: ([^\\n]*)', 1) || '), ' || CAST((length(content) - length(replace(content, '[ref=', ''))) // 5 AS VARCHAR) || ' refs'
    WHEN 'test' THEN regexp_extract(content, '(\\d+ passed, \\d+ failed)', 1) ELSE regexp_replace(content, '\\s+', ' ', 'g') END AS condensed FROM results
), short2 AS (SELECT * REPLACE (trim(condensed) AS condensed) FROM short)"""
_SAID = """said AS (
  SELECT session_id, idx, CASE WHEN content LIKE 'DECISION:%' THEN 'decision' WHEN content LIKE 'TODO:%' THEN 'todo' ELSE 'rest' END AS kind, content AS text FROM transcript WHERE role = 'assistant' AND content <> ''
)"""
_ITEMS = f"""{_FACTS}, {_SAID}, stems AS (
  SELECT session_id, idx, path, regexp_replace(path, '^(?:\\./)+', '') AS stem, regexp_extract(regexp_replace(path, '^(?:\\./)+', ''), '([^/]+/[^/]+)$', 1) AS key FROM calls1 WHERE path IS NOT NULL
), longest AS (SELECT session_id, key, arg_max(path, length(path) * 1000000 + idx) AS path FROM (SELECT session_id, key, path, max(idx) AS idx FROM stems GROUP BY ALL) GROUP BY 1, 2),
files AS (
  SELECT s.session_id, l.path, max(s.idx) AS idx, min(s.idx) AS first FROM stems s JOIN longest l ON l.session_id = s.session_id AND l.key = s.key
  WHERE ends_with('/' || regexp_replace(l.path, '^(?:\\./)+', ''), '/' || s.stem) OR ends_with('/' || s.stem, '/' || regexp_replace(l.path, '^(?:\\./)+', '')) GROUP BY 1, 2
), ledger AS (
  SELECT session_id, 'u:' || idx AS id, 1 AS c, 'user' AS category, 'user' AS section, idx, [idx] AS rank, [idx] AS pos, '- #' || idx || ': ' || content AS line FROM transcript WHERE role = 'user'
  UNION ALL SELECT session_id, left(kind, 1) || ':' || idx || ':0', CASE kind WHEN 'decision' THEN 2 ELSE 3 END, kind, CASE kind WHEN 'decision' THEN 'decisions' ELSE 'todos' END, idx, CASE kind WHEN 'decision' THEN [-idx, 0] ELSE [-idx, 1, 0] END, CASE kind WHEN 'decision' THEN [idx, 0] ELSE [idx, 1, 0] END, '- #' || idx || ': ' || text FROM said WHERE kind <> 'rest'
  UNION ALL SELECT session_id, 'v:' || idx, 7, 'narrative2', 'notes', idx, [-idx, 0], [2, idx, 0], '- #' || idx || ': ' || text FROM said WHERE kind = 'rest'
  UNION ALL SELECT c.session_id, 'g:' || c.idx || ':0', 8, 'toolLog', 'log', c.idx, [-c.idx, 0], [c.idx, 0], '- #' || c.idx || ' ' || tool_name || ' ' || key_args || ' → ' || coalesce((SELECT arg_min(condensed, s.idx) FROM short2 s WHERE s.session_id = c.session_id AND s.call_idx = c.idx), '(no result)') FROM calls1 c
  UNION ALL SELECT session_id, 'f:' || path, 4, 'file', 'files', idx, [-idx], [first], '- ' || path || ' (read, #' || idx || ')' FROM files
  UNION ALL SELECT session_id, CASE kind WHEN 'test' THEN 'x:' ELSE 'b:' END || max(idx), 5, 'rest', CASE kind WHEN 'test' THEN 'test' ELSE 'browser' END, max(idx), [0, -max(idx)], [0], '- #' || max(idx) || ': ' || arg_max(condensed, idx) FROM short2 WHERE kind <> 'other' GROUP BY session_id, kind
), items AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.session_id ORDER BY c, rank, l.idx, id) AS place FROM ledger l JOIN head ON head.session_id = l.session_id JOIN kept ON kept.session_id = l.session_id WHERE l.idx >= h AND l.idx < start
), spent AS (SELECT *, CAST(sum(length(line) // 4 + 1) OVER (PARTITION BY session_id ORDER BY place) AS BIGINT) AS spent FROM items),
chosen AS (SELECT *, category = 'user' OR spent <= {BUDGET} AS stays FROM spent)"""
_SECTIONS = ", ".join(f"('{k}', {n}, '{v}')" for n, (k, v) in enumerate(facts.SECTIONS.items(), 1))
_TEXTS = f"""{_ITEMS}, sections(section, n, heading) AS (VALUES {_SECTIONS}), blocks AS (
  SELECT session_id, n, any_value(heading) || chr(10) || string_agg(line, chr(10) ORDER BY pos, idx, id) AS block FROM chosen JOIN sections USING (section) WHERE stays GROUP BY 1, 2
), texts AS (
  SELECT c.session_id, count(*) FILTER (WHERE stays) AS kept, count(*) FILTER (WHERE NOT stays) AS dropped, '{SUMMARY_HEADER}' || chr(10) || chr(10) || coalesce((SELECT string_agg(block, chr(10) ORDER BY n) FROM blocks b WHERE b.session_id = c.session_id), '') AS text FROM chosen c GROUP BY 1
)"""

SQL = {
    "x14_user_facts": f"{WITH_TRANSCRIPT} SELECT session_id, idx, trim(content) <> '' AND NOT starts_with(content, '{SUMMARY_HEADER}') AS fact, length(trim(content)) AS chars FROM transcript WHERE role = 'user'",
    "x15_said": f"{WITH_TRANSCRIPT}, {_SAID} SELECT session_id, idx, kind, text FROM said",
    "x16_call_facts": f"{_FACTS} SELECT session_id, idx, key_args, path, action, url, test FROM calls1",
    "x09_result_kinds": f"{_FACTS} SELECT session_id, idx, call_idx, kind, condensed FROM short2",
    "x20_ledger_items": f"{_ITEMS} SELECT session_id, id, category, section, place, line FROM items",
    "w12_prefix_cut": f"{_ITEMS} SELECT session_id, count(*) FILTER (WHERE stays) AS kept, count(*) FILTER (WHERE NOT stays) AS dropped, max(spent) FILTER (WHERE stays) AS spent FROM chosen GROUP BY 1",
    "x22_summaries": f"{_TEXTS} SELECT session_id, kept, dropped, text FROM texts",
    "x21_user_items": f"{WITH_TRANSCRIPT} SELECT session_id, idx, trim(content) AS body, CASE WHEN idx = 0 THEN '' ELSE '(amends the task)' END AS suffix FROM transcript WHERE role = 'user'",
    "a29_todo_closure": f"""{WITH_TRANSCRIPT}, c AS (SELECT session_id, count(*) AS items, count(*) FILTER (WHERE idx % 3 = 0) AS done, count(*) FILTER (WHERE idx % 3 = 2 AND session_id % 2 = 1) AS gone FROM transcript WHERE role = 'assistant' AND content LIKE 'TODO:%' GROUP BY 1)
SELECT session_id, items, CASE WHEN done + gone > 0 THEN concat_ws(', ', CASE WHEN done > 0 THEN done || ' completed' END, CASE WHEN gone > 0 THEN gone || ' cancelled' END) END AS closed FROM c""",
}
