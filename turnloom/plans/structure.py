"""Structural queries over the derived message log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators import structure as s
from turnloom.sources.transcript import WITH_TRANSCRIPT, transcript


def _on_log(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(transcript(spark, sf_dir))


def latest_state(log: DataFrame) -> DataFrame:
    """The newest result of each tool, and whether it is among the last three messages."""
    r = log.where("role = 'tool'").withColumn("age", F.row_number().over(Window.partitionBy("session_id", "tool_name").orderBy(F.desc("idx")))).where("age = 1")
    n = log.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return r.join(n, "session_id").select("session_id", "tool_name", "idx", (F.col("idx") >= F.col("n") - 3).alias("in_tail"), F.length("content").cast("long").alias("chars"))


def retention(log: DataFrame) -> DataFrame:
    """Messages per disposition: verbatim in head and tail (four newest units), else by role and size."""
    placed = s.with_kept_start(log, 4)
    d = (
        F.when((F.col("idx") < F.col("h")) | (F.col("idx") >= F.col("start")), "verbatim")
        .when((F.col("role") == "tool") & (F.length("content") > 100), "excerpted")
        .when(F.length("content") > 0, "summarized")
        .otherwise("dropped")
    )
    counts = [F.count_if(F.col("d") == k).cast("long").alias(k) for k in ("verbatim", "excerpted", "summarized", "dropped")]
    return placed.withColumn("d", d).groupBy("session_id").agg(*counts)


def last_user(log: DataFrame) -> DataFrame:
    """The last user message that is no wrapped tool response."""
    real = (F.col("role") == "user") & ~F.trim("content").startswith("<tool_response>")
    return log.groupBy("session_id").agg(F.max(F.when(real, F.col("idx"))).alias("idx"))


_HEAD = f"""
head AS (
  SELECT session_id, count(*) AS n,
         CAST(coalesce(max(CASE WHEN idx < a AND NOT (role = 'user' AND starts_with(content, '{s.SUMMARY_HEADER}')) THEN idx + 1 END), 0) AS INTEGER) AS h
  FROM (SELECT *, coalesce(min(CASE WHEN role = 'assistant' THEN idx END) OVER (PARTITION BY session_id), count(*) OVER (PARTITION BY session_id)) AS a FROM transcript)
  GROUP BY session_id
)"""
_UNITS = f"""{_HEAD}, units AS (
  SELECT session_id, unit, min(idx) AS start, max(idx) + 1 AS stop,
         arg_min(CASE WHEN role = 'assistant' THEN 'assistant' WHEN role IN ('user', 'system', 'developer') THEN 'user' ELSE 'other' END, idx) AS kind
  FROM (SELECT t.*, CAST(sum(CASE WHEN role IN ('assistant', 'user', 'system', 'developer') OR idx = h THEN 1 ELSE 0 END)
          OVER (PARTITION BY t.session_id ORDER BY idx) AS BIGINT) AS unit
        FROM transcript t JOIN head USING (session_id) WHERE idx >= h)
  GROUP BY session_id, unit
)"""
_CALLS = """
calls AS (
  SELECT session_id, idx, 0 AS pos, call_id AS id, tool_name FROM transcript WHERE role = 'assistant' AND call_id IS NOT NULL
  UNION ALL SELECT session_id, idx, 1, call_id2, tool_name FROM transcript WHERE role = 'assistant' AND call_id2 IS NOT NULL
)"""
_KEPT = """
kept AS (
  SELECT head.session_id, coalesce(s, h) AS start FROM head LEFT JOIN (
    SELECT session_id, min(start) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start DESC) AS age FROM units WHERE kind = 'assistant') WHERE age <= 4
    GROUP BY session_id) USING (session_id)
)"""

QUERIES = {
    "w01_head_end": _on_log(s.head_end),
    "w02_units": _on_log(s.units),
    "w03_kept_start": _on_log(lambda log: s.kept_start(log, 4)),
    "w04_boundaries": _on_log(s.boundaries),
    "w05_pairing_defects": _on_log(s.pairing_defects),
    "w06_strict_defects": _on_log(s.strict_defects),
    "w08_superseded_snapshots": _on_log(s.superseded_snapshots),
    "w09_latest_state": _on_log(latest_state),
    "w11_cut_walk": _on_log(lambda log: s.cut_walk(log, F.length("content"), 1200)),
    "w20_tool_runs": _on_log(s.tool_runs),
    "w21_last_user": _on_log(last_user),
    "j01_asof_call_result": _on_log(s.call_for),
    "a10_retention": _on_log(retention),
}

SQL = {
    "w01_head_end": f"{WITH_TRANSCRIPT}, {_HEAD} SELECT session_id, n, h FROM head",
    "w02_units": f"{WITH_TRANSCRIPT}, {_UNITS} SELECT session_id, unit, start, stop, kind FROM units",
    "w03_kept_start": f"{WITH_TRANSCRIPT}, {_UNITS}, {_KEPT} SELECT session_id, start FROM kept",
    "w04_boundaries": f"""{WITH_TRANSCRIPT}
SELECT session_id, idx AS b FROM (SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY idx) AS before FROM transcript)
WHERE idx > 0 AND role = 'assistant' AND before <> 'assistant'
UNION ALL SELECT session_id, max(idx) + 1 FROM transcript GROUP BY 1""",
    "w05_pairing_defects": f"""{WITH_TRANSCRIPT}, {_CALLS}, seg AS (
  SELECT *, sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS segment FROM transcript
), last AS (SELECT session_id, max(segment) AS last FROM seg GROUP BY 1), t AS (
  SELECT session_id, segment, id, sum(c) AS c, sum(a) AS a FROM (
    SELECT session_id, segment, id, 1 AS c, 0 AS a FROM calls JOIN seg USING (session_id, idx)
    UNION ALL SELECT session_id, segment, call_id, 0, 1 FROM seg WHERE role = 'tool') GROUP BY 1, 2, 3
), d AS (
  SELECT session_id, 'orphan' AS kind, id, greatest(a - c, 0) AS n FROM t
  UNION ALL SELECT session_id, 'dup', id, greatest(c - 1, 0) FROM t
  UNION ALL SELECT session_id, 'unanswered', id, greatest(c - a, 0) FROM t JOIN last USING (session_id) WHERE segment < last
) SELECT session_id, kind, id, CAST(sum(n) AS BIGINT) AS n FROM d WHERE n > 0 GROUP BY 1, 2, 3""",
    "w06_strict_defects": f"""{WITH_TRANSCRIPT}, {_CALLS}, given AS (
  SELECT session_id, near, CAST(row_number() OVER (PARTITION BY session_id, near ORDER BY idx) - 1 AS INTEGER) AS k, call_id AS got
  FROM (SELECT *, max(CASE WHEN role <> 'tool' THEN idx END) OVER (PARTITION BY session_id ORDER BY idx) AS near FROM transcript) WHERE role = 'tool'
) SELECT coalesce(c.session_id, g.session_id) AS session_id, coalesce(c.idx, g.near) AS idx, CAST(coalesce(c.pos, g.k) AS INTEGER) AS k, id AS wanted, got
FROM calls c FULL JOIN given g ON c.session_id = g.session_id AND c.idx = g.near AND c.pos = g.k WHERE id IS DISTINCT FROM got""",
    "w08_superseded_snapshots": f"""{WITH_TRANSCRIPT}, n AS (
  SELECT *, sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS unit FROM transcript
), m AS (SELECT *, max(unit) OVER (PARTITION BY session_id) AS newest FROM n WHERE role = 'tool' AND tool_name = 'browser_snapshot')
SELECT session_id, idx FROM m WHERE unit < newest""",
    "w09_latest_state": f"""{WITH_TRANSCRIPT}, n AS (SELECT session_id, count(*) AS n FROM transcript GROUP BY 1)
SELECT session_id, tool_name, idx, idx >= n - 3 AS in_tail, length(content) AS chars FROM transcript JOIN n USING (session_id)
WHERE role = 'tool' QUALIFY row_number() OVER (PARTITION BY session_id, tool_name ORDER BY idx DESC) = 1""",
    "w11_cut_walk": f"""{WITH_TRANSCRIPT}, {_UNITS}, sized AS (
  SELECT u.session_id, unit, start, sum(length(content)) AS size FROM units u JOIN transcript t ON t.session_id = u.session_id AND idx >= start AND idx < stop GROUP BY ALL
), c AS (SELECT session_id, min(start) AS cut FROM (
  SELECT *, sum(size) OVER (PARTITION BY session_id ORDER BY unit DESC) AS s FROM sized) WHERE s <= 1200 GROUP BY 1)
SELECT session_id, coalesce(cut, max(idx) + 1) AS cut FROM transcript LEFT JOIN c USING (session_id) GROUP BY session_id, cut""",
    "w20_tool_runs": f"""{WITH_TRANSCRIPT}
SELECT session_id, idx, first, last FROM (
  SELECT *, lag(role) OVER w IS DISTINCT FROM 'tool' AS first, lead(role) OVER w IS DISTINCT FROM 'tool' AS last
  FROM transcript WINDOW w AS (PARTITION BY session_id ORDER BY idx)) WHERE role = 'tool'""",
    "w21_last_user": f"""{WITH_TRANSCRIPT}
SELECT session_id, max(CASE WHEN role = 'user' AND NOT starts_with(trim(content), '<tool_response>') THEN idx END) AS idx FROM transcript GROUP BY 1""",
    "j01_asof_call_result": f"""{WITH_TRANSCRIPT}, {_CALLS}
SELECT r.session_id, r.idx AS result_idx, r.call_id AS id, max(c.idx) AS call_idx, arg_max(c.tool_name, c.idx) AS tool_name
FROM transcript r LEFT JOIN calls c ON c.session_id = r.session_id AND c.id = r.call_id AND c.idx < r.idx
  AND NOT EXISTS (SELECT 1 FROM transcript u WHERE u.session_id = r.session_id AND u.idx > c.idx AND u.idx < r.idx AND u.role IN ('user', 'system', 'developer'))
WHERE r.role = 'tool' GROUP BY ALL""",
    "a10_retention": f"""{WITH_TRANSCRIPT}, {_UNITS}, {_KEPT}, d AS (
  SELECT session_id, CASE WHEN idx < h OR idx >= start THEN 'verbatim' WHEN role = 'tool' AND length(content) > 100 THEN 'excerpted'
         WHEN length(content) > 0 THEN 'summarized' ELSE 'dropped' END AS d
  FROM transcript JOIN head USING (session_id) JOIN kept USING (session_id)
) SELECT session_id, count(*) FILTER (WHERE d = 'verbatim') AS verbatim, count(*) FILTER (WHERE d = 'excerpted') AS excerpted,
  count(*) FILTER (WHERE d = 'summarized') AS summarized, count(*) FILTER (WHERE d = 'dropped') AS dropped FROM d GROUP BY 1""",
}
