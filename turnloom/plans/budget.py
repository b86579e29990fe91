"""Budget arithmetic over a grid of windows and replies, and over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import budget as b

#: Windows by replies; a null limit means that none has been learned.
GRID_SQL = """
SELECT w AS window, r AS reply, t AS tighten, CASE WHEN p = 0 THEN NULL ELSE CAST(w * p / 10 AS BIGINT) END AS max_prompt
FROM (SELECT 16000 AS w UNION ALL SELECT 32000 UNION ALL SELECT 64000 UNION ALL SELECT 100000 UNION ALL SELECT 128000 UNION ALL SELECT 200000 UNION ALL SELECT 256000) AS ws
CROSS JOIN (SELECT 1000 AS r UNION ALL SELECT 4096 UNION ALL SELECT 8192 UNION ALL SELECT 32000) AS rs
CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 256 UNION ALL SELECT 2560) AS ts
CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 5 UNION ALL SELECT 9) AS ps
"""
_COLUMNS = ("window", "reply", "tighten", "max_prompt")
SERVERS = ("vllm", "llamacpp", "lmstudio", "tgi", "ollama")


def grid(spark: SparkSession) -> DataFrame:
    g = spark.sql(GRID_SQL)
    return g.select(*(F.col(c).cast("long").alias(c) for c in _COLUMNS))


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = b.budget(*(F.col(c) for c in _COLUMNS))
    return grid(spark).select(*_COLUMNS, *(c.alias(k) for k, c in amounts.items()))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each budget and server, what a count of seven tenths of the window meets."""
    g = budgets(spark, sf_dir).where("max_prompt is null")
    g = g.withColumn("server", F.explode(F.array(*map(F.lit, SERVERS)))).withColumn("counts", F.when(F.col("tighten") == 256, F.lit(True)).when(F.col("tighten") == 2560, F.lit(False)))
    g = g.withColumns({"mode": b.mode(F.col("server"), F.col("counts")), "count": F.floor(F.col("window") * 7 / 10).cast("long"), "limit": F.col("window") - F.col("margin") - F.col("tighten")})
    m, c, r, limit = (F.col(x) for x in ("mode", "count", "reply", "limit"))
    clamp = b.clamp_clause(m, c, limit, F.col("allowance"), F.col("client_point"))
    fits = (c <= F.least("trigger", "budget")) | clamp
    clamped = clamp & ~(c <= F.least("trigger", "budget"))
    value, kind = b.forwarded_reply(m, c, r, limit, clamped, F.lit(6000))
    return g.select("window", "reply", "tighten", "server", "mode", b.server_fits(m, c, r, limit).alias("server_fits"), fits.alias("fits"), value.alias("forwarded"), kind.alias("kind"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 2001).withColumn("percent", F.lit(100) + F.col("id") % 7 * 5)
    c = b.corrected(F.col("id") * 37, F.col("percent"))
    return n.select("id", "percent", c.alias("corrected"), b.uncorrected(c, F.col("percent")).alias("raw"), b.tightened(F.lit(512), F.col("id") * 40, F.col("id") * 37, F.lit(4096)).alias("tighten"))


QUERIES = {"m02_budget_grid": budgets, "m07_reply_decisions": decisions, "m10_corrections": corrections}

_BUDGET = f"""
WITH g AS (SELECT CAST("window" AS BIGINT) AS "window", CAST(reply AS BIGINT) AS reply, CAST(tighten AS BIGINT) AS tighten, CAST(max_prompt AS BIGINT) AS max_prompt FROM ({GRID_SQL.replace('AS window', 'AS "window"')})),
a AS (SELECT *, greatest(512, CAST(ceil("window" * CAST(0.01 AS DOUBLE) - 1e-9) AS BIGINT)) AS margin, "window" - least(reply, 32000) AS client_point, least(7000, reply // 2) AS allowance FROM g),
r AS (SELECT *, least("window" - reply - margin, coalesce(max_prompt - margin, 9000000000)) - tighten AS budget FROM a),
h AS (SELECT *, least(budget, client_point - allowance) AS hard FROM r),
t AS (SELECT *, hard AS trigger FROM h),
budgets AS (SELECT *, least(CAST(floor(trigger * CAST(0.35 AS DOUBLE) + 1e-9) AS BIGINT), trigger - 1) AS target,
  greatest(0, least(CAST(floor(budget * CAST(0.04 AS DOUBLE) + 1e-9) AS BIGINT), CAST(floor(budget * CAST(0.25 AS DOUBLE) + 1e-9) AS BIGINT))) AS summary_budget,
  budget - CAST(floor(budget * CAST(0.04 AS DOUBLE) + 1e-9) AS BIGINT) - CAST(floor(budget * CAST(0.25 AS DOUBLE) + 1e-9) AS BIGINT) AS head_room FROM t)
"""

SQL = {
    "m02_budget_grid": f'{_BUDGET} SELECT "window", reply, tighten, max_prompt, CAST(margin AS BIGINT) AS margin, CAST(budget AS BIGINT) AS budget, CAST(client_point AS BIGINT) AS client_point, CAST(allowance AS BIGINT) AS allowance, CAST(hard AS BIGINT) AS hard, CAST(trigger AS BIGINT) AS trigger, CAST(target AS BIGINT) AS target, CAST(summary_budget AS BIGINT) AS summary_budget, CAST(head_room AS BIGINT) AS head_room FROM budgets',
    "m07_reply_decisions": f"""{_BUDGET}, s AS (
  SELECT *, "window" * 7 // 10 AS count, "window" - margin - tighten AS "limit", CASE
    WHEN tighten = 256 THEN CASE WHEN server = 'tgi' THEN 'tgi' ELSE 'strict_total' END
    WHEN tighten = 2560 THEN CASE WHEN server = 'ollama' THEN 'silent_truncate' ELSE 'prompt_only' END
    WHEN server IN ('llamacpp', 'lmstudio') THEN 'prompt_only' WHEN server = 'tgi' THEN 'tgi' WHEN server = 'ollama' THEN 'silent_truncate' ELSE 'strict_total' END AS mode
  FROM budgets CROSS JOIN (SELECT unnest(['vllm', 'llamacpp', 'lmstudio', 'tgi', 'ollama']) AS server) WHERE max_prompt IS NULL
), c AS (
  SELECT *, mode = 'strict_total' AND count <= "limit" - 1024 AND count + allowance < client_point AS clamp, count <= least(trigger, budget) AS small,
    "limit" - count AS room, (mode = 'strict_total' AND count + reply > "limit") OR (mode = 'tgi' AND count + least(reply, 1024) > "limit") AS over FROM s
), k AS (
  SELECT *, CASE WHEN clamp AND NOT small THEN CASE WHEN room < reply THEN 'clamp' ELSE 'unchanged' END WHEN over THEN 'fit'
    WHEN reply < 6000 AND least(6000, room) > reply THEN 'restore' ELSE 'unchanged' END AS kind FROM c
) SELECT "window", reply, tighten, server, mode, CASE mode WHEN 'strict_total' THEN count + reply <= "limit" WHEN 'tgi' THEN count + least(reply, 1024) <= "limit" ELSE count <= "limit" END AS server_fits,
  small OR clamp AS fits, CAST(CASE kind WHEN 'clamp' THEN room WHEN 'fit' THEN room WHEN 'restore' THEN least(6000, room) ELSE reply END AS BIGINT) AS forwarded, kind FROM k""",
    "m10_corrections": """WITH n AS (SELECT CAST(range AS BIGINT) AS id, 100 + range % 7 * 5 AS percent FROM range(1, 2001)),
c AS (SELECT *, CAST(CASE WHEN percent = 100 THEN id * 37 ELSE (id * 37 * percent + 99) // 100 END AS BIGINT) AS corrected FROM n)
SELECT id, CAST(percent AS BIGINT) AS percent, corrected, CAST(CASE WHEN percent = 100 THEN corrected ELSE (corrected * 100 + percent - 1) // percent END AS BIGINT) AS raw,
  CAST(least(4096, greatest(512, ceil((id * 40 - floor(id * 37 * CAST(0.95 AS DOUBLE) + 1e-9)) / 256) * 256)) AS BIGINT) AS tighten FROM c""",
}
