"""Upstream attempts and client requests shaped from lineitem and orders, for the metrics.

One session per customer, one step per order, one attempt per line; the last attempt of a step is accepted unless the
step failed. All numbers are integers.
"""

from __future__ import annotations

#: Valid in Spark and DuckDB alike; reads the views ``orders`` and ``lineitem``.
UPSTREAM_SQL = """
SELECT o_custkey AS session_id, CAST(step AS BIGINT) AS step, CAST(attempt AS BIGINT) AS attempt, CAST(step * 100 + attempt AS BIGINT) AS seq,
       CASE WHEN o_orderkey % 5 = 0 THEN 'aux' ELSE 'main' END AS kind,
       CASE WHEN attempt < attempts THEN CASE l_suppkey % 3 WHEN 0 THEN 400 WHEN 1 THEN 429 ELSE 503 END WHEN o_orderkey % 23 = 0 THEN 500 ELSE 200 END AS status,
       CAST(1000 + l_partkey * 3 + step * 50 AS BIGINT) AS prompt, CAST(l_suppkey % 900 + 20 AS BIGINT) AS completion, CAST(4000 + l_partkey * 11 AS BIGINT) AS bytes,
       CAST(l_partkey + step * 10 AS BIGINT) AS lcp, CAST(l_suppkey % 40 AS BIGINT) AS ms, CAST(o_orderkey % 6 AS BIGINT) AS units
FROM (
  SELECT o_custkey, o_orderkey, l_partkey, l_suppkey,
         dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS attempt,
         count(*) OVER (PARTITION BY o_orderkey) AS attempts
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
) AS numbered
"""
