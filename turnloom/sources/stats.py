"""Request-log records (one row per request) shaped from the events table.

Columns: seq, ts, session, action, client_status, tokens_in, tokens_out, attempts (array of status and kind), shadow,
upstream_incomplete, compacted, transient_retries. Every number is derived from integers, so that both engines agree.
"""

from __future__ import annotations

#: Valid in Spark and DuckDB alike; reads the view ``events``.
STATS_SQL = """
SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR(32)) AS session,
       CASE event_id % 11 WHEN 0 THEN 'compact' WHEN 1 THEN 'reuse' WHEN 2 THEN 'admit' WHEN 3 THEN 'truncate'
            WHEN 4 THEN 'impossible' WHEN 5 THEN 'guard_reject' ELSE 'passthrough' END AS action,
       CASE WHEN event_id % 41 = 0 THEN 599 WHEN event_id % 13 = 0 THEN 429 WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS client_status,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) + 1000 END AS tokens_in,
       CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(floor(value * 60) AS BIGINT) + 500 END AS tokens_out,
       CASE WHEN event_id % 11 IN (4, 5) THEN 0 ELSE 1 + event_id % 3 END AS n_attempts,
       CASE WHEN event_id % 13 = 0 THEN 429 WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS last_status,
       event_id % 19 = 0 AS shadow, event_id % 37 = 0 AS upstream_incomplete, event_id % 11 = 0 AS compacted,
       event_id % 23 AS transient_retries
FROM events
"""
