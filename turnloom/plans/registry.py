"""All queries of the transcript engine and, where SQL expresses them, their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.plans import budget, learned, ledger, logs, metrics, report, runs, sequential, sessions, structure, text, traffic, wire

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for module in (report, traffic, structure, sessions, text, budget, metrics, runs, logs, wire, ledger, learned, sequential):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
