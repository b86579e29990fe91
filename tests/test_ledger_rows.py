"""The ledger and its summaries within a session's row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as t
from turnloom.operators import facts
from turnloom.operators import structure as s
from turnloom.plans.registry import QUERIES

LOG = "session_id long, idx int, role string, content string, call_id string, call_id2 string, tool_name string, arguments string"


@pytest.mark.parametrize("name", ["x22_summaries", "as_assembled", "x20_ledger_items", "w12_prefix_cut"])
def test_ledger_is_not_dealt_out_or_written(spark, small, monkeypatch, name):
    """Lines and orders travel once; what a summary is made from stays within its session's row, and nothing is written."""
    from turnloom.sources import store

    monkeypatch.setattr(store, "_written", {})
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(session_id") == 1 and "Join" not in plan and plan.count("Exchange") == 1
    assert not store._written


def test_calls_of_results_in_any_session(spark):
    """Calls found within the row, the quick way and by search, are those that the rows of the log give."""
    rnd, rows = random.Random(2), []
    for session in range(200):
        ids = [f"c{k}" for k in range(3)]
        for i in range(rnd.randint(1, 14)):
            role = rnd.choices(["user", "assistant", "tool", "function"], [1, 5, 6, 1])[0]
            # in every other session each call has an id of its own, and results answer the latest
            latest = next((x[4] for x in reversed(rows) if x[0] == session and x[2] == "assistant"), None)
            own = rnd.choice([*ids, None]) if session % 2 else f"c{i}" if role == "assistant" else latest
            rows.append((session, i, role, f"{i}", None if role == "user" else own, rnd.choice([None, own, ids[0]]) if role == "assistant" and session % 2 else None, f"t{i}", f'{{"n":{i}}}' if role == "assistant" else None))
    log = spark.createDataFrame(rows, LOG)
    given = log.where("role = 'assistant' and call_id is not null").select("session_id", F.col("idx").alias("call_idx"), "arguments")
    pairs = s.call_for(log).withColumnRenamed("result_idx", "idx").join(log.where("role = 'tool'").select("session_id", "idx"), ["session_id", "idx"])
    want = {(r["session_id"], r["idx"], r["tool_name"], r["arguments"]) for r in pairs.join(given, ["session_id", "call_idx"], "left").collect()}
    first = {(r["session_id"], r["call_idx"]): str(r["idx"]) for r in pairs.groupBy("session_id", "call_idx").agg(F.min("idx").alias("idx")).collect()}
    for found in (facts._lists, facts._searched):
        rows = facts.in_rows(log).select("session_id", found(F.col("messages")).alias("l")).collect()
        assert {(r["session_id"], x["idx"], x["name"], x["arguments"]) for r in rows for x in r["l"]["results"]} == want
        calls = {(r["session_id"], x["idx"]): x["first"] for r in rows for x in r["l"]["calls"]}
        assert calls == {(r["session_id"], r["call_idx"]): first.get((r["session_id"], r["call_idx"])) for r in given.collect()}


def test_roles_are_those_of_their_globs(spark):
    names = ["READ", "x_read_file", "read_file\n", "view", "browser_x", "MCP_Browser_tabs", "bash2", "bash", "Kread", "", None, "apply_diff", "my_update_todo_list"]
    d = spark.createDataFrame([(n,) for n in names], "v string")
    for role, globs in facts.ROLES.items():
        by_glob = F.lit(False)
        for glob in globs:
            by_glob = by_glob | F.col("v").rlike(t.glob_pattern(glob))
        assert d.where(facts.has_role(F.col("v"), role) != F.coalesce(by_glob, F.lit(False))).count() == 0


def test_lines_are_made_as_far_as_the_budget_goes(spark):
    """A summary within the row is that of the ledger's rows, whatever the budget."""
    rows = [(1, 0, "user", "Do it.", None, None, None, None)]
    for i in range(12):
        rows.append((1, 1 + 2 * i, "assistant", ["DECISION: take it. TODO: look", "Looked around.", "BLOCKED: by x\nHTTP: label", ""][i % 4], f"c{i}", None, "bash" if i % 2 else "read_file", '{"command":"pytest -q"}' if i % 2 else f'{{"path":"./a/f{i % 3}.ts"}}'))
        rows.append((1, 2 + 2 * i, "tool", f"{i} passed, 0 failed", f"c{i}", None, None, None))
    log = spark.createDataFrame(rows, LOG)
    for budget, floor in ((0, False), (20, False), (60, False), (60, True), (10**6, False)):
        want = facts.summaries(facts.items(log, 2), budget, floor).collect()
        assert facts.summed_up(facts.in_rows(log), 2, budget, floor).collect() == want
