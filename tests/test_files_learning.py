"""Readers and writers of files, and learning, on small inputs."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from turnloom.operators import learning
from turnloom.sources import files


def test_log_coverage(spark, tmp_path):
    good = '{"seq":1,"action":"reuse","client_status":200,"tokens_in":5}'
    for name, text, want in (("a", f"{good}\n\n{good}", (2, 0, 0, True)), ("b", f"{good}\nno json\n", (1, 1, 0, False)), ("c", "x" * ((1 << 20) + 1) + "\n", (0, 1, 1, False))):
        (tmp_path / name).write_text(text)
        assert tuple(files.log_coverage(spark, str(tmp_path / name)).first()) == want
        assert tuple(files.text_coverage(spark, text).first()) == want


def test_collected_requests(spark, tmp_path):
    body = {"messages": [{"role": "user", "content": "é"}]}
    (tmp_path / "r10.json").write_text("﻿" + json.dumps(body), encoding="utf-8")
    (tmp_path / "r2.jsonl").write_text(json.dumps({"body": body}) + "\n\n" + json.dumps({"request": json.dumps(body)}) + "\n[1]\n")
    (tmp_path / "r1.json").write_text(json.dumps([body, {"x": 1}]))
    (tmp_path / "note.txt").write_text("no")
    rows = files.collected_requests(spark, str(tmp_path)).collect()
    got = [(r["label"], r["body"] is not None, r["defect"]) for r in rows]
    assert got == [("r1.json:1", True, None), ("r1.json:2", False, "no_messages"), ("r2.jsonl:1", True, None), ("r2.jsonl:2", True, None), ("r2.jsonl:3", False, "not_an_object"), ("r10.json:1", True, None)]


def test_plan_store(spark, tmp_path):
    path = f"file://{tmp_path}/plans"
    plans = spark.createDataFrame([("2024-01-10", "a", "1", "old"), ("2024-01-20", "a", "2", "new"), ("2024-01-20", "b", "1", "x")], "day string, key string, at string, plan string")
    files.store_plans(plans, path)
    files.store_plans(spark.createDataFrame([("2024-01-21", "b", "1", "y")], plans.schema), path)
    (tmp_path / "plans" / "day=2024-01-21" / "part-extra.txt").write_text('no json\n{"version":9,"key":"a","plan":"z"}\n')
    today = F.lit(datetime.date(2024, 1, 22))
    newest, skipped = files.stored_plans(spark, path, today)
    assert {r["key"]: r["plan"] for r in newest.collect()} == {"a": "new", "b": "y"}
    assert tuple(skipped.first()) == (0, 1, 2)
    assert files.stored_plans(spark, path, today, 1)[0].count() == 0


def test_learned_state(spark, tmp_path):
    p = tmp_path / "state.json"
    p.write_text(json.dumps({"version": 1, "window": 100, "counter": "estimate", "entries": {"a": {"window": 90, "tighten": -5, "correction": 9, "ratios": [1, -1, 2]}, "b": {"window": 900}}}))
    rows = {r["key"]: r for r in files.learned_state(spark, str(p), 100, "estimate").collect()}
    assert rows["a"]["window"] == 90 and rows["a"]["tighten"] == 0 and rows["a"]["correction"] == 2.5 and rows["a"]["newest_ratios"] == [2.0, 1.0] and rows["b"]["window"] is None
    assert files.learned_state(spark, str(p), 200, "estimate").count() == 0


def test_results_and_runs(spark, tmp_path):
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "x.json").write_text("\n".join(json.dumps(x) for x in [{"system": "a", "scenario": "s", "window": 1, "at": "1", "passed": False, "tokens": 5}, {"system": "a", "scenario": "s", "window": 1, "at": "2", "passed": True, "tokens": 4}]))
    manifest = spark.createDataFrame([("a", "s", 1), ("a", "s", 2)], "system string, scenario string, window long")
    rows = {r["window"]: (r["state"], r["tokens"]) for r in files.newest_results(spark, str(tmp_path / "results"), manifest).collect()}
    assert rows == {1: ("PASS", 4), 2: ("NOT RUN", None)}
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "mock.jsonl").write_text('{"seq":1,"session":"s","digests":["a"]}\n')
    run = files.run_records(spark, str(tmp_path / "run"))
    assert run["mock"].count() == 1 and run["client"].count() == 0
    files.append_records(run["mock"], str(tmp_path / "log"))
    files.append_records(run["mock"], str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_redaction(spark, tmp_path):
    body = {"model": "m", "tools": [{"type": "function", "function": {"name": "read", "description": "secret"}}], "messages": [{"role": "user", "content": "top sécret\n😀", "name": "Ann"}, {"role": "tool", "name": "read", "content": 'a"b'}, {"role": "assistant", "tool_calls": [{"id": "c", "function": {"name": "read", "arguments": '{"path": "a\\"b\\u0041", "n": 12}'}}]}]}
    out = files.redact(body)
    text, new = json.dumps(body, ensure_ascii=False), json.dumps(out, ensure_ascii=False)
    assert len(new.encode()) == len(text.encode()) and "cret" not in new and "Ann" not in new
    assert out["tools"][0]["function"]["name"] == out["messages"][1]["name"] == "read" and out["messages"][0]["content"].count("\n") == 1
    assert json.loads(out["messages"][2]["tool_calls"][0]["function"]["arguments"])["n"] == 12
    d = spark.createDataFrame([("x", json.dumps(body, ensure_ascii=False)), ("y", "no json")], "label string, body string")
    files.write_redacted(d, str(tmp_path / "out"))
    assert sorted(len(r["value"] or "") > 0 for r in spark.read.schema("label string, value string").json(str(tmp_path / "out")).collect()) == [False, True]


def test_jsonc():
    assert files.parse_jsonc('{ // c\n "a": "x//y", /* b\n */ "l": [1, 2,],\n}') == {"a": "x//y", "l": [1, 2]}
    with pytest.raises(ValueError, match="^2:"):
        files.parse_jsonc("{\n nope }")


def test_message_pattern():
    import re

    p = files.message_pattern("Limit is 4096 tokens (got 5000).")
    assert re.search(p, "Limit is  8 tokens (got 77).").groups() == ("8", "77") and not re.search(p, "Limit is x tokens (got 77).")


def test_json_differences(spark):
    d = lambda x: spark.createDataFrame([(1, json.dumps(x))], "k int, json string")
    rows = files.json_differences(d({"a": [1, {"b": 2}], "e": {}}), d({"a": [1, {"b": 3}, 4]}), "k").collect()
    assert sorted((r["path"], r["a"], r["b"]) for r in rows) == [("$.a[1].b", "2", "3"), ("$.a[2]", None, "4"), ("$.e", "{}", None)]


def test_learning(spark):
    rows = [("k", 1, "overflow_prompt", 1000, 5000, 800, None, 1030), ("k", 2, "overflow_prompt", 1000, 5000, 900, None, None), ("k", 3, "payload_too_large", 10, 1000, None, None, None), ("k", 4, "overflow_unknown", 2000, 1, None, None, None), ("k", 5, "overflow_unknown", 9000, 1, None, None, None)]
    d = spark.createDataFrame(rows, "key string, seq int, kind string, raw long, bytes long, window long, max_prompt long, prompt long")
    r = learning.learned(d, 4000).first()
    # 4000 - 1900 = 2100, up to 2304, capped at half the budget
    assert (r["window"], r["max_prompt"], r["max_bytes"], r["correction"], r["tighten"], r["changes"], r["n"]) == (800, None, 900, 1.03, 2000, 3, 5)
