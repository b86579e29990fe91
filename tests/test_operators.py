"""Operators against sequential walks, and streams against batches."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnloom.functions import budget, errors, hashing, text, tokens
from turnloom.operators import logs, planner, structure, supersede
from turnloom import streaming

LOG = "session_id long, idx int, role string, content string, call_id string, call_id2 string, tool_name string"


def histories(n=150, seed=5):
    rnd = random.Random(seed)
    rows = []
    for s in range(n):
        for i in range(rnd.randint(1, 14)):
            role = rnd.choice(["user", "assistant", "assistant", "tool", "tool", "tool", "function", "system", "odd"])
            ids = [rnd.choice(["a", "b", "c"]), rnd.choice(["a", "b", None])] if role == "assistant" and rnd.random() < 0.8 else [None, None]
            if role in ("tool", "function"):
                ids = [rnd.choice(["a", "b", "c"]), None]
            content = structure.SUMMARY_HEADER if role == "user" and rnd.random() < 0.4 else rnd.choice(["x", "", None])
            rows.append((s, i, role, content, *ids, "t" + (ids[0] or "")))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(histories(), LOG).cache()


def sessions():
    out = {}
    for r in histories():
        out.setdefault(r[0], []).append(r)
    return out


def test_heads_and_boundaries(log):
    heads = {r["session_id"]: r["h"] for r in structure.head_end(log).collect()}
    marks = Counter((r["session_id"], r["b"]) for r in structure.boundaries(log).collect())
    want = Counter()
    for s, m in sessions().items():
        h = next((i for i, r in enumerate(m) if r[2] == "assistant"), len(m))
        while h and m[h - 1][2] == "user" and (m[h - 1][3] or "").startswith(structure.SUMMARY_HEADER):
            h -= 1
        assert heads[s] == h
        want.update((s, b) for b in range(1, len(m)) if m[b][2] == "assistant" and m[b - 1][2] != "assistant")
        want[s, len(m)] += 1
    assert marks == want


def test_units(log):
    heads = {r["session_id"]: r["h"] for r in structure.head_end(log).collect()}
    got = {}
    for r in structure.units(log).orderBy("session_id", "unit").collect():
        got.setdefault(r["session_id"], []).append((r["start"], r["stop"], r["kind"]))
    for s, m in sessions().items():
        want = []
        for i in range(heads[s], len(m)):
            starts = m[i][2] in ("assistant", "user", "system", "developer")
            if starts or i == heads[s]:
                want.append([i, i + 1, "assistant" if m[i][2] == "assistant" else "user" if starts else "other"])
            else:
                want[-1][1] = i + 1
        assert got.get(s, []) == [tuple(w) for w in want]


def test_call_for(log):
    got = {(r["session_id"], r["result_idx"]): r["call_idx"] for r in structure.call_for(log).collect()}
    for s, m in sessions().items():
        for i, r in enumerate(m):
            if r[2] in ("tool", "function"):
                want = None
                for j in range(i - 1, -1, -1):
                    if m[j][2] in ("user", "system", "developer"):
                        break
                    if m[j][2] == "assistant" and r[4] in m[j][4:6]:
                        want = j
                        break
                assert got[s, i] == want


def test_pairing_defects(log):
    got = Counter({(r["session_id"], r["kind"], r["id"]): r["n"] for r in structure.pairing_defects(log).collect()})
    want = Counter()
    for s, m in sessions().items():
        pending = Counter()
        for r in m:
            if r[2] == "tool":
                if pending[r[4]]:
                    pending[r[4]] -= 1
                else:
                    want[s, "orphan", r[4]] += 1
                continue
            for k, c in pending.items():
                want[s, "unanswered", k] += c
            pending = Counter()
            if r[2] == "assistant":
                for k in filter(None, r[4:6]):
                    want[s, "dup", k] += pending[k] > 0
                    pending[k] += 1
    assert got == +want


def test_caps_split_no_pair(spark):
    rows = [("a😀b", 2), ("a😀b", 3), ("ab", 5), ("", 1), ("x y  z", 2)]
    for t, n in rows:
        r = spark.createDataFrame([(t,)], "t string").select(text.utf16_length(F.col("t")), text.head_units(F.col("t"), n)).first()
        units = t.encode("utf-16-le")
        want = units[: 2 * n].decode("utf-16-le", "ignore")
        assert r[0] == len(units) // 2 and r[1] == want


def test_text_helpers(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(text.collapse, " a\xa0\n b﻿ ") == "a b"
    assert one(text.sentences, "One. Two!  Three;\nfour\n\n") == ["One.", "Two!", "Three;", "four"]
    assert one(text.normal_sentence, "Run  It. !?") == "run it"
    assert one(text.reasoning, "<think>why</think>so") == "why" and one(text.visible, "<think>why</think>so") == "so"
    assert one(text.path_key, "./a/b/c.ts") == "b/c.ts"
    assert one(tokens.content_class, '{"a": 1}') == "json" and one(tokens.content_class, "const a = 1;\nlet b;") == "code"
    assert one(tokens.content_class, "src/a/b.ts\nsrc/c/d.ts") == "json" and one(tokens.content_class, "3 passed, 1 failed") == "testOutput"
    assert one(tokens.content_class, "שלום עולם") == "snapshotNonLatin" and one(tokens.estimate, "") == 0


def test_json_prose(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    words = "a long description of what this tool is for"
    bs = chr(92)
    texts = [f'{{"k": "{words}"}}', f'{{"k": "{"x" * 60}"}}', f'{{"k": "{words}', f'"{words}{bs}"\n"', f'["{"𝒳 " * 14}", "{bs}" {words}"]', '["' + f'{bs}" ' * 40_000, "[]"]
    for t in texts:
        units = "".join(c if ord(c) < 0x10000 else chr(0xE000) * 2 for c in t)
        found = [] if len(t) > 10_000 else re.findall(r'"(?:[^"\\\n]|\\[^\n\r\u2028\u2029]){40,}"', units)
        assert one(tokens.json_prose, t) == sum(len(x) for x in found if " " in x)
    t = texts[0]
    literal = len(words) + 2
    assert one(tokens.estimate, t) == math.ceil((literal / 5.0 + (len(t) - literal) / 2.33) * 1.1)


def test_document_estimates_by_class(spark, tmp_path):
    from turnloom.plans.registry import QUERIES

    docs = [(1, "plain words " * 20, 5.0), (2, '{"a": [1, 2, 3]}', 2.33), (3, "const a = 1;\nlet b;", 4.1), (4, "src/a/b.ts\nsrc/c/d.ts", 2.33), (5, "3 passed, 1 failed", 2.5), (6, "שלום עולם", 2.06), (7, None, 1), (8, "", 1)]
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["tokens"] for r in QUERIES["x03_document_estimates"](spark, str(tmp_path)).collect()}
    assert got == {i: math.ceil(len(t or "") / ratio * 1.1) for i, t, ratio in docs}


def test_budget_of_the_usual_window(spark):
    lit = lambda n: F.lit(n).cast("long")
    r = spark.range(1).select(*(c.alias(k) for k, c in budget.budget(lit(100000), lit(32000), lit(0), F.lit(None).cast("long")).items())).first()
    assert (r["budget"], r["hard"], r["trigger"], r["target"]) == (67000, 61000, 61000, 21350)


def test_chains(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = spark.createDataFrame([(["x", "y"],)], "d array<string>").select(hashing.chain_keys(F.col("d"), "r")).first()[0]
    first = sha(sha("r") + "x")
    assert got == [first, sha(first + "y")]


def test_error_rules(spark):
    cases = [
        (400, "This model's maximum context length is 10 tokens. However, your request has 12 input tokens", "vllm.v011.prompt", 10, 12),
        (429, "rate limit: maximum context", None, None, None),
        (503, "away", "gateway.5xx", None, None),
        (500, "maximum context", None, None, None),
        (422, "MAXIMUM context", "generic.suspect", None, None),
    ]
    found = errors.classify(F.col("s"), F.col("b"), F.col("b"))
    rows = spark.createDataFrame([c[:2] for c in cases], "s int, b string").select(found["rule"], found["window"], found["prompt"]).collect()
    assert [tuple(r) for r in rows] == [c[2:] for c in cases]


def test_log_lines(spark, tmp_path):
    good = {"seq": 1, "action": "compact", "client_status": 200, "tokens_in": 5}
    bad = [{**good, "seq": 1.5}, {**good, "action": "other"}, {**good, "client_status": 99}, {**good, "client_status": 600}, {k: v for k, v in good.items() if k != "tokens_in"}, [1], "x"]
    lines = [json.dumps(good), "", "  ", "{broken", *map(json.dumps, bad), json.dumps({**good, "pad": "x" * (1 << 20)}), json.dumps({**good, "attempts": []})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    r = logs.coverage(logs.read_lines(spark, f"file://{tmp_path}/log.jsonl")).first()
    assert tuple(r) == (2, len(bad) + 2, 1)


def test_event_streams(spark):
    body = ": hi\r\n\r\nevent: e\r\ndata: a\r\ndata:b\r\n\r\ndata: tail"
    rows = [tuple(r)[2:] for r in logs.sse_events(spark.createDataFrame([(1, body)], "id int, body string")).orderBy("n").collect()]
    assert rows == [(None, None, True, True), ("e", "a\nb", False, True), (None, "tail", False, False)]


@pytest.mark.parametrize(
    ("older", "later", "gone"),
    [
        ("RULE-A1: keep it short.", "Correction for RULE-A1: keep it long.", [0]),
        ("RULE-A1: keep it short.", "Also keep RULE-A1 friendly.", []),
        ("Deploy the billing service to staging.", "Actually, please deploy the billing service to production.", [0]),
        # a cue that also opens reports, and no directive word: a report
        ("Deploy the billing service to staging.", "Actually deploy the billing service to production.", []),
        ("Run the tests after each change.", "Actually, the tests passed now.", []),
        ("Never print the token.", "The token is not printed anymore.", []),
        ("Use two workers.", "We no longer need two workers.", [0]),
        ("Run the payment tests.", "Cancel tests.", []),
        ("Deploy the billing service.", "Should we cancel the billing service?", []),
        ("Run the export job. Keep the import job.", "Cancel the export job.", [0]),
        ("Run the export job.", "Do not cancel the export job.", []),
        ("Run webkit tests on the export page.", "Skip webkit.", [0]),
        ("Never delete webkit fixtures.", "Skip webkit.", []),
    ],
)
def test_supersession(older, later, gone):
    assert [r[1] for r in supersede.resolve([older, later])] == gone


def test_repeats_go_together():
    assert sorted(r[:2] for r in supersede.resolve(["Deploy the billing service to staging.", "Deploy  the billing service to staging", "Actually, please deploy the billing service to production."])) == [(0, 0), (1, 0)]


def plan_log(n=40, seed=3):
    rnd = random.Random(seed)
    return [(s, i, "user" if i == 0 or rnd.random() < 0.05 else ("assistant", "tool")[(i + 1) % 2], rnd.randint(5, 400), rnd.random() < 0.1) for s in range(6) for i in range(n)]


def test_plans_keep_their_budget(spark):
    limits = planner.Limits.of(3000, 500)
    frame = spark.createDataFrame(plan_log(), "session_id long, idx int, role string, tokens long, snapshot boolean")
    rows = planner.fold(frame, 3000, 500).collect()
    assert {r["action"] for r in rows} >= {"passthrough", "reuse", "compact"}
    for r in rows:
        assert r["tokens_out"] <= r["tokens_in"] + limits.summary
        assert r["action"] == "impossible" or r["tokens_out"] <= limits.budget
        assert r["action"] != "passthrough" or r["tokens_out"] == r["tokens_in"]
    cuts = {}
    for r in sorted(rows, key=lambda r: (r["session_id"], r["boundary"])):
        assert r["cut"] >= cuts.get(r["session_id"], 0)
        cuts[r["session_id"]] = r["cut"]


def test_resumed_plan_is_the_fresh_one():
    limits = planner.Limits.of(3000, 500)
    m = [r[1:] for r in plan_log() if r[0] == 2]
    fresh = planner.advance(planner.Plan(), m, limits, True)
    for k in range(1, len(m)):
        p = planner.Plan()
        rows = planner.advance(p, m[:k], limits, False)
        assert rows + planner.advance(planner.Plan.load(p.dump()), m[k:], limits, True) == fresh


def run_stream(spark, frame, parts, build, mode, tmp_path, name):
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        for f in (tmp_path / f"in/part={i}").glob("*.parquet"):
            (tmp_path / "flat").mkdir(exist_ok=True)
            f.rename(tmp_path / f"flat/{i:03d}.parquet")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/flat")
    q = build(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_plans_equal_the_batch(spark, tmp_path):
    frame = spark.createDataFrame(plan_log(20), "session_id long, idx int, role string, tokens long, snapshot boolean")
    parts = [frame.where(f"idx >= {a} and idx < {a + 7}") for a in (0, 7, 14)]
    out = run_stream(spark, frame, parts, lambda s: streaming.session_plans(s, 3000, 500), "append", tmp_path, "plans_out")
    batch = {tuple(r) for r in planner.fold(frame, 3000, 500).collect() if r["boundary"] < 20}
    assert {tuple(r) for r in out.collect()} == batch


def test_streamed_calibration_equals_the_batch(spark, tmp_path):
    rnd = random.Random(1)
    frame = spark.createDataFrame([(k, i, 0.8 + rnd.random()) for k in range(3) for i in range(90)], "key long, seq long, ratio double")
    parts = [frame.where(f"seq >= {a} and seq < {a + 30}") for a in (0, 30, 60)]
    out = run_stream(spark, frame, parts, streaming.calibration, "update", tmp_path, "calibration_out")
    last = {r["key"]: tuple(r) for r in out.orderBy("samples").collect()}
    assert set(last.values()) == {tuple(r) for r in streaming.calibration_batch(frame).collect()}


def test_streamed_timeline(spark, small, tmp_path):
    frame = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 11 == 0).alias("compacted"))
    out = run_stream(spark, frame, [frame], lambda s: streaming.timeline(s, "1 day"), "complete", tmp_path, "timeline_out")
    want = frame.groupBy(F.date_trunc("day", "ts").alias("bucket")).agg(F.count(F.lit(1)).alias("requests"), F.count_if("compacted").alias("compactions"))
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, want.collect()))


def test_truncation_keeps_its_room():
    from turnloom.operators.rewrites import slimmed, tokens, truncated

    long = "".join(f"line {i}\n" for i in range(500))
    for room in (1, 8, 30, 200):
        out = truncated(long, room)
        assert tokens(out) <= max(room, 8) and "left out" in out
    assert truncated("short", 5) == "short"
    page = "- Page URL: u\n- Page Snapshot:\n" + "- text a\n" * 50 + "- button b\n" + "- text c\n" * 50
    out = slimmed(page, 60)
    assert "- button b" in out and out.startswith("- Page URL: u\n- Page Snapshot:\n") and tokens(out) <= 60


def test_tabs_and_units():
    from turnloom.operators.rewrites import pair_unit, tabs

    assert tabs([("navigate", "a"), ("new", "b"), ("new", "c"), ("select", "1"), ("close", "0")]) == (["b", "c"], 0)
    assert tabs([("new", "b"), ("close", "1"), ("close", "0")]) == (["about:blank"], 0)
    assert tabs([("list", '["x", "y"]'), ("select", "1"), ("select", "9")]) == (["x", "y"], 1)
    assert pair_unit(["a", "b"], ["b", None, "a"]) == [1, 0, None]


def test_unit_pairs_of_unique_ids(spark, small):
    from turnloom.operators.rewrites import unit_pairs
    from turnloom.sources.transcript import transcript

    log = transcript(spark, small).where("session_id % 10 = 1").cache()
    asof = {(r["session_id"], r["result_idx"]): r["call_idx"] for r in structure.call_for(log).collect()}
    for r in unit_pairs(log).collect():
        if r["call_idx"] is not None:
            assert asof[r["session_id"], r["idx"]] == r["call_idx"]


def test_plans_are_resumed_and_keep_a_bounded_state():
    limits = planner.Limits.of(3000, 300)
    for seed in range(60):
        rnd = random.Random(seed)
        log = [(i, "user" if i == 0 else rnd.choice(["user", "assistant", "tool", "tool"]), rnd.choice([5, 40, 300, 900]), rnd.random() < 0.2) for i in range(rnd.randint(1, 120))]
        fresh = planner.advance(planner.Plan(), log, limits, True)
        plan, rows, at = planner.Plan(), [], 0
        while at < len(log):
            to = at + rnd.randint(1, 9)
            rows += planner.advance(plan, log[at:to], limits, to >= len(log))
            plan, at = planner.Plan.load(plan.dump()), to
        assert rows == fresh
        assert all(r[3] <= limits.budget or r[1] == "impossible" for r in fresh) and [r[2] for r in fresh] == sorted(r[2] for r in fresh)
    plan = planner.Plan()
    planner.advance(plan, [(i, "user" if i == 0 else "assistant" if i % 2 else "tool", 200, False) for i in range(20_000)], limits, True)
    assert len(plan.front) + len(plan.tail) + len(plan.short) < 100


def test_walks_take_batches_of_sessions(spark, small):
    """No group of pandas for each session, and no dealing out anew of a log that is dealt out by session."""
    from turnloom.plans.registry import QUERIES

    for name in ("w10_tab_states", "j02_unit_pairs", "st15_client_compaction", "st03_session_plans", "x19_superseded"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and plan.count("Exchange") == 1, name


def test_estimates_make_the_class_once():
    """The class's patterns stand in an estimate once, not at each mention."""
    plan = str(tokens.estimate(F.col("t")))
    assert plan.count("Running") == 1
