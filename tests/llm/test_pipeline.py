"""The queries of this folder at the smallest size, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest

import corpus_pipeline
from turnloom.llm import quality
from turnloom.llm.common import materialize, read
from turnloom.llm.queries import QUERIES, SQL

from .test_dedup import brute_near, normal
from .test_search_models import JUNK, brute_pii, brute_scores, prose
from .test_tokens_packing import check_packed, expected


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, second, name):
    ours, theirs = QUERIES[name](spark, small).toPandas(), second.sql(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (d[columns].sort_values(columns, ignore_index=True) for d in (ours, theirs))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, small):
    docs = read(spark, small, "documents")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, small), "test")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= seen, name
        if name != "best_fit_packing":
            assert out.columns == columns and Counter(map(tuple, out.collect())).keys() <= {tuple(r) for r in docs.collect()}
        if name in ("quality_classifier", "exact_dedup", "near_dedup"):
            assert len(ids) < len(seen) and out.count() == len(ids)
        docs, seen = out, ids
    fills = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fills) <= 2048
    assert len(fills) == -(-sum(r[1] for r in fills) // 2048)


# ---------------------------------------------------------------- brute force


def documents(spark, small):
    rows = read(spark, small, "documents").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


def test_tokens_query(spark, small):
    at, want = 0, []
    for doc_id, text in sorted(documents(spark, small)):
        ids = expected(text)
        want.append((doc_id, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    got = QUERIES["op9_tokens"](spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_packing_query(spark, small):
    docs = documents(spark, small)
    bins = check_packed(QUERIES["op2_pack"](spark, small).collect(), docs, 2048)
    assert bins == -(-sum(len(expected(t)) for _, t in docs) // 2048)


def test_personal_data_query(spark, small):
    want = {i: brute_pii(t) for i, t in documents(spark, small)}
    for r in QUERIES["op5_pii"](spark, small).collect():
        base = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [base.count(k + ":") for k in ("email", "ip", "card", "phone")]
        assert len(r["spans"].split(",")) == base.count(":") // 2 + r["n_added"] or not r["spans"]


def test_near_duplicates_query(spark, small):
    docs = documents(spark, small)
    sets, component = brute_near(docs)
    got = QUERIES["op6_near_dedup"](spark, small).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((a, len(s), c, a == c) for (a, _), s, c in zip(docs, sets, component, strict=True))


def test_quality_query(spark, small):
    docs = documents(spark, small)
    weights, prior, _ = quality.fit(read(spark, small, "documents"))
    want = dict(zip((a for a, _ in docs), brute_scores([t for _, t in docs], weights, prior), strict=True))
    for r in QUERIES["op8_quality"](spark, small).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-5 and r["keep"] == (r["score"] >= quality.KEEP)


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_pipeline(rows, weights, prior):
    """The first four stages over (doc_id, text, source, ...) rows: the rows that each passes on."""
    scores = brute_scores([r[1] for r in rows], weights, prior)
    good = [r for r, s in zip(rows, scores, strict=True) if s >= quality.KEEP]
    groups = defaultdict(list)
    for r in good:
        groups[normal(r[1])].append(r)
    single = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    sets, parent = [five(r[1]) for r in single], list(range(len(single)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(single)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    near = defaultdict(list)
    for i, r in enumerate(single):
        near[root(i)].append(r)
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in near.values()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in kept:
        total[r[2]] += size(r[1])
    names = sorted(total, key=lambda n: (n is None, n or ""))
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        level = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level > 3 * total[n]}
        for n in over or free:
            target[n] = 3 * total[n] if over else weight[n] * level
        left -= sum(target[n] for n in over)
        free -= over or free
    mixed = []
    for r in kept:
        rate = target[r[2]] / total[r[2]] if total[r[2]] else 1.0
        digest = "null" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()
        coin = int(hashlib.sha256(f"mix-1:{'null' if r[0] is None else r[0]}:{digest}".encode()).hexdigest()[:15], 16) / 2.0**60
        mixed += [r] * (int(rate) + (coin < rate - int(rate)))
    return good, single, kept, mixed


def test_pipeline_by_brute_force(spark):
    """Nulls, repeated ids and rows, empty and long texts, ties, and columns whose names the operators use themselves."""
    rnd = random.Random(5)
    rows = []
    for i in range(90):
        text = prose(rnd, rnd.randint(30, 90)) if i % 9 else rnd.choice(JUNK)
        rows.append((i, text, rnd.choice(["a", "b", "c", None]), i % 2, "x"))
        if i % 5 == 0:
            rows.append((1000 + i, " " + text.replace(" ", "\n"), "b", 1, None))
        if i % 7 == 0:
            rows.append((2000 + i, text + " at the end", "c", 1, "y"))
    rows += [(None, prose(rnd, 60), "a", 1, "n"), (None, prose(rnd, 61), None, 1, "n"), (3, rows[3][1], "c", 9, "again"), (500, None, "a", 1, "z"), (501, "", None, 1, "z"), (502, " \n", "a", 1, "z"), (503, prose(rnd, 5000), "a", 1, "long")]
    schema = "doc_id long, text string, source string, digest int, row string"
    frame = spark.createDataFrame(rows, schema)
    weights, prior, _ = quality.fit(frame)
    stages = dict(corpus_pipeline.STAGES)
    docs = frame
    for name, want in zip(("quality_classifier", "exact_dedup", "near_dedup", "mix_sources"), brute_pipeline(rows, weights, prior), strict=True):
        out = materialize(stages[name](spark, docs, ""), "brute")
        assert out.columns == frame.columns
        got = Counter((r["doc_id"], r["text"], r["source"]) if name != "exact_dedup" else (r["doc_id"], r["text"]) for r in out.collect())
        assert got == Counter(tuple(r[:3]) if name != "exact_dedup" else tuple(r[:2]) for r in want), name
        docs = out
    placed = stages["best_fit_packing"](spark, docs, "").collect()
    again = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert check_packed(placed, [(a, b) for (a, b), n in again.items() for _ in range(n)], 2048) >= 1
    empty = frame.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
