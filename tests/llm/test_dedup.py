"""Exact and near dedup."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from turnloom.llm import common, dedup, neardup
from turnloom.llm.words import shingle_sets

BLANK = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def normal(text):
    return (text or "").translate(BLANK)


def test_hash_is_minimal_and_perfect():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    sizes, bits, slot = dedup.build_hash(keys)
    assert sorted(slot.tolist()) == list(range(5000))
    assert dedup.find_slots(sizes, bits, keys).tolist() == slot.tolist()
    other = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(100)]
    assert dedup.find_slots(sizes, bits, other).max() < 5000
    assert dedup.find_slots([], np.zeros(0, bool), other).tolist() == [-1] * 100


DOCS = (
    [(i, "same text") for i in range(200)]
    + [(300, "same  text"), (301, "sametext"), (None, "same   text"), (302, None), (303, ""), (304, " \n"), (305, "a\xa0b"), (306, "ab"), (307, "a b"), (308, "a b"), (308, "a b"), (None, "only"), (-5, "only")]
    + [(400, "long " * 50000), (399, "long" * 50000)]
)


def frame(spark, docs=DOCS):
    return spark.createDataFrame([(a, b, "x", 1, True) for a, b in docs], "doc_id long, text string, digest string, rid int, kept boolean")


def brute(docs):
    groups = defaultdict(list)
    for a, b in docs:
        groups[normal(b)].append((a, b or ""))
    best = {k: min(v, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0] for k, v in groups.items()}
    return groups, best


@pytest.mark.parametrize("rows", [8192, 40])
def test_exact_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(dedup.look_up, "__defaults__", (rows,))
    out = dedup.exact_groups(frame(spark)).collect()
    groups, best = brute(DOCS)
    want = Counter((a, hashlib.sha256(normal(b).encode()).digest(), best[normal(b)], len(groups[normal(b)])) for a, b in DOCS)
    assert Counter((r["doc_id"], bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in out) == want
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_history(spark):
    old, new = [(1, "a b"), (2, "c"), (3, "c ")], [(10, "ab"), (11, "d"), (12, "d d"), (13, "d"), (14, None)]
    out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in dedup.exact_groups(frame(spark, new), frame(spark, old)).collect()}
    assert out == {10: (1, 1, False), 11: (11, 2, True), 12: (12, 1, True), 13: (11, 2, False), 14: (14, 1, True)}


def test_drop_copies(spark):
    docs = frame(spark)
    out = dedup.drop_copies(docs)
    assert out.columns == docs.columns
    _, best = brute(DOCS)
    assert Counter(normal(r["text"]) for r in out.collect()) == Counter(best.keys())
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(best.values())
    assert dedup.drop_copies(docs.where("false")).count() == 0 and dedup.exact_groups(docs.where("false")).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written for other stages."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("bits", [1 << 27, 8])
def test_only_rows_in_question_travel(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.randbytes(3).hex() for _ in range(3000))) for i in range(200)]
    alone = [(None, "of no other"), (6, "another text"), (7, "")]
    copies = [(None, docs[3][1]), (2000, docs[4][1]), (6, docs[6][1])]
    longer, empty = (None, docs[5][1] + " "), (None, None)
    frame(spark, [*docs, *alone, *copies, longer, empty]).write.parquet(f"{tmp_path}/docs")
    table, threshold = spark.read.parquet(f"{tmp_path}/docs"), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for drop, want in ((dedup.drop_copies, [*docs[:5], *docs[6:], *alone, longer]), (neardup.drop_near, [*docs, *alone, empty])):
            start = shuffled(spark)
            out = drop(table).collect()
            travelled = shuffled(spark) - start
            assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(want)
            # with a full bitmap all rows go to the exact join
            assert bits == 8 or travelled < sum(len(b) for _, b in docs) / 4, (drop, travelled)
    finally:
        spark.conf.set(threshold, usual)


# ---------------------------------------------------------------- near


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute_near(docs):
    sets, parent = [shingles(b) for _, b in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * u:
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, d in enumerate(docs):
        ids[root(i)].append(d[0])
    return sets, [min((x for x in ids[root(i)] if x is not None), default=None) if sets[i] else docs[i][0] for i in range(len(docs))]


def near_docs():
    rnd = random.Random(4)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(160):  # copies of one text with up to a third of their words changed
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(60)] = rnd.choice(vocabulary)
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30)))) for i in range(60)]
    docs += [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one"), (305, "One two"), (306, "two one"), (307, "É é"), (308, "é é"), (None, "One two"), (None, "alone here"), (5, docs[5][1]), (5, docs[5][1])]
    docs += [(400, "x y " * 60000), (401, "X y\t" * 59999)]
    return docs


@pytest.mark.parametrize("small", [8, 1])
def test_near_groups(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "SETS", 16)
    docs = near_docs()
    sets, component = brute_near(docs)
    out = neardup.near_groups(frame(spark, docs)).collect()
    assert Counter((r["doc_id"], r["n"], r["component_id"]) for r in out) == Counter((a, len(s), c) for (a, _), s, c in zip(docs, sets, component, strict=True))


def test_drop_near(spark):
    docs = near_docs()
    _, component = brute_near(docs)
    out = neardup.drop_near(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    want = Counter({a for (a, _), c in zip(docs, component, strict=True) if a == c and a is not None})
    got = Counter(r["doc_id"] for r in out.collect())
    assert {k: v for k, v in got.items() if k is not None} == dict(want)
    assert neardup.drop_near(frame(spark, docs).where("false")).count() == 0


def test_drop_near_by_row(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    docs = [(7, one), (None, one + " end"), (None, two), (None, "unrelated words"), (None, three), (None, three + " end")]
    docs += [(9, two + " more"), (3, "a text of its own"), (3, one + " again"), (1, "first"), (3, "third text"), (3, "third text"), (None, None), (None, ""), (None, "")]
    by_row = [(i, b) for i, (_, b) in enumerate(docs)]
    groups, want = defaultdict(list), Counter()
    for d, c in zip(docs, brute_near(by_row)[1], strict=True):
        groups[c].append(d)
    for members in groups.values():
        want[min((a for a, _ in members if a is not None), default=None)] += 1
    out = neardup.drop_near(frame(spark, docs)).collect()
    assert Counter(r["doc_id"] for r in out) == want and Counter((r["doc_id"], r["text"]) for r in out) <= Counter(docs)
    kept = neardup.near_groups(frame(spark, docs)).where("kept").collect()
    assert Counter(r["doc_id"] for r in kept) == want


def test_components(spark):
    chain = [(i + 1, i) for i in range(100, 180)] + [(500, 3), (500, 7), (9, 9)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 181)) and got[500] == got[7] == 3 and 9 not in got


def test_estimates():
    rnd = np.random.default_rng(2)
    for j in (0.2, 0.5, 0.8, 0.95):
        both = int(1000 * j)
        pool = rnd.integers(0, 1 << 64, 3000, np.uint64, endpoint=False)
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:both], pool[1000 : 2000 - both]]))
        true = both / (2000 - both)
        s = [neardup.sketch(x, np.array([0, len(x)])) for x in (a, b)]
        assert abs(neardup.similarity(s[0], s[1], np.array([1000]), np.array([1000]))[0] - true) < 0.15
        union = neardup.sketch(np.unique(np.concatenate([a, b])), np.array([0, len(np.unique(np.concatenate([a, b])))]))
        assert (union == np.maximum(*s)).all()


def test_shingle_sets():
    texts = ["The the cat", None, "", "one", "a b a b", "x" * 300000 + " y"]
    got = [n for _, b in shingle_sets(texts) for n in np.diff(b).tolist()]
    assert got == [len(shingles(t)) for t in texts]


def test_shingle_sets_of_five_words():
    def brute(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    texts = ["a b c d e f", "A b c d e", "b c d e f", None, "a b c", "a b c d", "", "one", "x y " * 50, "x y x y"]
    got = [s for sets, b in shingle_sets(texts, 5) for s in (set(sets[x:y].tolist()) for x, y in zip(b[:-1], b[1:], strict=True))]
    want = [brute(t) for t in texts]
    for a, x in zip(got, want, strict=True):
        assert [len(a & b) for b in got] == [len(x & y) for y in want]


def test_pipeline_stage_compares_five_words(spark):
    words = [f"w{i}" for i in range(200)]
    edited = [f"new{i}" if i % 25 == 12 else w for i, w in enumerate(words)]  # 8 edits: about 0.85 on two words, 0.66 on five
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:-1] + ["end"]))]
    assert [brute_near(docs)[1]] == [[1, 1, 1]]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, docs), "").collect()) == [1, 2]
