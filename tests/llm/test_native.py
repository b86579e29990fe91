"""URL filter, mixing and sharding."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from turnloom.llm import mixing, sharding, urls

SPACES = " \t\n\x0b\x0c\r"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else default


def test_urls_against_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["org", "example.org", "EXAMPLE.org", "a.example.org", "xexample.org", "com", "x.com", "fr.com.", "net", "", "é.com", "a" * 300 + ".com", ".".join("a" * 400) + ".org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x#y", "/fr/1", "/de/", "/de/#a", "?q=/de/", "#/fr/", "/" * 500, "/é/" + "b" * 5000]
    rows = [(i, f"{rnd.choice(['http', 'HTTPS', 'x://y'])}://{rnd.choice(hosts)}{rnd.choice(paths)}") for i in range(300)]
    rows += [(300, None), (301, ""), (302, "nothing"), (303, "://"), (304, "a://b://c.org/"), (None, "http://x.com/de/"), (5, rows[5][1]), (5, rows[5][1]), (6, "http://org/")]
    pages = spark.createDataFrame([(a, b, "h", "v", 1) for a, b in rows], "page_id long, url string, html string, verdict string, copies int")
    out = urls.filter_urls(pages, urls.rule_table(spark, RULES))
    assert Counter(map(tuple, out.collect())) == Counter((i, *brute_url(u, RULES)) for i, u in rows)


def test_urls_other_rules_and_empty(spark):
    rules = [("block", "b.com", ""), ("allow", "b.com", "/a/b/c"), ("block", "b.com", "/a/b/c"), ("allow", "com", "/a/b/cd")]
    pages = spark.createDataFrame([(1, "http://b.com"), (2, "http://x.b.com/a/b/cd"), (3, "http://c.com/a/b/cd"), (4, "http://bb.com/")], "page_id long, url string")
    out = {r[0]: tuple(r[1:]) for r in urls.filter_urls(pages, urls.rule_table(spark, rules), "block").collect()}
    assert out == {i: brute_url(u, rules, "block") for i, u in pages.collect()}
    assert urls.filter_urls(pages.where("false"), urls.rule_table(spark, rules)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, urls.rule_table(spark, [])).collect()} == {"allow"}


def words(text):
    return len([w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w])


def brute_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        mass = sum(weight[s] for s in order if s not in full)
        target = {s: float(cap * sizes[s]) if s in full else left * weight[s] / mass for s in order}
        over = {s for s in order if s not in full and target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("shares", [(900, 30, 30, 30, 10), (5, 5, 5), (1, 1, 1, 500), (40,)])
def test_targets_are_the_iterated_ones(spark, shares):
    names = ["b", "a", None, "", "é"][: len(shares)]
    rows = [(n, s) for n, s in zip(names, shares, strict=True)]
    out = {r["source"]: r["target"] for r in mixing.source_rates(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert out == pytest.approx(brute_targets(dict(rows)))


def test_mixture(spark):
    docs = [(i, "w " * (1 + i % 40), "s" + str(i % 7) if i % 3 else "hot", "x", i, 2.0, 9) for i in range(3000)]
    docs += [(None, "a b", None, None, 0, 0.0, 0), (-1, None, "hot", None, None, None, None), (-2, "", "void", None, None, None, None), (5, docs[5][1], docs[5][2], "x", 5, 2.0, 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, copies long, target double, source_size long")
    out = mixing.mixture(frame)
    assert out.columns == frame.columns
    rows = Counter(map(tuple, out.collect()))
    assert rows == Counter(map(tuple, mixing.mixture(frame).collect()))
    assert set(rows) <= set(docs) and max(rows.values()) <= 2 * 3
    sizes = Counter()
    for d in docs:
        sizes[d[2]] += words(d[1])
    for s, target in brute_targets(sizes).items():
        taken = sum(n * words(d[1]) for d, n in rows.items() if d[2] == s)
        assert abs(taken - target) <= 5 * (40 * 40 * sizes[s] / 20) ** 0.5 / 2 + 60, s
    assert mixing.mixture(frame.where("false")).count() == 0


def test_word_count_blanks(spark):
    from pyspark.sql import functions as F

    from turnloom.llm.common import word_count

    texts = [None, "", "  ", "a", " a\x0bb\x0cc\rd\te\nf ", "a\xa0b", "\x1f", "x" * 100000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [words(t) for t in texts]


def test_shards(spark):
    docs = [(i, "é" * (i % 50), "hot" if i % 3 == 0 else f"s{i % 11}", i % 8, 0) for i in range(1001)]
    docs += [(None, None, None, 1, 1), (2001, "twice", "hot", 1, 1), (2001, "twice", "hot", 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, shard int, slot int")
    rows = sharding.interleave(frame).collect()
    want = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    hot = {d[0] for d in docs if d[2] == "hot"}
    shares = [sum(r["doc_id"] in hot for r in rows if r["shard"] == s) for s in range(8)]
    assert max(shares) - min(shares) <= 3
    assert sharding.interleave(frame.where("false")).count() == 0
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.interleave(frame).collect()), key=str)
