"""Top-k search, the quality classifier and personal data."""

from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import pii, quality, tagger, topk


def brute_topk(rows, k=10):
    """In unbounded integers."""
    scaled = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        scaled.append((i, [math.floor(1024 * Fraction(x)) for x in v]))
    out = []
    for q, v in scaled:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in scaled if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(32768, 2048), (50, 2)])
def test_topk(spark, monkeypatch, blocks):
    rnd = np.random.default_rng(6)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(rnd.normal(0, 0.2, 8))) for i in range(500)]
    rows += [(1000 + i, f32(np.full(8, 0.25))) for i in range(60)]  # ties
    rows += [(900, f32(np.full(8, 0.5)))] * 30 + [(901 + i % 7, f32(np.full(8, 0.5))) for i in range(40)]  # copies with repeated ids
    rows += [(100_000, f32(rows[0][1])), (2001, None), (2002, [None] * 8), (2003, [float("nan")] + [0.0] * 7), (2004, [float("inf")] * 8), (None, [0.0] * 8), (2005, []), (2100, []), (2200, [1.0, 2.0]), (2007, [3.0, 4.0]), (2008, f32([1e12] * 8)), (-300, f32(rnd.normal(0, 0.2, 8))), (7, f32(rnd.normal(0, 0.2, 8)))]
    frame = spark.createDataFrame([(a, b, 1, "x", 3) for a, b in rows], "vec_id long, embedding array<float>, label int, row string, score int")
    out = topk.search(frame, F.col("vec_id") % 100 == 0, 10, *blocks)
    assert sorted(map(tuple, out.collect())) == brute_topk(rows)
    assert topk.search(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e10, 2.0]), (2, [0.5, 0.5]), (3, [-1e12, 1.0]), (4, [3.3e-7, 1e11]), (100, [3.0, -2.0]), (5, [1e9, 7.0]), (6, [1e9, 7.5])]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(frame(rows), F.col("vec_id") % 100 == 0, 3).collect())) == brute_topk(rows, 3)
    # a score beyond 64 bits that is not in the result is no error; one that is in it is
    rows.append((8, [-1e300, 0.0]))
    assert sorted(map(tuple, topk.search(frame(rows[:3] + rows[-1:]), F.col("vec_id") % 100 == 0, 2).collect())) == brute_topk(rows[:3] + rows[-1:], 2)
    with pytest.raises(Exception, match="(?i)overflow|cast"):
        topk.search(frame([(0, [1.0]), (1, [1e300])]), F.col("vec_id") % 100 == 0, 2).collect()


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    for scale in (1, 1e6, 1e15, 1e150):
        x, q = topk.scaled(rnd.normal(0, scale, (200, 24))), topk.scaled(rnd.normal(0, scale, (5, 24)))
        lower, upper = topk.bounds(*topk.approximate(x), q)
        for i in range(len(q)):
            exact = [sum(int(a) * int(b) for a, b in zip(r, q[i], strict=True)) for r in x]
            assert all(lo <= s <= up for lo, s, up in zip(lower[i], exact, upper[i], strict=True))


JUNK = ["BUY NOW!! " * 30, "thing*** other$$$ more### " * 20, "again again again again again again " * 12, "a | b | c | d | e " * 20]


def prose(rnd, n=60):
    w = ["the", "house", "was", "near", "a", "river", "and", "people", "walked", "there", "often", "because", "it", "looked", "fine"]
    out = []
    for i in range(n):
        x = rnd.choice(w)
        out.append((x.capitalize() if i % 9 == 0 else x) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def test_quality(spark):
    rnd = random.Random(1)
    docs = [(i, prose(rnd) if i % 4 else rnd.choice(JUNK), "x", 0.5, False) for i in range(400)]
    docs += [(900, None, None, None, None), (901, "", "", 0.0, True), (902, "Hello.", "x", 1.0, True), (903, prose(rnd, 60000), "x", 0.0, True), (None, prose(rnd), "x", 0.0, True), (3, docs[3][1], "x", 0.5, False)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, score double, keep boolean")
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in range(400) if i % 4} <= set(ids) and not {i for i in range(400) if i % 4 == 0} & set(ids)
    assert {902, 903, None} <= set(ids) and not {900, 901} & set(ids) and ids.count(3) == 2
    assert quality.scores(frame).count() == len(docs)
    assert quality.scores(frame.where("false")).count() == 0


def test_draw():
    # ten billion rows and more: the expected draw stays near twice the sample
    for total in (10**10, 10**12, 3 * 10**9, 10**7):
        assert abs(quality.threshold(3000, total) / quality.SPAN * total - 6000) < 1e-3
    assert quality.threshold(3000, 6000) == quality.threshold(3000, 0) == quality.SPAN


def test_draw_is_by_content(spark):
    rnd = random.Random(3)
    texts = [prose(rnd, 30) for _ in range(50)]
    rows = [(t,) for t in texts for _ in range(3)] + [(texts[0],)] * 500 + [(None,), ("",)]
    one = [r["text"] for r in quality.drawn(spark.createDataFrame(rows, "text string"), 20).collect()]
    rnd.shuffle(rows)
    other = [r["text"] for r in quality.drawn(spark.createDataFrame(rows, "text string").repartition(7), 20).collect()]
    assert sorted(one) == sorted(other) and len(set(one)) == 20
    # one text alone is found whatever its hash
    weights, prior, _ = quality.fit(spark.createDataFrame([(texts[0],)] * 40, "text string"), 1)
    assert np.abs(weights).sum() > 0


def brute_scores(texts, weights, prior):
    """The scorer, text by text and character by character."""
    out = []
    for text in texts:
        raw = (text or "").encode()
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
        if not words:
            out.append(0.0)
            continue
        kind = quality.CLASS[np.frombuffer(raw, np.uint8)].tolist()
        runs = [(kind[i] << 12) | (kind[i + 1] << 8) | (kind[i + 2] << 4) | kind[i + 3] for i in range(len(kind) - 3)]
        linear = sum(float(weights[quality.HASHED[r]]) for r in runs) / max(1, len(runs))
        repeats = sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)) / max(1, len(words) - 1)
        odd = 0
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
            k = kind[m.start() : m.end()]
            odd += any(quality.ODD[c] for c in m[0]) or sum(x == quality.UPPER for x in k) > 1
        linear = 4 * (linear + repeats * weights[quality.DIM] + odd / len(words) * weights[quality.DIM + 1] + 0.25 * weights[quality.DIM + 2])
        share = len(words) / (len(words) + quality.HALF)
        out.append(1 / (1 + math.exp(-(share * linear + (1 - share) * prior))))
    return out


def test_scores_by_brute_force(spark):
    rnd = random.Random(8)
    texts = [prose(rnd) if i % 3 else rnd.choice(JUNK) for i in range(60)] + [None, "", " ", "One", "É è ñ! Ü?", "a\tb\nc d", "AB cd EF", prose(rnd, 4000), "x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    weights, prior, _ = quality.fit(frame)
    want = brute_scores(texts, weights, prior)
    got = {r["doc_id"]: r for r in quality.scores(frame).collect()}
    assert all(abs(got[i]["score"] - s) < 1e-6 and got[i]["keep"] == (s >= quality.KEEP) for i, s in enumerate(want))


def test_quality_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.scores(docs).join(labels, "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)


def test_label_model_finds_the_better_labeller():
    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.7
    v = np.full((4000, len(quality.LABELLERS)), quality.NONE)
    for j, accuracy in enumerate((0.95, 0.9, 0.85)):
        v[:, j] = np.where(rnd.random(4000) < accuracy, truth, ~truth)
    p, n = np.unique(quality._pattern(v), return_counts=True)
    posterior = quality.fit_labels(p, n)
    assert ((posterior[quality._pattern(v)] > 0.5) == truth).mean() > 0.95


# ---------------------------------------------------------------- personal data

PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def brute_pii(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = 0
            for i, c in enumerate(reversed(digits)):
                x = int(c) * (1 + i % 2)
                total += x - 9 * (x > 9)
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and total % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_fuzzed():
    rnd = random.Random(2)
    parts = [*"ab12345@@..+-() %_x,\n", "1.2.3.4", "4111 1111 1111 1111", "+1 (456) 555-2186", "a@b.co", "é", "😀"]
    for _ in range(4000):
        t = "".join(rnd.choices(parts, k=rnd.randint(0, 30)))
        assert pii.joined(pii.base_spans(t)[0]) == brute_pii(t), repr(t)


def test_long_runs_are_linear():
    for t in ("a" * 300000, "1" * 300000, "1." * 150000, "@" * 300000, "+1" * 150000, "1 " * 150000, "a@" * 100000, "+1" + " " * 300000):
        pii.base_spans(t)


def test_pii(spark):
    texts = ["mail a.b@c.example.com now", None, "", "😀 +1 (456) 555-2186 and 10.0.0.1", "4111 1111 1111 1111 " * 200, "no data", "x " * 50000 + "e@f.org", "9999 999.1.1.1"]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "q@r.st", 1, "x"), (0, texts[0], 1, "x")], "doc_id long, text string, n_email int, spans string")
    rows = pii.find(frame).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "q@r.st" if r["doc_id"] is None else texts[r["doc_id"]]
        want = brute_pii(text)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert r["n_email"] == want.count("email") and r["n_card"] == want.count("card")
    assert pii.find(frame.where("false")).count() == 0


def test_tagger_gradients():
    m = {k: v.astype(np.float64) for k, v in tagger.new_model().items()}
    x, y = tagger.examples(3, 1)
    _, g = tagger.gradients(m, x, y)
    for k in m:
        i = tuple(int(s) for s in np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        loss = []
        for e in (1e-3, -1e-3):
            moved = {q: v.copy() for q, v in m.items()}
            moved[k][i] += e
            loss.append(tagger.gradients(moved, x, y)[0])
        assert g[k][i] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=1e-3), k


def best_path(m, e):
    """Viterbi over one window's emissions, tag by tag."""
    score, back = m["first"] + e[0], []
    for row in e[1:]:
        step = score[:, None] + m["next"]
        back.append(step.argmax(0))
        score = step.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


def test_decoding_is_exact():
    model, maker = tagger.trained(), tagger.Maker(5)
    x = np.full((60, 120), tagger.PAD, np.uint8)
    for i in range(60):
        c = tagger.codes(maker.text(120, (0.0, 0.1)[i % 2])[0])[:120]
        x[i, : len(c)] = c
    tags, e = tagger.decode(model, x), tagger.emissions(model, x)
    empty = tagger.surely_empty(model, e)
    assert empty.any() and not empty.all()
    for i in range(60):
        path, score = best_path(model, e[:, i])
        mine = model["first"][tags[i, 0]] + e[0, i, tags[i, 0]] + sum(model["next"][a, b] + e[t, i, b] for t, (a, b) in enumerate(zip(tags[i, :-1], tags[i, 1:], strict=True), 1))
        assert mine == pytest.approx(score, abs=1e-2)
        assert not (empty[i] and any(path))


def found_by(maker, n):
    """Recall by kind, and the number of false spans, over n texts of several windows."""
    hit, total, false = {}, {}, 0
    for _ in range(n):
        text, tags = maker.text(1500)
        gold = [(tagger.KINDS[(t - 1) // 2], i, next((j for j in range(i + 1, len(tags)) if tags[j] != t + 1), len(tags))) for i, t in enumerate(tags) if t % 2]
        got = set(next(pii.tagged([text], tagger.trained())))
        false += len(got - set(gold))
        for g in gold:
            total[g[0]] = total.get(g[0], 0) + 1
            hit[g[0]] = hit.get(g[0], 0) + (g in got)
    return {k: hit[k] / total[k] for k in total}, false


def test_tagger_held_out():
    """Texts with names of credentials that training never saw."""
    recall, false = found_by(tagger.Maker(77, held_out=True), 60)
    assert set(recall) == set(tagger.KINDS) and min(recall.values()) >= 0.95 and false <= 30


def test_windows_agree_wherever_a_span_lies():
    model, value = tagger.trained(), "3dc91a32781def2fd668aa2fd071eacee1a19444"
    words = "the house was near a river and people walked there often because it looked fine "
    for at in range(340, 620, 16):
        text = (words * 30)[:at] + ' token = "' + value + '" ' + words * 30
        assert list(pii.tagged([text], model)) == [[("secret", text.index(value), text.index(value) + 40)]]
    # between long texts and empty ones, alone or together
    texts = ["", words * 300, 'x token = "' + value + '"', words * 3 + "write to jane (at) mail.example.com soon", "é" * 3000]
    together = list(pii.tagged(texts, model))
    assert together == [next(pii.tagged([t], model)) for t in texts]
    assert together[0] == together[1] == together[4] == [] and together[2][0][0] == "secret" and together[3][0][0] == "email"


def test_tagger_adds_to_the_patterns(spark, small):
    """Over a whole table: every credential is added, and nothing in texts that hold neither digit nor at sign."""
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = pii.find(docs).collect()
    want = {i: [(m.start(1), m.end(1)) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)] for i, t in texts.items()}
    assert sum(map(len, want.values())) > 0
    for r in rows:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [(int(a), int(z)) for k, a, z in spans if k == "secret"] == want[r["doc_id"]]
        assert r["n_secret"] == len(want[r["doc_id"]]) and (r["n_added"] == 0 or re.search("[0-9@]", texts[r["doc_id"]]))


def test_added_spans():
    text = "a@b.co 4111111111111111 token x (415) 555-0100 z"
    spans = [("email", 0, 6), ("card", 7, 23), ("secret", 24, 31), ("phone", 32, 46)]
    assert pii.added(text, spans, [(0, 6)], [(0, 6), (7, 23)]) == [("secret", 24, 31), ("phone", 32, 46)]
    assert pii.added(text, spans, [], []) == [("card", 7, 23), ("secret", 24, 31), ("phone", 32, 46)]
    # one sweep: many spans against many matches
    many = [("phone", 20 * i, 20 * i + 10) for i in range(50_000)]
    assert pii.added("0123456789" * 100_001, many, [], [(20 * i + 12, 20 * i + 15) for i in range(50_000)]) == many
