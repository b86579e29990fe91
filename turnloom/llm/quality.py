"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

Each document gets votes (0 bad, 1 good, 2 none) from overlapping heuristics. The votes of all documents are counted by
pattern (at most 3^7 rows, whatever the input); expectation-maximisation over these counts estimates how each labeller
votes on good and on bad documents, and gives every pattern a posterior. The posterior labels of a sample of at most SAMPLE
different texts (the bound is a parameter), those whose hashes are smallest, whatever the layout of the files, train a logistic scorer over hashed runs of four character classes and two shape
features; the scorer then judges every document, whole. Few words are little evidence: a text of n words counts with
n / (n + HALF), and the share of good documents, as the votes have it, with the rest.

Edge cases: texts without words (null, empty, blank) are rejected with score 0 and take no part in training; very long
texts are judged whole, a text at a time; null doc_ids are kept as they are; a score of exactly KEEP keeps the document; repeated
rows are judged each and alike, and train as one text; an empty table gives an empty result; other columns pass through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, word_count
from .words import groups, spans, word_hashes

SAMPLE, DIM, KEEP, HALF = 3000, 4096, 0.5, 24
LABELLERS = ("plain_words", "capitals", "symbols", "repeats", "echo", "rhythm", "shouting")
NONE = 2
#: Character classes of bytes; letters beyond ASCII count as lower case.
CLASS = np.full(256, 0, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",", b"!", b"?", b"#", b"$", b"%", b"&", b"*", b"|"), 1):
    CLASS[list(_chars)] = _i
CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and CLASS[c] == 0]] = 15
UPPER, POINT, BANG, ASK = 1, 5, 7, 8
SYMBOLS = (CLASS >= 9) & (CLASS <= 14)
ODD = (CLASS >= 7) | (CLASS == 2)
#: Four classes, hashed to DIM places.
HASHED = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(2654435761)) >> np.uint64(7)).astype(np.int64) % DIM


def measures(raws: list[bytes]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Shape measures of each text, and for its runs of four classes: hashed places, and each text's first and number."""
    buf, starts, ends, bounds = spans(raws)
    n = np.diff(bounds)
    size = np.array([len(r) for r in raws], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[first])
    per_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    inside = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[ends] - c[starts]
    kind = CLASS[buf]
    upper = kind == UPPER
    h = word_hashes(buf, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[bounds[:-1][n > 0]] = False
    twice = np.zeros(len(h), bool)
    twice[2:] = h[2:] == h[:-2]
    for k in (0, 1):
        twice[(bounds[:-1] + k)[n > k]] = False
    odd = (inside(ODD[buf]) > 0) | (inside(upper) > 1)
    letters = np.maximum(total((kind <= 1) & (buf != 32)), 1)
    at_least = np.maximum(n, 1)
    table = pd.DataFrame(
        {
            "words": n,
            "odd": per_word(odd) / at_least,
            "upper": total(upper) / letters,
            "symbols": total(SYMBOLS[buf]) / at_least,
            "repeats": per_word(same) / np.maximum(n - 1, 1),
            "echo": per_word(twice) / np.maximum(n - 2, 1),
            "ends": total((kind == POINT) | (kind == BANG) | (kind == ASK)) / at_least,
            "bangs": total(kind == BANG) / at_least,
        }
    )
    k = kind.astype(np.int64)
    codes = HASHED[(k[:-3] << 12) | (k[1:-2] << 8) | (k[2:-1] << 4) | k[3:]] if len(k) > 3 else np.zeros(0, np.int64)
    return table, codes, first[:-1], np.maximum(np.minimum(size - 3, len(codes) - first[:-1]), 0)


def votes(t: pd.DataFrame) -> np.ndarray:
    """One column per labeller."""

    def vote(bad: pd.Series, good: pd.Series | bool) -> np.ndarray:
        return np.where(t["words"] == 0, NONE, np.where(bad, 0, np.where(good, 1, NONE)))

    long = t["words"] >= 8
    return np.stack(
        [
            vote((t["odd"] >= 0.5) & long, t["odd"] <= 0.1),
            vote((t["upper"] >= 0.5) & long, False),
            vote((t["symbols"] >= 0.25) & long, False),
            vote((t["repeats"] >= 0.3) & long, t["repeats"] <= 0.05),
            vote((t["echo"] >= 0.25) & long, False),
            vote((t["ends"] == 0) & (t["words"] >= 20), t["ends"].between(1 / 60, 1 / 2)),
            vote((t["bangs"] >= 0.3) & long, False),
        ],
        axis=1,
    )


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(len(LABELLERS))


def vote_patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for _, raws in groups(pdf["text"].tolist()):
            p, n = np.unique(_pattern(votes(measures(raws)[0])), return_counts=True)
            yield pd.DataFrame({"pattern": p, "n": n})


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The posterior that a document is good, by pattern (3^labellers values)."""
    every = np.arange(3 ** len(LABELLERS))
    v = every[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    n = np.zeros(len(every))
    np.add.at(n, patterns, counts)
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    p = np.where(good + bad > 0, (good + 0.1 - (bad > good) * 0.05) / (good + bad + 0.2), 0.5)
    p = np.where(bad >= 2, np.minimum(p, 0.2), p)
    one_hot = v[:, :, None] == np.arange(3)
    for _ in range(rounds):
        rates = []
        for weight in (n * (1 - p), n * p):
            t = np.einsum("p,plv->lv", weight, one_hot) + 0.01 * n.sum() / 100 + 0.1
            rates.append(np.log(t / t.sum(1, keepdims=True)))
        prior = np.log(np.array([(n * (1 - p)).sum() + 1, (n * p).sum() + 1]))
        score = [prior[c] + np.einsum("lv,plv->p", rates[c], one_hot) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30)))
    return p


def features(t: pd.DataFrame, codes: np.ndarray, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Dense rows: shares of hashed runs, then two shape measures and one constant."""
    x = np.zeros((len(t), DIM + 3), np.float32)
    for i, (a, k) in enumerate(zip(first.tolist(), runs.tolist(), strict=True)):
        if k:
            x[i, :DIM] = np.bincount(codes[a : a + k], minlength=DIM) / k
    x[:, DIM], x[:, DIM + 1], x[:, DIM + 2] = t["repeats"], t["odd"], 0.25
    x *= 4
    return x


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by Nesterov's gradient steps; both classes weigh alike."""
    w = speed = np.zeros(x.shape[1], np.float32)
    balance = np.where(y >= 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    for _ in range(steps):
        ahead = w + 0.9 * speed
        g = x.T @ (balance * (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y)).astype(np.float32) + decay * ahead
        speed = 0.9 * speed - rate * g
        w = w + speed
    return w


SPAN = 1 << 60
SAMPLED = "pattern int, at array<int>, x array<float>"


def text_hash() -> Column:
    """A number below SPAN from the text alone."""
    return F.xxhash64("text").bitwiseAND(F.lit(SPAN - 1))


def threshold(sample: int, total: int) -> int:
    """Hashes below it are about twice as many as the sample, among so many rows; all hashes if that is more than there are."""
    return SPAN if 2 * sample >= total else SPAN * 2 * sample // total


def drawn(text: DataFrame, sample: int) -> DataFrame:
    """The sample different texts with the smallest hashes, of those with words."""
    return text.where(word_count(F.col("text")) > 0).withColumn("__hash", text_hash()).dropDuplicates(["__hash"]).orderBy("__hash").limit(sample).select("text")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, np.ndarray]:
    """Scorer weights, the log odds of a good document, and the posterior by pattern."""
    text = docs.select("text")
    counted = text.mapInPandas(vote_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    posterior = fit_labels(counted["pattern"].to_numpy(), counted["n"].to_numpy())
    total = int(counted["n"].sum())
    good = float((posterior[counted["pattern"]] * counted["n"]).sum())
    prior = float(np.log((good + 1) / (total - good + 1)))

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, raws in groups(pdf["text"].tolist()):
                t, codes, first, runs = measures(raws)
                x = features(t, codes, first, runs)[(t["words"] > 0).to_numpy()]
                p = _pattern(votes(t))[t["words"] > 0]
                yield pd.DataFrame({"pattern": p, "at": [np.flatnonzero(r).astype(np.int32) for r in x], "x": [r[r != 0] for r in x]})

    rows = drawn(text.where(text_hash() < threshold(sample, total)), sample).mapInPandas(sampled, SAMPLED).toPandas()
    if not len(rows):  # few different texts, none of which has a small hash
        rows = drawn(text, sample).mapInPandas(sampled, SAMPLED).toPandas()
    x = np.zeros((len(rows), DIM + 3), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[i, at] = v
    return fit_scorer(x, posterior[rows["pattern"].to_numpy(np.int64)].astype(np.float32)), prior, posterior


def judge(texts: list[str | None], weights: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Score in 0 .. 1 and vote pattern of each text."""
    scores, patterns = [], []
    for _, raws in groups(texts):
        t, codes, first, runs = measures(raws)
        sums = np.concatenate([[0], np.cumsum(weights[codes].astype(np.float64))])
        # a text of few bytes at the end has no run and begins behind them all
        first = np.minimum(first, len(codes))
        score = (sums[first + runs] - sums[first]) / np.maximum(runs, 1)
        score = 4 * (score + t["repeats"] * weights[DIM] + t["odd"] * weights[DIM + 1] + 0.25 * weights[DIM + 2])
        evidence = t["words"] / (t["words"] + HALF)
        score = evidence * score + (1 - evidence) * prior
        scores.append(np.where(t["words"] > 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0))
        patterns.append(_pattern(votes(t)))
    return (np.concatenate(scores), np.concatenate(patterns)) if scores else (np.zeros(0), np.zeros(0, np.int64))


def scores(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, posterior (of the votes), score, keep."""
    weights, prior, posterior = fit(docs, sample)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score, pattern = judge(pdf["text"].tolist(), weights, prior)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "posterior": posterior[pattern], "score": score, "keep": score >= KEEP})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the scorer keeps; columns unchanged."""
    weights, prior, _ = fit(docs, sample)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(judge(text.tolist(), weights, prior)[0] >= KEEP)

    return docs.where(good("text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))
