"""Exact top-k inner products with vector-approximation files.

Components are scaled to integers. A vector's approximation lays a grid of CELLS cells over the vector's own range and
keeps one byte per component, with the range's lower end and the width of a cell. For a query q, the product q . cell
number, with the sums of q's positive and of its negative components, bounds the vector's score from both sides; one
dense product per pair of blocks scans all bounds.

0. Of equal vectors (equal 128-bit digests) only the rows of the k + 1 smallest vec_ids go on, as no other copy can be a result.
1. Only approximations travel: rows are dealt to data blocks and queries to query blocks of bounded size, and each pair of
   blocks is one task. It takes the k-th largest lower bound as a threshold and returns the ids and bounds of the rows
   whose upper bound reaches it.
2. The k-th largest lower bound of all blocks prunes the candidates of a query once more. Exact vectors are then read by
   row id in the order of the upper bounds: first the best FIRST * k of each query; the k-th exact score so found is the
   proven threshold for the second reading, of all candidates whose upper bound reaches it. Then the result is certain.

Bounds are computed in doubles and widened by more than their rounding error. Scores are exact: products of rows whose
sums stay below 2^53 are computed in doubles, all others in Python's unbounded integers. A score of the result beyond 64
bits is an error, as the result has no column for it.

Edge cases: vectors that are null or hold null or non-finite components take no part, whatever the size of the others;
vectors meet only vectors of their own dimension; an empty vector scores 0 with other empty ones; null vec_ids take no
part; rows with the query's own vec_id are its own rows and not candidates; each row of a repeated query id is a query by
itself; ties go to the smaller vec_id, repeated candidate rows count one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

K, SCALE, CELLS, FIRST = 10, 1024, 256, 2
DATA_BLOCK, QUERY_BLOCK, LEAST_BLOCKS, CHUNK = 32768, 2048, 24, 64
CANDIDATES = "query_row long, query_id long, row long, vec_id long, lower double, upper double"
#: Beyond HUGE a double times SCALE may not be finite; MOST is beyond 64 bits and within a decimal.
HUGE, MOST = 1e300, 10**37


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector as doubles; rows that take no part are left out."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf))
    return vectors.where("vec_id is not null and embedding is not null").where(F.forall(x, finite)).select("vec_id", x.alias("x"))


def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly (scale is a power of two); infinite beyond HUGE."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def integers(x: list[float], scale: int = SCALE) -> list[int]:
    """The same, unbounded."""
    return [math.floor(e * scale) if abs(e) < HUGE else int(e) * scale for e in x]


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (uint8) of scaled vectors, one row each, with the lower end of each row's range and its cell width."""
    if not x.shape[1]:
        return x.astype(np.uint8), np.zeros(len(x)), np.zeros(len(x))
    low, high = x.min(1), x.max(1)
    with np.errstate(all="ignore"):
        width = (high - low) / CELLS
        cell = np.clip(np.floor((x - low[:, None]) / np.where(width > 0, width, 1)[:, None]), 0, CELLS - 1)
    return np.nan_to_num(cell).astype(np.uint8), low, width


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, queries by rows; a bound that cannot be computed is infinite."""
    with np.errstate(all="ignore"):
        plus, minus = np.maximum(q, 0).sum(1)[:, None], np.minimum(q, 0).sum(1)[:, None]
        base = (plus + minus) * low
        product = q @ cells.T.astype(np.float64)
        # more than any rounding of cells, products and sums
        slack = (plus - minus) * (np.abs(low) + CELLS * width) * ((q.shape[1] + 16) * 2.0**-50)
        lower, upper = base + width * (product + minus) - slack, base + width * (product + plus) + slack
    sound = np.isfinite(lower) & np.isfinite(upper)
    return np.where(sound, lower, -np.inf), np.where(sound, upper, np.inf)


def scan_block(ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the places of the rows that may be among its best k of the block, with their bounds."""
    for s in range(0, len(q), CHUNK):
        lower, upper = bounds(cells, low, width, q[s : s + CHUNK])
        for j in range(len(lower)):
            own = ids == q_ids[s + j]
            lows = np.where(own, -np.inf, lower[j])
            t = np.partition(lows, len(ids) - k)[len(ids) - k] if len(ids) > k else -np.inf
            at = np.flatnonzero((upper[j] >= t) & ~own)
            yield at, lower[j][at], upper[j][at]


def exact_scores(x: pd.Series, q: pd.Series) -> list[int]:
    """Scores of pairs of vectors of doubles, as unbounded integers."""
    out: list[int] = [0] * len(x)
    sizes = x.map(len).to_numpy()
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        a, b = (scaled(np.stack(side.to_numpy()[at])) for side in (x, q))
        with np.errstate(all="ignore"):
            safe = np.abs(a).max(1) * np.abs(b).max(1) * d < 2.0**53
            sums = np.einsum("ij,ij->i", a, b)
        for i, fits, total in zip(at.tolist(), safe.tolist(), sums.tolist(), strict=True):
            out[i] = int(total) if fits else sum(m * n for m, n in zip(integers(x.iloc[i]), integers(q.iloc[i]), strict=True))
    return out


def digest(x: np.ndarray) -> bytes:
    """Of the scaled vector; 128 bits."""
    return blake2b((scaled(np.asarray(x, np.float64)) + 0.0).tobytes(), digest_size=16).digest()


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def candidates(v: DataFrame, queries: DataFrame, k: int, data_block: int, query_block: int) -> DataFrame:
    """CANDIDATES of v(row, vec_id, x) for queries of the same columns, by bounds alone."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf["x"].map(len).to_numpy()
            cells, low, width = [b""] * len(pdf), np.zeros(len(pdf)), np.zeros(len(pdf))
            for d in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == d)
                c, low[at], width[at] = approximate(scaled(np.stack(pdf["x"].to_numpy()[at])))
                for i, row in zip(at.tolist(), c, strict=True):
                    cells[i] = row.tobytes()
            yield pdf[["row", "vec_id"]].assign(dim=dims.astype(np.int32), cells=cells, low=low, width=width, digest=[digest(x) for x in pdf["x"]])

    file = materialize(v.mapInPandas(index, "row long, vec_id long, dim int, cells binary, low double, width double, digest binary"), "vector-file")
    # of equal vectors only those of the k + 1 smallest vec_ids can be among the best k (one may be the query's own)
    same = Window.partitionBy("dim", "digest")
    file = file.withColumn("n", F.row_number().over(Window.partitionBy("dim", "digest", "vec_id").orderBy("row"))).where(F.col("n") <= k)
    file = file.withColumn("n", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n", "digest")
    data_blocks = max(LEAST_BLOCKS, -(-file.count() // data_block))
    query_blocks = max(1, -(-queries.count() // query_block))
    left = file.withColumn("b", F.pmod("row", F.lit(data_blocks)).cast("int")).withColumn("qb", _numbers(query_blocks))
    right = queries.select("row", "vec_id", "x", F.size("x").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("qb")).withColumn("b", _numbers(data_blocks))

    def scan(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            d = int(data["dim"].iloc[0])
            ids, rows = data["vec_id"].to_numpy(), data["row"].to_numpy()
            cells = np.frombuffer(b"".join(data["cells"]), np.uint8).reshape(len(data), d)
            q = scaled(np.array(asked["x"].tolist(), np.float64).reshape(len(asked), d))
            found = scan_block(ids, cells, data["low"].to_numpy(), data["width"].to_numpy(), asked["vec_id"].to_numpy(), q, k)
            for row, q_id, (at, lower, upper) in zip(asked["row"], asked["vec_id"], found, strict=True):
                out.append(pd.DataFrame({"query_row": row, "query_id": q_id, "row": rows[at], "vec_id": ids[at], "lower": lower, "upper": upper}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in CANDIDATES.split(", ")})

    return left.groupBy("dim", "b", "qb").cogroup(right.groupBy("dim", "b", "qb")).applyInPandas(scan, CANDIDATES)


def read_exact(chosen: DataFrame, v: DataFrame, queries: DataFrame) -> DataFrame:
    """query_row, query_id, vec_id, score of candidates, from the exact vectors."""

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # as text: it may be beyond 64 bits; beyond MOST the order does not matter, as it fails in any result
            yield pdf[["query_row", "query_id", "vec_id"]].assign(score=[str(max(-MOST, min(MOST, s))) for s in exact_scores(pdf["x"], pdf["q"])])

    asked = queries.select(F.col("row").alias("query_row"), F.col("x").alias("q"))
    pairs = chosen.select("query_row", "query_id", "row", "vec_id").join(v.select("row", "x"), "row").join(asked, "query_row")
    return pairs.mapInPandas(scores, "query_row long, query_id long, vec_id long, score string")


def search(vectors: DataFrame, is_query: Column, k: int = K, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows for each row of vectors that is_query selects."""
    v = materialize(usable(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")
    queries = materialize(v.where(is_query), "queries")
    found = materialize(candidates(v, queries, k, data_block, query_block), "candidates")
    per = Window.partitionBy("query_row")
    sure = found.withColumn("n", F.row_number().over(per.orderBy(F.desc("lower")))).where(F.col("n") <= k)
    sure = sure.groupBy("query_row").agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    left = found.join(sure.select("query_row", "least"), "query_row", "left").where("least is null or upper >= least")
    ranked = materialize(left.withColumn("n", F.row_number().over(per.orderBy(F.desc("upper"), "vec_id", "row"))).select("query_row", "query_id", "row", "vec_id", "upper", "n"), "ranked")
    value = F.col("score").cast("decimal(38,0)")
    first = materialize(read_exact(ranked.where(F.col("n") <= FIRST * k), v, queries), "exact-scores")
    proven = first.withColumn("m", F.row_number().over(per.orderBy(F.desc(value)))).where(F.col("m") == k).select("query_row", value.cast("double").alias("proven"))
    # the double next below a proven score is no larger than it
    rest = ranked.where(F.col("n") > FIRST * k).join(proven, "query_row", "left").where("proven is null or upper >= proven - abs(proven) * 1e-15")
    scores = first.unionByName(read_exact(rest, v, queries))
    best = scores.withColumn("rank", F.row_number().over(per.orderBy(F.desc(value), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, embedding, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
