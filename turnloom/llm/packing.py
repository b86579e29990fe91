"""Best-fit packing of documents into sequences, with certified bin counts.

Texts become ids (end id included); documents longer than a sequence are cut into full pieces behind a first piece that
may be shorter. Full pieces are sequences by themselves. The others are dealt to partitions of about PART pieces by a
hash, and each partition runs best-fit decreasing and a lower bound from dual feasible functions. A partition whose bin
count equals its bound is certified and keeps its bins, but for the emptiest one; a partition with a gap gives back all
its pieces. What was given back is dealt out anew, with pieces of other partitions, and packed again; a round is kept
only if it needs fewer sequences. Rounds end when the count meets the bound of the whole, or after ROUNDS.

Only (id, length) rows travel; the bins, counts and bounds that reach the driver are single sums.

Edge cases: null and empty texts are the end id alone; repeated rows are packed each by itself (rows carry an id of their
own); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .encoder import crc32
from .tokens import END, TOKENIZER, encode

LENGTH, PART, ROUNDS = 2048, 16384, 3
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "uid long, length long, part long, bin long, offset long, free boolean, bins long, bound long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of docs(doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch, ids, bounds in encode(batches, path, end):
            ids, sizes = ids.astype("<u4"), np.diff(bounds)
            per_doc = -(-sizes // length)
            first = sizes - (per_doc - 1) * length
            row = np.repeat(np.arange(batch.num_rows), per_doc)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
            size = np.where(piece == 0, first[row], length)
            at = bounds[row] + start
            sums = np.array([crc32(ids[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)], np.int64)
            yield pa.record_batch(
                [pa.array(uid + np.arange(len(row))), batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(sums)],
                names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )
            uid += len(row)

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Bins with the same room are used last in, first out."""
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = capacity - fill[b]
        if left:
            if not room[left]:
                mask |= 1 << left
            room[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of the volume bound and two families of dual feasible functions, over a histogram of sizes."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for k in np.unique(np.concatenate([np.linspace(1, capacity // 2, 64).astype(int), np.flatnonzero(count[: capacity // 2 + 1])[:64]])).tolist():
        if k:
            # small items vanish, large ones fill a bin
            f = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
            best = max(best, -(-int((count * f).sum()) // capacity))
    for k in range(1, 33):
        # steps of capacity / k, exact multiples of capacity / (k + 1) unchanged; scaled by k
        f = np.where((x * (k + 1)) % capacity == 0, x * k, (x * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return best


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        free = np.full(len(fill), len(fill) > bound)
        free[np.argmin(fill)] |= fill.min() < capacity
        return pdf.assign(bin=bins, offset=offsets, free=free[bins], bins=len(fill), bound=bound)[["uid", "length", "part", "bin", "offset", "free", "bins", "bound"]]

    return items.groupBy("part").applyInPandas(pack, PACKED)


def pack(items: DataFrame, capacity: int = LENGTH, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """uid, sequence_id, offset for items(uid, length), each shorter than the capacity."""
    n = items.count()
    kept, waiting, best = [], items, None
    for k in range(rounds):
        parts = max(1, -(-n // part))
        # parts of different rounds never meet: the round is in the number
        dealt = waiting.select("uid", "length", (F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)) + F.lit(k << 32)).alias("part"))
        trial = materialize(_packed(dealt, capacity), "packed")
        used = trial.select("part", "bins", "bound").distinct().agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound")).first()
        if best is not None:
            if used["bins"] is None or used["bins"] >= best[1]:
                break
            kept[-1] = best[0].where("not free")
        kept.append(trial)
        freed = trial.where("free")
        sums = freed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part", "bin").alias("bins"), F.sum("length").alias("tokens")).first()
        if not sums["n"] or sums["bins"] <= -(-sums["tokens"] // capacity):
            break
        best, waiting, n = (trial, sums["bins"]), freed, sums["n"]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select("uid", ((F.col("part") * F.lit(1 << 24)) + F.col("bin")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    cut = materialize(pieces(docs, path, length), "pieces")
    placed = pack(cut.where(F.col("length") < length).select("uid", "length"), length)
    full = cut.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return cut.where(F.col("length") < length).join(placed, "uid").unionByName(full).drop("uid")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
