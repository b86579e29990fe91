"""Exact dedup over a minimal perfect hash of historical distinct digests.

A text's digest is the SHA-256 of the text without its blanks. Historical digests are grouped (partial aggregates first,
so a digest of a third of all rows costs one row per task), each with its winner: most code points, then smallest
doc_id. They are dealt to buckets by digest; each bucket becomes one index row: a minimal perfect hash (levels of bit
maps, each key at the first level where no other key shares its position; the slot is the rank of its bit), and by
slot the full digest, the winner's row, and the size of its group.

Rows then look their digest up in their bucket and compare all 32 bytes: members get the winner, the others are
grouped by an index of their own. A bucket with many rows (copies of one text) is looked up in several parts, each with
a copy of the index row, so that no task gets an unbounded group.

Without a history the rows themselves are the history: every row is then a member.

Edge cases: null text counts as empty, and all empty texts are one group; null doc_ids lose ties; of rows that repeat both
doc_id and text one is kept; very long texts are hashed whole; an empty table gives an empty result; other columns are
not read, and ``drop_copies`` passes them on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, materialize, only_kept, read

KEYS, ROWS = 4096, 8192
INDEX = "bucket long, n int, sizes array<int>, bits binary, digests binary, winners binary, groups binary"
_U = np.uint64


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without its blanks."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def text_size(text: Column) -> Column:
    """Code points of the whole text."""
    return F.length(F.coalesce(text, F.lit("")))


def digest_table(docs: DataFrame) -> DataFrame:
    """rid, doc_id, digest (32 bytes), size (code points of the whole text); written out, so that rid is stable."""
    text = F.col("text")
    return materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_digest(text).alias("digest"), text_size(text).alias("size")), "digests")


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A position below size for each key (two 64-bit words of its digest)."""
    with np.errstate(over="ignore"):
        x = words[:, 0] + words[:, 1] * _U(2 * level + 1)
        x ^= x >> _U(31)
        x *= _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(29)
    return (x % _U(size)).astype(np.int64)


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)[:, :2]


def build_hash(digests: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all bits, and the slot of each digest; the digests are distinct in their first 16 bytes."""
    words = _words(b"".join(digests))
    todo, sizes, bits, place = np.arange(len(digests)), [], [], np.empty(len(digests), np.int64)
    while len(todo):
        size = 2 * len(todo)
        at = _positions(words[todo], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        place[todo[placed]] = at[placed] + sum(sizes)
        todo = todo[~placed]
        sizes.append(size)
        bits.append(alone)
    bits = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, bits, (np.cumsum(bits) - 1)[place]


def find_slots(sizes: list[int], bits: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """The slot each digest would have if it were a key, or -1."""
    words, rank = _words(b"".join(digests)), np.cumsum(bits) - 1
    out, todo, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = _positions(words[todo], level, size) + base
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + size
    return out


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def build_index(table: DataFrame, keys: int = KEYS) -> tuple[DataFrame, int]:
    """The index over the distinct digests of a digest table, and the number of its buckets."""
    best = F.max(F.struct("size", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("by_id"), (-F.col("rid")).alias("by_rid")))
    groups = table.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.select("digest", (-F.col("best.by_rid")).alias("rid"), (-F.col("best.by_id")).alias("doc_id"), "n"), "digest-groups")
    buckets = max(1, -(-groups.count() // keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = pdf["digest"].tolist()
        sizes, bits, slot = build_hash(digests)
        order = np.argsort(slot)
        winners = np.zeros(len(pdf), [("rid", "<i8"), ("doc_id", "<i8"), ("known", "<i8")])
        winners["rid"], winners["doc_id"], winners["known"] = pdf["rid"], pdf["doc_id"].fillna(0).astype("int64"), pdf["doc_id"].notna()
        return pd.DataFrame(
            {
                "bucket": [pdf["bucket"].iloc[0]],
                "n": [len(pdf)],
                "sizes": [sizes],
                "bits": [np.packbits(bits).tobytes()],
                "digests": [b"".join(digests[i] for i in order)],
                "winners": [winners[order].tobytes()],
                "groups": [pdf["n"].to_numpy("<i8")[order].tobytes()],
            }
        )

    dealt = groups.withColumn("bucket", _bucket(buckets))
    # doc_id as a decimal keeps its nulls and all its digits through pandas
    index = dealt.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)")).groupBy("bucket").applyInPandas(build, INDEX)
    return materialize(index, "digest-index"), buckets


def look_up(table: DataFrame, index: DataFrame, buckets: int, rows: int = ROWS) -> DataFrame:
    """rid, doc_id, digest, size, w_rid, w_doc_id, n of each row; the last three null for nonmembers."""
    table = table.withColumn("bucket", _bucket(buckets))
    parts = table.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    parts = materialize(parts.where("parts > 1"), "digest-parts")
    table = table.join(parts, "bucket", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), "parts"), F.lit(0)).cast("int")).drop("parts")
    index = index.join(parts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[["rid", "doc_id", "digest", "size"]]
        if not len(left) or not len(right):
            return left.assign(w_rid=None, w_doc_id=None, n=None)
        row = right.iloc[0]
        sizes = list(row["sizes"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        digests = left["digest"].tolist()
        slot = find_slots(sizes, bits, digests)
        known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        same = (slot >= 0) & (known[np.maximum(slot, 0)] == np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)).all(1)
        w = np.frombuffer(row["winners"], [("rid", "<i8"), ("doc_id", "<i8"), ("known", "<i8")])[np.maximum(slot, 0)]
        n = np.frombuffer(row["groups"], "<i8")[np.maximum(slot, 0)]

        def column(values: np.ndarray, valid: np.ndarray) -> pd.array:
            return pd.arrays.IntegerArray(np.array(values, np.int64), ~valid)

        return left.assign(w_rid=column(w["rid"], same), w_doc_id=column(w["doc_id"], same & (w["known"] == 1)), n=column(n, same))

    keyed = table.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
    schema = "rid long, doc_id decimal(20,0), digest binary, size int, w_rid long, w_doc_id long, n long"
    found = keyed.groupBy("bucket", "part").cogroup(index.groupBy("bucket", "part")).applyInPandas(find, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def exact_groups(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """rid, doc_id, digest, size, keep_id, group_size, kept for every row of docs(doc_id, text).

    With a history, members of it are copies (kept is false, keep_id and group_size are the history's), and the
    other rows are grouped among themselves.
    """
    table = digest_table(docs)
    index, buckets = build_index(table if history is None else digest_table(history))
    found = look_up(table, index, buckets)
    shape = lambda d, kept: d.select("rid", "doc_id", "digest", "size", F.col("w_doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"))
    own = F.col("rid") == F.col("w_rid")
    if history is None:
        return shape(found, own)
    found = materialize(found, "digest-found")
    new = materialize(found.where("w_rid is null").select("rid", "doc_id", "digest", "size"), "digest-new")
    index, buckets = build_index(new)
    return shape(found.where("w_rid is not null"), F.lit(False)).unionByName(shape(look_up(new, index, buckets), own))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without all but the winner of each group; columns unchanged."""
    groups = materialize(exact_groups(docs).select("doc_id", "digest", "size", "kept"), "digest-kept")
    return only_kept(docs, {"digest": text_digest, "size": text_size}, groups)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
