"""MinHash near-dedup with SetSketch registers.

A document is the set of its shingles of width words (64-bit hashes): two in the query ``op6_near_dedup`` and as the functions'
default, five in the pipeline's stage. Equal sets form a class, found by a digest of the whole
set, and go on as one. Each set gets REGISTERS registers: floor(1 - log_B x) of the smallest of its exponential
variates, cut off at 0 and Q + 1; registers of a union are maxima, and equal registers tell similar sets. BANDS bands of
ROWS registers put classes into buckets; a pair with Jaccard similarity 0.8 shares no bucket with probability
(1 - 0.8^4)^36, about 6e-9.

Links are found in two rounds, neither of which emits the pairs of a bucket:
1. each class meets the medoid of each of its buckets (the class whose buckets are largest in sum: of a text and its
   altered copies, mostly the text); registers estimate the similarity by maximum likelihood given both set sizes,
   hopeless pairs go, the others are verified on the full sets, and links are joined to components;
2. in buckets of three or more that still hold several components, the classes outside the bucket's largest component are
   compared with all others by their registers, in blocks of bounded size, to which rows are dealt before they meet
   anything of their bucket. Likely pairs of small components are verified one by one. Of two components of which one has more
   than SMALL classes the likeliest pair is verified; only where it does not link them, and nothing else did, all their
   classes are compared on the full sets, by inverted lists over blocks of bounded size, which give one link for each
   class at most.
What round 2 leaves out is either linked already or shares its component, so no pair of a bucket is lost.

Links are confirmed on full sets of 64-bit hashes of shingles. Two different shingles of a pair of documents with n
shingles in all share a hash with probability below n^2 / 2^65, for two documents of a million shingles each below 1e-7;
the digest that makes equal sets one class has 128 bits.

Components come from large-star and small-star steps over the links, a written table each.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer words than
the width is one shingle; repeated rows and equal texts are one class; rows with null doc_id take part, and the smallest known doc_id names
a component (null if none is known); an empty table gives an empty result; other columns are not read, and ``drop_near``
passes them on. Who stays is decided by row: of each component the row with the smallest doc_id (nulls last), of several
one; of rows that repeat both doc_id and text, one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_in, only_kept, packed, read
from .tokens import text_batches
from .words import shingle_sets

#: Words of a shingle.
WIDTH = 2
BANDS, ROWS = 36, 4
REGISTERS = BANDS * ROWS
#: Parameters of the sketch: base, rate, largest register.
B, A, Q = 1.001, 20.0, 65534
PERCENT, LIKELY, BLOCK, SMALL, SETS = 80, 0.6, 1024, 8, 512
_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, REGISTERS, np.uint64, endpoint=False)
CELL = "a long, b long"
FOUND = "a long, b long, whole boolean, x long, y long, same long"


def sketch(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """REGISTERS registers (uint16) for each nonempty set."""
    n = len(bounds) - 1
    low = np.empty((REGISTERS, n), np.uint64)
    step = 1 << 15
    starts = bounds[:-1]
    if n:
        # blocks of whole sets that stay in the cache
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + step, "right")) - 1))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            x = sets[bounds[a] : bounds[z]]
            at = starts[a:z] - bounds[a]
            for i in range(REGISTERS):
                low[i, a:z] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], at)
    x = -np.log1p(-(low.T.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-53)) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def similarity(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes, on a grid of 1/64."""
    up, down = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    same = REGISTERS - up - down
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    j = np.minimum(np.linspace(0, 1, 65)[None, :], np.minimum(n / m, m / n)[:, None])
    p = lambda t: np.maximum(-np.log1p(-np.maximum(t, 0) * (B - 1) / B) / np.log(B), 1e-12)
    first, second = p(u - v * j), p(v - u * j)
    like = up * np.log(first) + down * np.log(second) + same * np.log(np.maximum(1 - first - second, 1e-12))
    return j[np.arange(len(j)), like.argmax(1)]


def likely(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False for pairs that cannot be, or almost surely are not, linked."""
    out = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((x == y).sum(1) >= LIKELY * REGISTERS)
    if out.any():
        out[out] = similarity(x[out], y[out], n[out], m[out]) >= LIKELY
    return out


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def text_key(text: Column) -> Column:
    """A digest of the whole text, which with doc_id finds a row again."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """rid, doc_id, text_key, n, digest, registers for every row; written out, so that rid is stable."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in text_batches(batches):
            ns, digests, registers = [], [], []
            for sets, bounds in shingle_sets(batch.column("text").to_pylist(), width):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                regs = iter(sketch(sets, bounds[np.append(full, len(n))] if len(full) else bounds[:1]))
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    digests.append(_digest(sets[a:z]))
                    registers.append(next(regs).tobytes() if z > a else None)
                ns.append(n)
            n = batch.num_rows
            yield pa.record_batch(
                [pa.array(rid + np.arange(n)), batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(ns)), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())],
                names=["rid", "doc_id", "text_key", "n", "digest", "registers"],
            )
            rid += n

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return materialize(keyed.mapInArrow(rows, "rid long, doc_id long, text_key binary, n long, digest binary, registers binary"), "sketches")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, digest, shingles for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            at = 0
            for sets, bounds in shingle_sets(batch.column("text").to_pylist(), width):
                n = len(bounds) - 1
                digests = [_digest(sets[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.record_batch([batch.column("doc_id").slice(at, n), pa.array(digests, pa.binary()), lists], names=["doc_id", "digest", "shingles"])
                at += n

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, digest binary, shingles array<long>")


def sets_of(wanted: DataFrame, rows: int, classes: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """rid, shingles for the classes wanted(rid), at most so many rows; written out."""
    wanted = materialize(packed(classes.join(wanted.distinct(), "rid").select("rid", "digest", F.col("doc_id").alias("c_doc_id")), rows), "wanted")
    chosen = maybe_in(docs.select("doc_id", "text"), F.col("doc_id"), wanted, F.col("c_doc_id"), rows)
    # no semi join: Spark would move it below the first filter, and all texts would travel
    chosen = chosen.join(wanted.select("c_doc_id").distinct(), chosen["doc_id"].eqNullSafe(F.col("c_doc_id"))).drop("c_doc_id")
    return materialize(full_sets(chosen, width).join(wanted, "digest").dropDuplicates(["rid"]).select("rid", "shingles"), "full-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("t"))
    return materialize(shared.where(100 * F.col("i") >= PERCENT * (F.col("t") - F.col("i"))).select("a", "b"), "links")


def linked_blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each set on the right one link into the block on the left, if there is any."""
    a, b = [], []
    if len(left) and len(right):
        size = left["shingles"].map(len).to_numpy()
        flat = np.concatenate(left["shingles"].to_numpy())
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(left)), size)[order]
        rid = left["rid"].to_numpy()
        for r, s in zip(right["rid"], right["shingles"], strict=True):
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(left))
            hit = np.flatnonzero(100 * shared >= PERCENT * (size + len(s) - shared))
            if len(hit):
                a.append(r)
                b.append(rid[hit[0]])
    return pd.DataFrame({"a": a, "b": b}).astype("int64")


def linked_components(pairs: DataFrame, placed: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """Links between components a and b, of which b is the larger; placed(rid, root) has the classes of all components.

    Both sides are dealt to blocks of about SETS classes, and every block of b meets every block of what b is paired with.
    """
    member = placed.join(sets, "rid")
    big = pairs.select(F.col("b").alias("root")).distinct()
    small = pairs.join(placed.select(F.col("root").alias("a"), "rid"), "a").select(F.col("b").alias("root"), "rid")
    small = materialize(packed(small.distinct(), rows), "block-members")
    parts = placed.join(big, "root", "left_semi").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SETS).cast("int").alias("blocks"))
    parts = materialize(packed(parts.join(small.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SETS).cast("int").alias("chunks")), "root"), rows), "block-parts")
    deal = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = member.join(parts, "root").withColumn("block", deal(F.col("blocks"))).withColumn("chunk", every("chunks"))
    right = small.join(sets, "rid").join(parts, "root").withColumn("chunk", deal(F.col("chunks"))).withColumn("block", every("blocks"))
    key = ["root", "block", "chunk"]
    left, right = (x.select(*(F.col(c).alias(c) for c in (*key, "rid", "shingles"))) for x in (left, right))
    return materialize(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(linked_blocks, CELL), "block-links")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a, b): the root is the smallest node of its component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    rows = links.count()
    edges = materialize(packed(edges, rows), "edges")
    # a step that changes nothing ends it: every edge then leads to a root that is no node itself
    while rows and edges.join(edges.select(F.col("u").alias("n")), edges["v"] == F.col("n"), "left_semi").limit(1).count() + edges.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        # large star: larger neighbours hang on the smallest of all neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(packed(large, 2 * rows), "large-star")
        # small star: smaller neighbours and the node itself hang on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(packed(small.where("u <> v").distinct(), 2 * rows), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _compare(cell: pd.DataFrame) -> pd.DataFrame:
    """Likely pairs between components within each key, block and chunk of a cell.

    The rows to place (asks) meet the block's rows of other components; two rows that both ask meet once. With a
    component of more than SMALL classes, whole is true, and the likeliest pair stands for all pairs of its two
    components, whose names are x and y (smaller component first).
    """
    out = []
    for _, g in cell.groupby(["key", "block", "chunk"], sort=False):
        asked, held = g[g["asks"]], g[~g["asks"]]
        x = np.frombuffer(b"".join(held["registers"]), np.uint16).reshape(len(held), BANDS, ROWS)
        rid, root, n, size, top = (held[c].to_numpy() for c in ("rid", "root", "n", "members", "top"))
        for row in asked.itertuples(index=False):
            own = np.frombuffer(row.registers, np.uint16).reshape(BANDS, ROWS)
            other = np.flatnonzero((root != row.root) & ((root == top) | (rid > row.rid)))
            equal = x[other] == own
            same = equal.sum((1, 2))
            # a pair counts in the first band it shares
            first = equal.all(2).argmax(1) == row.band
            near = first & (same >= LIKELY * REGISTERS) & (100 * np.minimum(n[other], row.n) >= PERCENT * np.maximum(n[other], row.n))
            other, same = other[near], same[near]
            if not len(other):
                continue
            flat = x[other].reshape(len(other), REGISTERS)
            ok = likely(np.broadcast_to(own.reshape(REGISTERS), flat.shape), flat, np.full(len(other), row.n), n[other])
            other, same = other[ok], same[ok]
            small = (size[other] <= SMALL) & (row.members <= SMALL)
            # of large components, the pair with most equal registers
            picked = np.flatnonzero(~small)
            picked = picked[np.argsort(-same[picked], kind="stable")]
            picked = picked[np.unique(root[other[picked]], return_index=True)[1]]
            at = np.concatenate([np.flatnonzero(small), picked]).astype(np.int64)
            o, whole = other[at], ~small[at]
            if len(o):
                ahead = (size[o] < row.members) | ((size[o] == row.members) & (root[o] < row.root))
                pair = {"a": np.maximum(rid[o], row.rid), "b": np.minimum(rid[o], row.rid), "whole": whole, "x": np.where(ahead, root[o], row.root), "y": np.where(ahead, row.root, root[o]), "same": same[at]}
                out.append(pd.DataFrame(pair))
    return pd.concat(out).drop_duplicates() if out else pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype({"whole": bool})


def salted(left: DataFrame, right: DataFrame, key: str, row: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """left joined to right, which has one row for each key; a key's many rows on the left are dealt, by their column row, to salts copies of its row."""
    left = left.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    return left.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "__salt"], how).drop("__salt")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def other_components(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """FOUND: likely pairs of classes that share a bucket but no component.

    In a bucket the component with most classes (top) asks nothing: all other rows ask, and meet the whole bucket. A
    bucket's rows are dealt to blocks and the asking ones to chunks, of BLOCK rows each, before anything is joined to the
    bucket, so that no task gets a large bucket; each chunk meets each block.
    """
    sizes = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).cast("int").alias("members"))
    block = F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = members.where("size > 2").join(roots, members["rid"] == roots["node"], "left").select("key", "band", "rid", "size", block.alias("block"), F.coalesce("root", "rid").alias("root"))
    # partial sums first: one row for each component of a bucket and task
    per = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.first("size").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks, chunks = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil((F.col("size") - F.col("top.n")) / BLOCK).cast("int")
    mixed = materialize(per.select("key", F.col("top.root").alias("top"), blocks.alias("blocks"), chunks.alias("chunks"), "size", (F.col("size") - F.col("top.n")).alias("asking")), "mixed-buckets")
    work = mixed.agg(F.sum(F.col("size") * F.col("chunks") + F.col("asking") * F.col("blocks"))).first()[0] or 0
    rows = placed.join(mixed.select("key", "top", "blocks", "chunks", _every(F.col("blocks")).alias("block")), ["key", "block"])
    rows = salted(rows, sizes, "root", "rid", "left").withColumn("members", F.coalesce("members", F.lit(1))).drop("size")
    shape = lambda d, asks: d.select("key", "block", "chunk", "band", "rid", "root", "members", "top", F.lit(asks).alias("asks"))
    held = shape(rows.withColumn("chunk", _every(F.col("chunks"))), False)
    asked = rows.where("root <> top").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(1)), "chunks").cast("int")).withColumn("block", _every(F.col("blocks")))
    cells = held.unionByName(shape(asked, True)).join(classes.select("rid", "n", "registers"), "rid")
    groups = max(24, -(-work // (8 * BLOCK)))
    spread = F.pmod(F.xxhash64("key", "block", "chunk"), F.lit(groups))
    found = materialize(cells.groupBy(spread.alias("cell")).applyInPandas(_compare, FOUND), "cell-pairs")
    # a pair of large components is found from many sides: its likeliest pair of classes stands for all
    single = found.where("not whole").select("a", "b").distinct()
    whole = found.where("whole").groupBy("x", "y").agg(F.max(F.struct("same", "a", "b")).alias("m")).select(F.col("m.a").alias("a"), F.col("m.b").alias("b"), "x", "y")
    none = F.lit(None).cast("long")
    return materialize(single.select("a", "b", F.lit(False).alias("whole"), none.alias("x"), none.alias("y")).unionByName(whole.select("a", "b", F.lit(True).alias("whole"), "x", "y")), "likely-pairs")


def near_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """rid, doc_id, text_key, n, digest, component_id, kept for every row of docs(doc_id, text).

    kept is true for one row of each component: the smallest known doc_id, then the smallest rid.
    """
    rows = sketches(docs, width)
    filled = rows.where("n > 0")
    ahead = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")
    classes = filled.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("doc_id"), F.min(ahead).alias("ahead"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = materialize(classes, "classes")
    size = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("registers"), k * size + 1, F.lit(size))))
    keys = classes.select("rid", F.posexplode(bands).alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(keys.join(buckets, "key"), "members")

    # round 1: each class and the medoid of each of its buckets
    weight = members.groupBy("rid").agg(F.sum("size").alias("weight"))
    medoids = members.join(weight, "rid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rid")).alias("by_rid"))).alias("m"))
    star = members.join(medoids, "key").select("rid", (-F.col("m.by_rid")).alias("first")).where("rid <> first")
    star = star.select(F.greatest("rid", "first").alias("a"), F.least("rid", "first").alias("b")).distinct()
    side = lambda name: classes.select(F.col("rid").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    def probable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                yield pdf.loc[likely(x, y, pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()), ["a", "b"]]

    pairs = materialize(star.join(side("a"), "a").join(side("b"), "b").mapInPandas(probable, CELL), "star-pairs")
    nodes = lambda p: p.select(F.col("a").alias("rid")).unionByName(p.select(F.col("b").alias("rid")))
    n_pairs = pairs.count()
    links = verified(pairs, sets_of(nodes(pairs), 2 * n_pairs, classes, docs, width))
    roots = components(links)

    # round 2: buckets that still hold several components
    found = other_components(members, classes, roots)
    total = found.agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("whole")).first()
    if total["n"]:
        # first the likely pairs themselves, and of large components the likeliest
        single = found.select("a", "b").join(pairs, ["a", "b"], "left_anti")
        links = materialize(links.unionByName(verified(single, sets_of(nodes(single), 2 * total["n"], classes, docs, width))), "all-links")
        before, roots = roots, components(links)
        if total["whole"]:
            # then all classes of the components that are still apart
            renamed = lambda name, new: roots.select(F.col("node").alias(name), F.col("root").alias(new))
            apart = found.where("whole").select("x", "y").join(renamed("x", "rx"), "x", "left").join(renamed("y", "ry"), "y", "left")
            apart = materialize(apart.where("coalesce(rx, x) <> coalesce(ry, y)").select(F.col("x").alias("a"), F.col("y").alias("b")), "apart")
            n_apart = apart.count()
            if n_apart:
                everyone = before.select(F.col("node").alias("rid"), "root").unionByName(before.select(F.col("root").alias("rid"), "root").distinct())
                involved = nodes(apart).distinct().withColumnRenamed("rid", "root")
                grown = everyone.join(involved, "root", "left_semi").select("rid", "root").unionByName(involved.join(everyone, "root", "left_anti").select(F.col("root").alias("rid"), "root"))
                grown = materialize(packed(grown, 2 * (n_pairs + n_apart)), "grown")
                sets = sets_of(grown.select("rid"), 2 * (n_pairs + n_apart), classes, docs, width)
                roots = components(links.unionByName(linked_components(apart, grown, sets, 2 * (n_pairs + n_apart))))

    named = classes.join(roots, classes["rid"] == roots["node"], "left").select("digest", "ahead", F.coalesce("root", "rid").alias("root"))
    least = named.groupBy("root").agg(F.min("ahead").alias("least"))
    named = salted(named, least, "root", "digest").select("digest", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("survivor"))
    row = ["rid", "doc_id", "text_key", "n", "digest"]
    out = filled.select(*row).join(named, "digest").select(*row, "component_id", (F.col("rid") == F.col("survivor")).alias("kept"))
    return out.unionByName(rows.where("n = 0").select(*row, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def drop_near(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with one row of each component; columns unchanged."""
    # rows that repeat both doc_id and text are in one component, so a pair stays or goes as a whole; rows without words are in
    # none, and stay as they are
    groups = materialize(near_groups(docs, width).where("n > 0").select("doc_id", "text_key", "kept"), "near-groups")
    return only_kept(docs, {"text_key": text_key}, groups)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read(spark, sf_dir, "documents"), 2)
    return groups.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")
