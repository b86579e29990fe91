"""Shared storage for intermediate tables, and small helpers used by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words and that normalisation deletes (fixed values).
BLANKS = " \t\n\x0b\x0c\r"

MOST_BITS = 1 << 27
_own_dirs: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where it is unset, a folder of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="turnloom-")
    return _own_dirs[app]


def table_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the JVM deletes it as it exits."""
    path = f"{shared_dir(spark)}/turnloom/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives the reader exact size statistics, so
    that Spark's own threshold decides about broadcasting it.
    """
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """df in no more partitions than its number of rows (known, or a bound of it) asks for."""
    return df.coalesce(max(1, -(-rows // per_task)))


def _with_bit(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, n: int, how: str) -> tuple[DataFrame, Column]:
    """Rows joined to their part of the wanted keys' bitmap, and whether their bit is set (null where no key has that part)."""
    bits = min(MOST_BITS, 1 << max(16, (8 * n).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    maps = wanted.select(F.bitmap_bucket_number(place(wanted_key)).alias("__bucket"), F.bitmap_bit_position(place(wanted_key)).alias("__bit"))
    maps = maps.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("__map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col("__bucket"), how)
    return joined, F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))).cast("int") % 2 == 1


def maybe_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, n: int) -> DataFrame:
    """Rows whose key may be among at most n wanted keys: a first filter, before rows are shuffled for an exact join.

    The wanted keys set bits of a hash bitmap of 8 to 16 bits a key, and of MOST_BITS at most, which is the bound of what is
    broadcast (16 MB). A full bitmap lets all rows pass.
    """
    joined, is_set = _with_bit(rows, key, wanted, wanted_key, n, "inner")
    return joined.where(is_set).drop("__bucket", "__map")


def never_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, n: int) -> DataFrame:
    """The other rows: those that ``maybe_in`` leaves out."""
    joined, is_set = _with_bit(rows, key, wanted, wanted_key, n, "left")
    return joined.where(~F.coalesce(is_set, F.lit(False))).drop("__bucket", "__map")


def only_kept(docs: DataFrame, key: dict[str, Callable[[Column], Column]], groups: DataFrame) -> DataFrame:
    """docs with the rows that groups(doc_id, *key, kept) keeps, of several alike one; columns unchanged.

    groups has a row for each row of docs, but for rows that stay anyhow; key gives its columns from the text. Rows whose doc_id
    has nothing to do with those that go or are repeated pass where they are read; only the others travel, for the exact join.
    """
    names = ["doc_id", *key]
    some = groups.groupBy(*(F.col(c).alias(f"__{c}") for c in names)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("c"))
    some = materialize(some.where("not kept or c > 1").drop("c"), "gone-or-repeated")
    n, n_repeated = some.agg(F.count(F.lit(1)), F.count_if("kept")).first()
    # whole rows go as one column, so that no name of theirs meets one of ours
    rows = docs.select("doc_id", F.struct("*").alias("row"))
    sought = (F.col("doc_id"), some, F.col("__doc_id"), n)
    near = maybe_in(rows, *sought).select("doc_id", *(made(F.col("row.text")).alias(c) for c, made in key.items()), "row")
    # an outer join and keys that may be null: Spark moves semi and anti joins, and tests for null, below the first filter
    same = reduce(and_, (near[c].eqNullSafe(some[f"__{c}"]) for c in names))
    judged = near.join(some, same, "left").select(*(near[c] for c in names), "row", F.coalesce(F.col("kept").cast("int"), F.lit(2)).alias("state"))
    out = never_in(rows, *sought).select("row.*").union(judged.where("state = 2").select("row.*"))
    return out.union(judged.where("state = 1").dropDuplicates(names).select("row.*")) if n_repeated else out


def word_count(text: Column) -> Column:
    """Number of runs of characters outside BLANKS; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(seed: str, *keys: Column) -> Column:
    """A long in 0 .. 2^60 - 1 from the SHA-256 of seed and keys, alike in any engine."""
    texts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.concat_ws(":", *texts)), 256), 1, 15), 16, 10).cast("long")
