"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in the order of a seeded hash; the fractional rank (2 * rank - 1) / (2 * n) spreads
every source evenly over [0, 1). Sorting all rows by it interleaves the sources in proportion, and cutting the sorted
rows into equal runs gives shards whose counts are at most one apart (law ``rows``) and which all match the mixture.

No source is ranked in one task: rows are counted in BUCKETS hash ranges per source, running sums of the counts give each
range its first rank, and row_number works within a range. The fractional ranks are uniform, so the global position is
found alike, over BUCKETS ranges of [0, 1). Only narrow rows are shuffled.

Groups of equal texts are not held together: a group may hold a third of all rows, which no shard of an eighth can take, and the
method spreads what it ranks. The rows of a group are dealt like any others: its members have hashes of their own, so a group of n rows is
spread over the shards in proportion, and no shard gets more of it than chance gives.

Edge cases: very long texts are measured whole; ties of the fractional rank between sources go by hash, then source; null text has 1 byte (the plus 1) and checksum 0; null sources form one source; rows that repeat a doc_id
are ordered by checksum and size and otherwise interchangeable; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, unit_hash

SHARDS, SEED, BUCKETS = 8, "shard-1", 1024
SPAN = 1 << 60


def _first_ranks(counts: DataFrame, within: list[str], bucket: str) -> DataFrame:
    """For each bucket the number of rows before it, and the number in all."""
    w = Window.partitionBy(*within)
    before = F.sum("n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*within, bucket, F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs(doc_id, text, source)."""
    rows = docs.select(
        "doc_id",
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source")).alias("stratum"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        unit_hash(seed, F.col("doc_id")).alias("h"),
    ).withColumn("bucket", F.floor(F.col("h") / F.lit(SPAN // buckets)).cast("int"))
    rows = materialize(rows, "shard-rows")
    starts = materialize(_first_ranks(rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n")), ["stratum"], "bucket"), "shard-starts")
    order = ["h", F.asc_nulls_last("doc_id"), "text_crc32", "size"]
    ranked = (
        rows.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order)))
        .join(starts, ["stratum", "bucket"])
        .withColumn("share", (2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("total")))
        .withColumn("slice", F.least(F.floor(F.col("share") * buckets), F.lit(buckets - 1)).cast("int"))
        .select("doc_id", "stratum", "size", "text_crc32", "h", "share", "slice")
    )
    ranked = materialize(ranked, "shard-ranked")
    # one row per slice: BUCKETS rows in all, whatever the input
    places = materialize(_first_ranks(ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), [], "slice"), "shard-places")
    order = ["share", "h", "stratum", F.asc_nulls_last("doc_id"), "text_crc32", "size"]
    placed = (
        ranked.withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy(*order)))
        .join(places, "slice")
        .withColumn("at", F.col("before") + F.col("r") - 1)
        .withColumn("shard", F.floor(F.col("at") * shards / F.col("total")).cast("int"))
    )
    first = F.ceil(F.col("shard") * F.col("total") / F.lit(shards))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 in DuckDB's SQL: a fold over its bytes; a byte's table entry is the exclusive or of those of its bits."""
    entries = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        entries.append(f"{c} * ((xor(c, b) >> {bit}) & 1)")
    entry = entries[0]
    for e in entries[1:]:
        entry = f"xor({entry}, {e})"
    folded = f"list_reduce([CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode({text})), '..')], lambda c, b: xor(c >> 8, {entry}), CAST(4294967295 AS BIGINT))"
    return f"CASE WHEN coalesce({text}, '') = '' THEN 0 ELSE xor({folded}, 4294967295) END"


SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, CAST({_crc_sql("text")} AS BIGINT) AS text_crc32,
         CAST(('0x' || substr(sha256('shard-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS h
  FROM documents
), r AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, text_crc32, size) - 1 AS DOUBLE) / (2 * count(*) OVER (PARTITION BY source)) AS share FROM d
), a AS (
  SELECT *, row_number() OVER (ORDER BY share, h, source IS NULL, coalesce(source, ''), doc_id NULLS LAST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r
), s AS (
  SELECT *, place * 8 // n AS shard FROM a
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
