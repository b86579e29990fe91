"""Mixing sources to target weights: floor(rate) copies of each document plus one hash-seeded Bernoulli copy.

Words are summed per source; sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by
weight. A target stops at CAP times its source's words and the excess is shared anew by weight until none is above.
That is a water level L with target = min(CAP * words, weight * L); sources sorted by CAP * words / weight fill up in
that order, so running sums over the source table give L without a loop. A document with rate = target / words is
emitted floor(rate) times, and once more if the hash of seed, doc_id and text falls under the fraction.

Only the table of sources (one row per source, a dimension) is sorted as one piece. It is joined back with Spark's own
choice of strategy: broadcast below Spark's size threshold, else shuffled with AQE's split of hot sources.

Edge cases: null text has no words, is never short of its target and gets taken = 0; a source without words gets target
0 and its documents are emitted once, as nothing is known about a rate; very long texts are counted and hashed whole;
documents without a doc_id, or with a repeated one, toss coins of their own if their texts differ; rows that repeat both
toss the same coin; a rate without fraction tosses none; an empty table gives an empty result; other columns are passed
on by ``mixture``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, unit_hash, word_count

#: Fixed values of the query.
WEIGHTS, CAP, SEED = 3, 3, "mix-1"
SPAN = 1 << 60


def source_rates(sizes: DataFrame, cap: int = CAP, weights: int = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target, rate from sizes(source, size)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % weights + 1).cast("long"))
    # full sources come first: cap * size / weight <= level
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns(
        {
            "level": (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    # the first source that stays under its cap at its level sets the level of all behind it
    under = F.when(F.col("weight") * F.col("level") <= cap * F.col("source_size"), F.col("level"))
    s = s.withColumn("set_level", F.first(under, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("weight") * F.col("set_level"), (cap * F.col("source_size")).cast("double"))
    s = s.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(target, (cap * F.col("source_size")).cast("double"))))
    rate = F.when(F.col("source_size") == 0, 1.0).otherwise(F.col("target") / F.col("source_size"))
    return s.select("source", "source_size", "weight", "target", rate.alias("rate"))


def text_digest(text: Column) -> Column:
    """Null for null."""
    return F.md5(text)


def with_copies(rows: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """rows(doc_id, digest, source, ...) with source_size, target and the number of copies; digest is that of the text."""
    r = rates.select(F.col("source").alias("r_source"), "source_size", "target", "rate")
    coin = unit_hash(seed, F.col("doc_id"), F.col("digest")) / F.lit(float(SPAN)) < F.col("rate") - F.floor("rate")
    joined = rows.join(r, rows["source"].eqNullSafe(r["r_source"]), "left")
    return joined.withColumn("copies", F.floor("rate") + F.when(coin, 1).otherwise(0)).drop("r_source", "rate")


def mixture(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Every row of docs as often as the mix takes it; columns unchanged. The module's edge cases hold."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = materialize(source_rates(sizes), "rates")
    # whole rows travel as one column, so that no name of theirs meets one of ours
    copies = with_copies(docs.select("doc_id", text_digest(F.col("text")).alias("digest"), "source", F.struct("*").alias("row")), rates, seed)
    return copies.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sizes = materialize(docs.select("doc_id", text_digest(F.col("text")).alias("digest"), "source", word_count(F.col("text")).alias("size")), "sizes")
    rates = materialize(source_rates(sizes), "rates")
    mixed = with_copies(sizes, rates)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = """
WITH d AS (
  SELECT doc_id, md5(text) AS digest, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS BIGINT)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS level
  FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE
           least(coalesce(weight * (SELECT max(level) FROM l WHERE weight * level <= 3 * source_size
             AND level = (SELECT arg_min(level, source_size / weight) FROM l WHERE weight * level <= 3 * source_size)), 3.0 * source_size), 3.0 * source_size) END AS target
  FROM l
), r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1.0 ELSE target / source_size END AS rate FROM t
), c AS (
  SELECT d.doc_id, d.size, r.source_size, CAST(r.target AS DOUBLE) AS target,
         CAST(floor(r.rate) + CASE WHEN CAST(('0x' || substr(sha256('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || coalesce(d.digest, 'null')), 1, 15)) AS BIGINT) / 1152921504606846976.0
              < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
