"""URL filter: host-suffix and path-prefix expressions joined on short hash prefixes, then confirmed.

Each URL is expanded into (host suffix, directory prefix) expressions, no deeper than the deepest rule. A rule is filed
under its host and the directory part of its path. The expressions meet the rules in an equi-join on the first 8 hex
digits of their SHA-256; a pair then counts if the full digests are equal and the URL's path starts with the whole path
of the rule. The longest rule wins (host plus path in code points, then the longer host, then block before allow).

Rules are a table; Spark broadcasts it only below its own size threshold and shuffles it otherwise, where AQE may split
a hot rule's URLs. Only partial aggregates are shuffled: one row per URL.

Edge cases: very long URLs are expanded no deeper than the deepest rule; a null URL or one without ``://`` has an empty host and path and gets no rule, hence ``default``. Repeated
rows are returned as often as they come. Null page ids are kept. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Fixed values of the query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX, SALTS = 8, 64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def directory(path: Column) -> Column:
    """The path up to and with its last slash; empty if it has none."""
    return F.regexp_extract(path, r"(?s)\A(.*/)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, r_host string, r_path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url)."""
    rules = rules.where("action in ('allow', 'block') and r_host is not null and r_path is not null").select(
        "action", "r_host", "r_path", F.sha2(F.concat("r_host", F.lit("\n"), directory(F.col("r_path"))), 256).alias("r_digest")
    )
    rules = rules.withColumn("r_key", F.substring("r_digest", 1, PREFIX))
    deepest = rules.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.length("r_path") - F.length(F.translate("r_path", "/", ""))).alias("slashes"),
    ).first()
    labels, slashes = deepest["labels"] or 1, deepest["slashes"] or 0
    # copies of a row are counted in SALTS groups, so that no task must give all of them back
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    urls = pages.select("page_id", "url", salt.alias("salt")).groupBy("page_id", "url", "salt").agg(F.count(F.lit(1)).alias("copies"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    suffixes = F.expr(
        f"transform(sequence(1, least({labels}, length(host) - length(translate(host, '.', '')) + 1)), n -> substring_index(host, '.', -n))"
    )
    prefixes = F.expr(
        f"transform(sequence(0, least({slashes}, length(path) - length(translate(path, '/', '')))),"
        " n -> case when n = 0 then '' else concat(substring_index(path, '/', n), '/') end)"
    )
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    expanded = urls.withColumn("expression", F.explode(expressions))
    expanded = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn("key", F.substring("digest", 1, PREFIX))
    fits = (F.col("key") == F.col("r_key")) & (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    precedence = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("len"),
        F.length("r_host").alias("host_len"),
        F.col("action").alias("verdict"),
        F.concat("r_host", "r_path").alias("rule"),
    )
    judged = (
        expanded.join(rules, fits, "left")
        .groupBy("page_id", "url", "salt")
        .agg(
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.first("copies").alias("copies"),
            F.max(F.when(F.col("action").isNotNull(), precedence)).alias("best"),
        )
    )
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), rule_table(spark, RULES))


SQL = """
WITH u AS (
  SELECT page_id,
         CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
         row_number() OVER () AS k
  FROM u
), r(verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT h.*, r.r_host || r.r_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY k ORDER BY length(r.r_host || r.r_path) DESC) AS n
  FROM h LEFT JOIN r ON (h.host = r.r_host OR ends_with(h.host, '.' || r.r_host)) AND starts_with(h.path, r.r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
