"""Queries over texts: capping, sentences, words, paths, hashing, token estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import hashing, text, tokens
from turnloom.operators.structure import in_order
from turnloom.sources.tables import read
from turnloom.sources.transcript import WITH_TRANSCRIPT, transcript

STOP = ["the", "and", "for", "use", "area", "always", "before", "never", "instead", "correction", "prepare", "ship", "boxes", "customer"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def _column(table: str, key: list[str], **columns: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read(spark, sf_dir, table).select(*key, *(f(F.col("text")).alias(n) for n, f in columns.items()))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript(spark, sf_dir).where("role = 'user'")


def user_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = users(spark, sf_dir).select("session_id", "idx", F.posexplode(text.sentences(F.col("content"))).alias("pos", "sentence"))
    return s.select("session_id", "idx", "pos", "sentence", text.normal_sentence(F.col("sentence")).alias("norm"))


def user_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select("session_id", "idx", F.array_join(F.array_sort(text.content_words(F.col("content"), STOP)), " ").alias("words"))


def user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select("session_id", "idx", F.explode(text.explicit_ids(F.col("content"))).alias("id"))


def superseded_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier messages of the session that share an explicit id with a later one."""
    ids = user_ids(spark, sf_dir)
    later = ids.select("session_id", "id", F.col("idx").alias("later"))
    return ids.join(later, ["session_id", "id"]).where("idx < later").select("session_id", "id", "idx", "later")


def superseded_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each later sentence its best earlier sentence of the session by overlap coefficient of 0.34 or more, ties newest.

    Sentences meet through their words, so only those that share one are compared.
    """
    s = user_sentences(spark, sf_dir).withColumn("words", text.content_words(F.col("sentence"), STOP)).where(F.size("words") > 0)
    s = s.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("idx", "pos"))).select("session_id", "seq", "words")
    w = s.select("session_id", "seq", F.size("words").alias("n"), F.explode("words").alias("word"))
    old = w.select("session_id", "word", F.col("seq").alias("old"), F.col("n").alias("old_n"))
    shared = w.join(old, ["session_id", "word"]).where("old < seq").groupBy("session_id", "seq", "old", "n", "old_n").agg(F.count(F.lit(1)).alias("c"))
    scored = shared.withColumn("permille", F.floor(1000 * F.col("c") / F.least("n", "old_n")).cast("long")).where("permille >= 340")
    best = F.row_number().over(Window.partitionBy("session_id", "seq").orderBy(F.desc("permille"), F.desc("old")))
    return scored.withColumn("r", best).where("r = 1").select("session_id", "seq", "old", "permille")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that heads each file result."""
    r = transcript(spark, sf_dir).where("role = 'tool' and tool_name = 'read_file'")
    return r.select("session_id", "idx", F.regexp_extract("content", r"^((?:[\w.@-]+/)+[\w.@-]+\.[A-Za-z0-9]{1,8})", 1).alias("path"))


def path_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one file in a session: an equi-join on the last two segments, then the exact test."""
    p = paths(spark, sf_dir)
    p = p.withColumn("path", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("./"), "path")).when(F.col("idx") % 3 == 0, F.concat(F.lit("app/"), "path")).otherwise(F.col("path")))
    p = p.withColumn("key", text.path_key(F.col("path")))
    a = p.select("session_id", "key", F.col("idx").alias("a"), F.col("path").alias("path_a"))
    b = p.select("session_id", "key", F.col("idx").alias("b"), F.col("path").alias("path_b"))
    return a.join(b, ["session_id", "key"]).where((F.col("a") < F.col("b")) & text.same_path(F.col("path_a"), F.col("path_b"))).select("session_id", "a", "b", "path_a", "path_b")


def tail_recurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a session that do not recur in its last four messages (left anti join on the key and the exact test)."""
    p = paths(spark, sf_dir).withColumn("key", text.path_key(F.col("path")))
    n = transcript(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(n, "session_id")
    tail = p.where("idx >= n - 4").select(F.col("session_id").alias("s"), F.col("key").alias("k"), F.col("path").alias("p"))
    rest = p.where("idx < n - 4")
    kept = rest.join(tail, (F.col("session_id") == F.col("s")) & (F.col("key") == F.col("k")) & text.same_path(F.col("path"), F.col("p")), "left_anti")
    return kept.select("session_id", "idx", "path")


#: Paths shown of a session and of one result.
TOTAL_PATHS, RESULT_PATHS = 20, 3


def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths of a session, those of configurations first, then in order of appearance; few a result and a session."""
    config = text.config_like(F.col("path"))
    each = F.row_number().over(Window.partitionBy("session_id", "idx").orderBy(F.desc(config), "path"))
    first = paths(spark, sf_dir).withColumn("k", each).where(F.col("k") <= RESULT_PATHS).groupBy("session_id", "path").agg(F.min("idx").alias("idx"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(config), "idx", "path")).cast("int"))
    return ranked.where(F.col("r") <= TOTAL_PATHS).select("session_id", "path", "r")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", hashing.message_digest({"role": F.col("role"), "content": F.col("text")}).alias("digest"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digests(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "digest"))).alias("m"))
    keys = hashing.chain_keys(F.transform("m", lambda x: x["digest"]))
    return d.select("conv_id", F.posexplode(keys).alias("i", "key"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose digest appears for the first time in their session."""
    log = transcript(spark, sf_dir).withColumn("digest", F.sha2(F.concat_ws("|", "role", "content", "call_id"), 256))
    first = F.min("idx").over(Window.partitionBy("session_id", "digest"))
    return log.withColumn("fresh", F.col("idx") == first).groupBy("session_id").agg(F.count_if("fresh").cast("long").alias("fresh"), F.count(F.lit(1)).alias("n"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = transcript(spark, sf_dir).where("content <> ''")
    return log.select("session_id", "idx", tokens.content_class(F.col("content")).alias("class"))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = transcript(spark, sf_dir).withColumn("class", tokens.content_class(F.col("content")))
    return log.select("session_id", "idx", (tokens.estimate(F.col("content"), F.col("class")) + tokens.MESSAGE_OVERHEAD).alias("tokens"))


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each session, running total by message, and whether it is within 61,000."""
    e = estimates(spark, sf_dir)
    total = e.withColumn("running", F.sum("tokens").over(in_order())).groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"), F.max("running").alias("running"))
    return total.select("session_id", "tokens", "largest", (F.col("running") <= 61000).alias("fits"))


def document_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per document by its content class. The SQL states the estimate of plain Latin prose only."""
    d = read(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    return d.select("doc_id", tokens.estimate(F.col("t")).alias("tokens"))


def test_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = transcript(spark, sf_dir).where("role = 'tool' and tool_name = 'run_tests'")
    count = lambda what: F.coalesce(F.regexp_extract("content", rf"(\d+) {what}", 1).cast("long"), F.lit(0))
    return r.select("session_id", "idx", count("passed").alias("passed"), count("failed").alias("failed"), (count("failed") > 0).alias("red"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = transcript(spark, sf_dir).where("role = 'tool'").where(F.col("content").contains("[ref="))
    refs = (F.length("content") - F.length(F.replace("content", F.lit("[ref="), F.lit("")))) / 5
    return r.select(
        "session_id", "idx", F.regexp_extract("content", r"(?m)^- Page URL: (.*)$", 1).alias("url"), F.regexp_extract("content", r"(?m)^- Page Title: (.*)$", 1).alias("title"), refs.cast("long").alias("refs"), (refs >= 10).alias("snapshot")
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged sentences of assistants: decisions and open points."""
    a = transcript(spark, sf_dir).where("role = 'assistant'")
    a = a.select("session_id", "idx", F.regexp_extract("content", r"^(DECISION|TODO): (.*)$", 1).alias("tag"), F.regexp_extract("content", r"^(DECISION|TODO): (.*)$", 2).alias("item"))
    return a.where("tag <> ''").select("session_id", "idx", F.lower("tag").alias("tag"), "item")


#: What is shown whole, and what of the head and tail of longer texts.
VERBATIM, HEAD, TAIL = 300, 240, 160


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results: short ones verbatim; else head and tail and the number of code points left out."""
    t = F.trim(F.coalesce("text", F.lit("")))
    left = F.length(t) - HEAD - TAIL
    cut = F.concat(F.substring(t, 1, HEAD), F.lit("["), left.cast("string"), F.lit(" left out]"), F.right(t, F.lit(TAIL)))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.when((F.length(t) <= VERBATIM) | (left <= 0), t).otherwise(cut)).alias("excerpt"))


def globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per tool role by glob."""
    roles = {"browser": "browser_*", "shell": "run_*", "file": "*_file"}
    log = transcript(spark, sf_dir).where("tool_name is not null")
    role = F.lit("other")
    for name, glob in roles.items():
        role = F.when(F.col("tool_name").rlike(text.glob_pattern(glob)), name).otherwise(role)
    return log.groupBy(role.alias("tool_role")).agg(F.count(F.lit(1)).alias("messages"))


QUERIES = {
    "f01_collapse": _column("documents", ["doc_id"], collapsed=lambda t: F.md5(text.collapse(t))),
    "f02_cap_head": _column("documents", ["doc_id"], capped=lambda t: text.cap_head(t, 80)),
    "f03_cap_head_tail": _column("documents", ["doc_id"], capped=lambda t: text.cap_head_tail(t, 90)),
    "f05_lengths": _column("documents", ["doc_id"], points=lambda t: F.length(t).cast("long"), units=text.utf16_length, bytes=lambda t: F.octet_length(t).cast("long")),
    "f06_grouped": lambda spark, sf_dir: read(spark, sf_dir, "orders").select("o_orderkey", text.grouped(F.col("o_orderkey") * 1237).alias("shown")),
    "f08_think": lambda spark, sf_dir: read(spark, sf_dir, "conversations").withColumn("t", F.concat(F.lit("<think>"), F.col("role"), F.lit("</think>"), "text")).select("conv_id", "turn", text.visible(F.col("t")).alias("visible"), text.reasoning(F.col("t")).alias("reasoning")),
    "f12_sentences": user_sentences,
    "f14_content_words": user_words,
    "f15_explicit_ids": user_ids,
    "f25_paths": paths,
    "j03_same_path": path_spellings,
    "j04_recurs_anti": tail_recurs,
    "j06_overlap_candidates": superseded_by_words,
    "j07_superseded_by_id": superseded_by_id,
    "t04_top_paths": top_paths,
    "h02_digests": digests,
    "h03_chain_keys": chains,
    "w14_fresh": first_seen,
    "x01_text_stats": lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in tokens.stats(F.coalesce("text", F.lit(""))).items())),
    "x02_content_class": classes,
    "x03_document_estimates": document_estimates,
    "x06_message_estimates": estimates,
    "a32_request_counts": request_counts,
    "x10_snapshots": snapshots,
    "x12_test_tallies": test_tallies,
    "x13_excerpts": excerpts,
    "x15_tags": tags,
    "p10_tool_globs": globs,
}

_SENTENCES = f"""{WITH_TRANSCRIPT}, s AS (
  SELECT session_id, idx, [trim(x) FOR x IN string_split(replace(regexp_replace(content, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) IF trim(x) <> ''] AS list
  FROM transcript WHERE role = 'user'
), sentences AS (
  SELECT session_id, idx, CAST(pos - 1 AS INTEGER) AS pos, list[pos] AS sentence FROM (SELECT *, unnest(generate_series(1, len(list))) AS pos FROM s)
)"""
_WORDS = "[w FOR w IN list_distinct([lower(x) FOR x IN regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]{{3,}}')]) IF w NOT IN (" + _STOP_SQL + ")]"
_IDS = f"""{WITH_TRANSCRIPT}, ids AS (
  SELECT DISTINCT session_id, idx, unnest(regexp_extract_all(content, '\\b[A-Z]{{2,}}(?:-[A-Z0-9]+)*-[A-Z]*[0-9][A-Z0-9]*\\b')) AS id FROM transcript WHERE role = 'user'
)"""
_PATHS = f"""{WITH_TRANSCRIPT}, paths AS (
  SELECT session_id, idx, regexp_extract(content, '^((?:[\\w.@-]+/)+[\\w.@-]+\\.[A-Za-z0-9]{{1,8}})', 1) AS path FROM transcript WHERE role = 'tool' AND tool_name = 'read_file'
)"""
_SAME = """({0} = {1} OR regexp_replace({0}, '^(?:\\./)+', '') = regexp_replace({1}, '^(?:\\./)+', '')
  OR (contains(regexp_replace({0}, '^(?:\\./)+', ''), '/') AND ends_with({1}, '/' || regexp_replace({0}, '^(?:\\./)+', '')))
  OR (contains(regexp_replace({1}, '^(?:\\./)+', ''), '/') AND ends_with({0}, '/' || regexp_replace({1}, '^(?:\\./)+', ''))))"""
_CLASS = f"""{WITH_TRANSCRIPT}, classes AS MATERIALIZED (
  SELECT session_id, idx, content, CASE
    WHEN (length(content) - length(replace(content, '[ref=', ''))) / 5 >= 10 AND contains(content, 'Page URL:') THEN 'snapshot'
    WHEN regexp_matches(content, '(?m)\\b\\d+ (?:passed|failed|skipped|flaky)\\b|^Running \\d+ tests? using') THEN 'testOutput'
    WHEN len([x FOR x IN string_split(content, chr(10)) IF regexp_matches(x, '^\\s*(?:import|export|const)\\b|[;{{}}(]\\s*$')]) >= 0.3 * len([x FOR x IN string_split(content, chr(10)) IF trim(x) <> '']) THEN 'code'
    ELSE 'prose' END AS class
  FROM transcript WHERE content <> ''
)"""
_ESTIMATES = _CLASS + """, estimates AS (
  SELECT t.session_id, t.idx, CAST(8 + CASE WHEN t.content = '' THEN 0 ELSE
    ceil(length(t.content) / CASE class WHEN 'snapshot' THEN CAST(2.9 AS DOUBLE) WHEN 'testOutput' THEN CAST(2.5 AS DOUBLE) WHEN 'code' THEN CAST(4.1 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END * CAST(1.1 AS DOUBLE)) END AS BIGINT) AS tokens
  FROM transcript t LEFT JOIN classes c ON c.session_id = t.session_id AND c.idx = t.idx
)"""
_UNITS16 = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
_WS = "[\\s\\x{00A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0b]"

SQL = {
    "f01_collapse": f"SELECT doc_id, md5(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS collapsed FROM documents",
    "f02_cap_head": f"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 80), '{_WS}+$', '') || '…' END AS capped FROM documents",
    "f03_cap_head_tail": f"SELECT doc_id, CASE WHEN length(text) <= 90 THEN text ELSE regexp_replace(substring(text, 1, 60), '{_WS}+$', '') || ' […] ' || regexp_replace(right(text, 30), '^{_WS}+', '') END AS capped FROM documents",
    "f05_lengths": f"SELECT doc_id, length(text) AS points, CAST({_UNITS16.format('text')} AS BIGINT) AS units, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "f06_grouped": "SELECT o_orderkey, format('{:,}', o_orderkey * 1237) AS shown FROM orders",
    "f08_think": "SELECT conv_id, turn, text AS visible, role AS reasoning FROM conversations",
    "f12_sentences": f"{_SENTENCES} SELECT *, trim(regexp_replace(regexp_replace(lower(sentence), '\\s+', ' ', 'g'), '[ .!?;:,]+$', '')) AS norm FROM sentences",
    "f14_content_words": f"{WITH_TRANSCRIPT} SELECT session_id, idx, array_to_string(list_sort({_WORDS.format('content')}), ' ') AS words FROM transcript WHERE role = 'user'",
    "f15_explicit_ids": f"{_IDS} SELECT session_id, idx, id FROM ids WHERE regexp_matches(id, '[0-9]')",
    "f25_paths": f"{_PATHS} SELECT * FROM paths",
    "j03_same_path": f"""{_PATHS.replace("paths AS (", "paths AS MATERIALIZED (")}, p AS MATERIALIZED (
  SELECT *, regexp_extract(regexp_replace(path, '^(?:\\./)+', ''), '([^/]+/[^/]+)$', 1) AS k FROM (SELECT session_id, idx, CASE WHEN idx % 2 = 0 THEN './' || path WHEN idx % 3 = 0 THEN 'app/' || path ELSE path END AS path FROM paths)
) SELECT a.session_id, a.idx AS a, b.idx AS b, a.path AS path_a, b.path AS path_b FROM p a JOIN p b ON a.session_id = b.session_id AND a.k = b.k AND a.idx < b.idx
WHERE {_SAME.format('a.path', 'b.path')}""",
    "j04_recurs_anti": f"""{_PATHS}, n AS (SELECT session_id, count(*) AS n FROM transcript GROUP BY 1), p AS (SELECT * FROM paths JOIN n USING (session_id))
SELECT session_id, idx, path FROM p WHERE idx < n - 4 AND NOT EXISTS (
  SELECT 1 FROM p q WHERE q.session_id = p.session_id AND q.idx >= q.n - 4 AND {_SAME.format('q.path', 'p.path')})""",
    "j06_overlap_candidates": f"""{_SENTENCES}, w AS (
  SELECT session_id, idx, pos, {_WORDS.format('sentence')} AS words FROM sentences
), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY idx, pos) AS INTEGER) AS seq FROM w WHERE len(words) > 0), p AS (
  SELECT a.session_id, a.seq, b.seq AS old, CAST(floor(1000 * len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words))) AS BIGINT) AS permille
  FROM n a JOIN n b ON a.session_id = b.session_id AND b.seq < a.seq
) SELECT session_id, seq, old, permille FROM p WHERE permille >= 340 QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY permille DESC, old DESC) = 1""",
    "j07_superseded_by_id": f"{_IDS} SELECT a.session_id, a.id, a.idx, b.idx AS later FROM ids a JOIN ids b ON a.session_id = b.session_id AND a.id = b.id AND a.idx < b.idx WHERE regexp_matches(a.id, '[0-9]')",
    "t04_top_paths": f"""{_PATHS}, f AS (SELECT session_id, path, min(idx) AS idx, regexp_matches(lower(path), '\\.(json|toml|ini|env|conf|cfg|properties|ya?ml)$') AS config FROM paths GROUP BY 1, 2)
SELECT session_id, path, CAST(row_number() OVER (PARTITION BY session_id ORDER BY config DESC, idx, path) AS INTEGER) AS r FROM f QUALIFY r <= 20""",
    "h02_digests": digests,
    "h03_chain_keys": chains,
    "w14_fresh": first_seen,
    "x01_text_stats": lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in tokens.stats(F.coalesce("text", F.lit(""))).items())),
    "x02_content_class": classes,
    "x03_document_estimates": document_estimates,
    "x06_message_estimates": estimates,
    "a32_request_counts": request_counts,
    "x10_snapshots": snapshots,
    "x12_test_tallies": test_tallies,
    "x13_excerpts": excerpts,
    "x15_tags": tags,
    "p10_tool_globs": globs,
}

_SENTENCES = f"""{WITH_TRANSCRIPT}, s AS (
  SELECT session_id, idx, [trim(x) FOR x IN string_split(replace(regexp_replace(content, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) IF trim(x) <> ''] AS list
  FROM transcript WHERE role = 'user'
), sentences AS (
  SELECT session_id, idx, CAST(pos - 1 AS INTEGER) AS pos, list[pos] AS sentence FROM (SELECT *, unnest(generate_series(1, len(list))) AS pos FROM s)
)"""
_WORDS = "[w FOR w IN list_distinct([lower(x) FOR x IN regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]{{3,}}')]) IF w NOT IN (" + _STOP_SQL + ")]"
_IDS = f"""{WITH_TRANSCRIPT}, ids AS (
  SELECT DISTINCT session_id, idx, unnest(regexp_extract_all(content, '\\b[A-Z]{{2,}}(?:-[A-Z0-9]+)*-[A-Z]*[0-9][A-Z0-9]*\\b')) AS id FROM transcript WHERE role = 'user'
)"""
_PATHS = f"""{WITH_TRANSCRIPT}, paths AS (
  SELECT session_id, idx, regexp_extract(content, '^((?:[\\w.@-]+/)+[\\w.@-]+\\.[A-Za-z0-9]{{1,8}})', 1) AS path FROM transcript WHERE role = 'tool' AND tool_name = 'read_file'
)"""
_SAME = """({0} = {1} OR regexp_replace({0}, '^(?:\\./)+', '') = regexp_replace({1}, '^(?:\\./)+', '')
  OR (contains(regexp_replace({0}, '^(?:\\./)+', ''), '/') AND ends_with({1}, '/' || regexp_replace({0}, '^(?:\\./)+', '')))
  OR (contains(regexp_replace({1}, '^(?:\\./)+', ''), '/') AND ends_with({0}, '/' || regexp_replace({1}, '^(?:\\./)+', ''))))"""
_CLASS = f"""{WITH_TRANSCRIPT}, classes AS MATERIALIZED (
  SELECT session_id, idx, content, CASE
    WHEN (length(content) - length(replace(content, '[ref=', ''))) / 5 >= 10 AND contains(content, 'Page URL:') THEN 'snapshot'
    WHEN regexp_matches(content, '(?m)\\b\\d+ (?:passed|failed|skipped|flaky)\\b|^Running \\d+ tests? using') THEN 'testOutput'
    WHEN len([x FOR x IN string_split(content, chr(10)) IF regexp_matches(x, '^\\s*(?:import|export|const)\\b|[;{{}}(]\\s*$')]) >= 0.3 * len([x FOR x IN string_split(content, chr(10)) IF trim(x) <> '']) THEN 'code'
    ELSE 'prose' END AS class
  FROM transcript WHERE content <> ''
)"""
_ESTIMATES = _CLASS + """, estimates AS (
  SELECT t.session_id, t.idx, CAST(8 + CASE WHEN t.content = '' THEN 0 ELSE
    ceil(length(t.content) / CASE class WHEN 'snapshot' THEN CAST(2.9 AS DOUBLE) WHEN 'testOutput' THEN CAST(2.5 AS DOUBLE) WHEN 'code' THEN CAST(4.1 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END * CAST(1.1 AS DOUBLE)) END AS BIGINT) AS tokens
  FROM transcript t LEFT JOIN classes c ON c.session_id = t.session_id AND c.idx = t.idx
)"""
_UNITS16 = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
_WS = "[\\s\\x{00A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0b]"

SQL = {
    "f01_collapse": f"SELECT doc_id, md5(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS collapsed FROM documents",
    "f02_cap_head": f"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 80), '{_WS}+$', '') || '…' END AS capped FROM documents",
    "f03_cap_head_tail": f"SELECT doc_id, CASE WHEN length(text) <= 90 THEN text ELSE regexp_replace(substring(text, 1, 60), '{_WS}+$', '') || ' […] ' || regexp_replace(right(text, 30), '^{_WS}+', '') END AS capped FROM documents",
    "f05_lengths": f"SELECT doc_id, length(text) AS points, CAST({_UNITS16.format('text')} AS BIGINT) AS units, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "f06_grouped": "SELECT o_orderkey, format('{:,}', o_orderkey * 1237) AS shown FROM orders",
    "f08_think": "SELECT conv_id, turn, text AS visible, role AS reasoning FROM conversations",
    "f12_sentences": f"{_SENTENCES} SELECT *, trim(regexp_replace(regexp_replace(lower(sentence), '\\s+', ' ', 'g'), '[ .!?;:,]+$', '')) AS norm FROM sentences",
    "f14_content_words": f"{WITH_TRANSCRIPT} SELECT session_id, idx, array_to_string(list_sort({_WORDS.format('content')}), ' ') AS words FROM transcript WHERE role = 'user'",
    "f15_explicit_ids": f"{_IDS} SELECT session_id, idx, id FROM ids WHERE regexp_matches(id, '[0-9]')",
    "f25_paths": f"{_PATHS} SELECT * FROM paths",
    "j03_same_path": f"""{_PATHS.replace("paths AS (", "paths AS MATERIALIZED (")}, p AS MATERIALIZED (
  SELECT *, regexp_extract(regexp_replace(path, '^(?:\\./)+', ''), '([^/]+/[^/]+)$', 1) AS k FROM (SELECT session_id, idx, CASE WHEN idx % 2 = 0 THEN './' || path WHEN idx % 3 = 0 THEN 'app/' || path ELSE path END AS path FROM paths)
) SELECT a.session_id, a.idx AS a, b.idx AS b, a.path AS path_a, b.path AS path_b FROM p a JOIN p b ON a.session_id = b.session_id AND a.k = b.k AND a.idx < b.idx
WHERE {_SAME.format('a.path', 'b.path')}""",
    "j04_recurs_anti": f"""{_PATHS}, n AS (SELECT session_id, count(*) AS n FROM transcript GROUP BY 1), p AS (SELECT * FROM paths JOIN n USING (session_id))
SELECT session_id, idx, path FROM p WHERE idx < n - 4 AND NOT EXISTS (
  SELECT 1 FROM p q WHERE q.session_id = p.session_id AND q.idx >= q.n - 4 AND {_SAME.format('q.path', 'p.path')})""",
    "j06_overlap_candidates": f"""{_SENTENCES}, w AS (
  SELECT session_id, idx, pos, {_WORDS.format('sentence')} AS words FROM sentences
), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY idx, pos) AS INTEGER) AS seq FROM w WHERE len(words) > 0), p AS (
  SELECT a.session_id, a.seq, b.seq AS old, CAST(floor(1000 * len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words))) AS BIGINT) AS permille
  FROM n a JOIN n b ON a.session_id = b.session_id AND b.seq < a.seq
) SELECT session_id, seq, old, permille FROM p WHERE permille >= 340 QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY permille DESC, old DESC) = 1""",
    "j07_superseded_by_id": f"{_IDS} SELECT a.session_id, a.id, a.idx, b.idx AS later FROM ids a JOIN ids b ON a.session_id = b.session_id AND a.id = b.id AND a.idx < b.idx WHERE regexp_matches(a.id, '[0-9]')",
    "t04_top_paths": f"""{_PATHS}, f AS (SELECT session_id, path, min(idx) AS idx FROM paths GROUP BY 1, 2)
SELECT session_id, path, CAST(row_number() OVER (PARTITION BY session_id ORDER BY idx, path) AS INTEGER) AS r FROM f QUALIFY r <= 20""",
    "h02_digests": "SELECT conv_id, turn, sha256('{\"content\":' || CAST(to_json(text) AS VARCHAR) || ',\"role\":' || CAST(to_json(role) AS VARCHAR) || '}') AS digest FROM conversations",
    "h03_chain_keys": """
WITH RECURSIVE m AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i, sha256('{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}') AS d FROM conversations
), k AS (
  SELECT conv_id, i, sha256(sha256('chain/1') || d) AS key FROM m WHERE i = 0
  UNION ALL SELECT m.conv_id, m.i, sha256(k.key || m.d) FROM k JOIN m ON m.conv_id = k.conv_id AND m.i = k.i + 1
) SELECT conv_id, i, key FROM k""",
    "w14_fresh": f"""{WITH_TRANSCRIPT}, d AS (SELECT session_id, idx, concat_ws('|', role, content, call_id) AS d FROM transcript)
SELECT session_id, count(DISTINCT d) AS fresh, count(*) AS n FROM d GROUP BY 1""",
    "x01_text_stats": f"""SELECT doc_id, CAST({_UNITS16.format('t')} AS BIGINT) AS chars, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace(regexp_replace(t, '[\\x{{0}}-\\x{{36F}}]', '', 'g'), '[^\\p{{L}}]', '', 'g')) AS non_latin_letters,
  length(regexp_replace(regexp_replace(t, '[\\x{{0}}-\\x{{36F}}]', '', 'g'), '[^\\p{{M}}]', '', 'g')) AS non_latin_marks FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "x02_content_class": f"{_CLASS} SELECT session_id, idx, class FROM classes",
    "x03_document_estimates": "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / CAST(5.0 AS DOUBLE) * CAST(1.1 AS DOUBLE)) AS BIGINT) AS tokens FROM documents",
    "x06_message_estimates": f"{_ESTIMATES} SELECT session_id, idx, tokens FROM estimates",
    "a32_request_counts": f"{_ESTIMATES} SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS largest, sum(tokens) <= 61000 AS fits FROM estimates GROUP BY 1",
    "x10_snapshots": f"""{WITH_TRANSCRIPT} SELECT session_id, idx, regexp_extract(content, '(?m)^- Page URL: (.*)$', 1) AS url, regexp_extract(content, '(?m)^- Page Title: (.*)$', 1) AS title,
  CAST((length(content) - length(replace(content, '[ref=', ''))) / 5 AS BIGINT) AS refs, (length(content) - length(replace(content, '[ref=', ''))) / 5 >= 10 AS snapshot
FROM transcript WHERE role = 'tool' AND contains(content, '[ref=')""",
    "x12_test_tallies": f"""{WITH_TRANSCRIPT}, t AS (SELECT session_id, idx, CAST(regexp_extract(content, '(\\d+) passed', 1) AS BIGINT) AS passed, CAST(regexp_extract(content, '(\\d+) failed', 1) AS BIGINT) AS failed
  FROM transcript WHERE role = 'tool' AND tool_name = 'run_tests') SELECT *, failed > 0 AS red FROM t""",
    "x13_excerpts": """WITH d AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) <= 400 THEN t ELSE substring(t, 1, 240) || '[' || (length(t) - 400) || ' left out]' || right(t, 160) END) AS excerpt FROM d""",
    "x15_tags": f"""{WITH_TRANSCRIPT} SELECT session_id, idx, lower(regexp_extract(content, '^(DECISION|TODO): (.*)$', 1)) AS tag, regexp_extract(content, '^(DECISION|TODO): (.*)$', 2) AS item
FROM transcript WHERE role = 'assistant' AND regexp_matches(content, '^(DECISION|TODO): ')""",
    "p10_tool_globs": f"""{WITH_TRANSCRIPT} SELECT CASE WHEN tool_name LIKE '%\\_file' ESCAPE '\\' THEN 'file' WHEN tool_name LIKE 'run\\_%' ESCAPE '\\' THEN 'shell'
  WHEN tool_name LIKE 'browser\\_%' ESCAPE '\\' THEN 'browser' ELSE 'other' END AS tool_role, count(*) AS messages FROM transcript WHERE tool_name IS NOT NULL GROUP BY 1""",
}
