"""Request logs: JSON lines, event streams, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "seq DOUBLE, ts STRING, session STRING, action STRING, client_status DOUBLE, tokens_in DOUBLE, tokens_out DOUBLE, compacted BOOLEAN, shadow BOOLEAN, "
    "upstream_incomplete BOOLEAN, transient_retries DOUBLE, attempts ARRAY<STRUCT<status: DOUBLE, kind: STRING, raw: DOUBLE>>, usage STRUCT<prompt_tokens: DOUBLE, completion_tokens: DOUBLE>"
)
#: The actions a record may name, and the largest record.
ACTIONS = ["passthrough", "reuse", "compact", "admit", "truncate", "clamp", "restore", "shadow", "impossible", "guard_fallback", "guard_reject"]
MAX_BYTES = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that is not blank: line, oversized, record (null if the line is no JSON object)."""
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    return parse_lines(lines.withColumnRenamed("value", "line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    big = F.octet_length("line") > MAX_BYTES
    record = F.from_json("line", RECORD, {"mode": "PERMISSIVE"})
    return lines.withColumns({"oversized": big, "record": F.when(~big & F.trim("line").startswith("{"), record)})


def valid(record: Column) -> Column:
    whole = lambda c: c.isNotNull() & (c >= 0) & (c == F.floor(c))
    r = record.getField
    told = r("tokens_in").isNotNull() | r("tokens_out").isNotNull() | r("attempts").isNotNull()
    return F.coalesce(whole(r("seq")) & r("action").isin(ACTIONS) & whole(r("client_status")) & r("client_status").between(100, 599) & told, F.lit(False))


def coverage(parsed: DataFrame) -> DataFrame:
    """Records, malformed lines (oversized ones included) and oversized lines."""
    ok = ~F.col("oversized") & F.col("record").isNotNull() & valid(F.col("record"))
    return parsed.agg(F.count_if(ok).alias("records"), F.count_if(~ok).alias("malformed"), F.count_if("oversized").alias("oversized"))


def sse_events(streams: DataFrame) -> DataFrame:
    """Events of server-sent event streams: id, n, event, data, comment, terminated, from streams(id, body).

    Lines end with CR LF, LF or CR; blank lines end events; data lines are joined by LF; a stream's tail without a blank
    line is an event that is not terminated.
    """
    text = F.regexp_replace(F.regexp_replace("body", "\r\n", "\n"), "\r", "\n")
    blocks = streams.withColumn("text", text).select("id", F.posexplode(F.split("text", "\n\n+")).alias("n", "block"), F.col("text").rlike("\n\n+\\z").alias("closed"), F.size(F.split("text", "\n\n+")).alias("of"))
    lines = F.split("block", "\n")
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    out = blocks.where(F.trim("block") != "").select(
        "id", "n", F.try_element_at(field("event"), F.lit(-1)).alias("event"),
        F.when(F.size(field("data")) > 0, F.array_join(field("data"), "\n")).alias("data"), F.forall(lines, lambda x: x.startswith(":")).alias("comment"), (F.col("closed") | (F.col("n") < F.col("of") - 1)).alias("terminated"),
    )
    return out


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait by a header: digits, or a date; null if it is neither."""
    date = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(value.rlike("^[0-9]+$"), F.try_to_number(value, F.lit("9" * 18)).cast("long")).when(date.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_timestamp(date) - F.unix_timestamp(now)))
