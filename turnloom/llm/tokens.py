"""Token ids as Parquet list columns.

Documents are ranged by doc_id and sorted within each range; each task encodes its texts (the end id follows each) and
Spark writes one file per range: ids as list<int> with dictionary pages (delta pages once a dictionary is full), the
number columns delta-encoded, row groups and pages of set sizes and page indexes, so that a reader can fetch single
columns or pages. Each row also holds its place within its file, so positions in the whole sequence need only the file
totals: one row per file.

Edge cases: null and empty texts have the end id alone; null doc_ids come first; rows that repeat a doc_id are ordered by
the length and a hash of their texts, and equal rows are spread over ranges; very long texts are one row; an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, table_path
from .encoder import crc32, encoder

TOKENIZER, END = "byte_bpe_50k.json", 0
ROW_GROUP, PAGE = 16 << 20, 256 << 10
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
BATCH_BYTES = 1 << 20


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about limit bytes of text."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        sizes = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])) if len(text) else np.zeros(0, np.int64)
        at = 0
        while at < len(text):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def encode(batches: Iterator[pa.RecordBatch], path: str, end: int = END) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice with its ids, the end id after each text, and the bounds of the texts in them."""
    enc = encoder(path)
    for batch in text_batches(batches):
        ids, bounds = enc.ids([t or "" for t in batch.column("text").to_pylist()])
        ids = np.insert(ids, bounds[1:], end)
        yield batch, ids, bounds + np.arange(len(bounds))


def write_tokens(docs: DataFrame, out: str, path: str, end: int = END) -> None:
    """Write the token table of docs(doc_id, text) to the folder out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch, ids, bounds in encode(batches, path, end):
            n = batch.num_rows
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(at + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            at += int(bounds[-1])

    # rows that repeat an id are dealt by their texts, and equal rows by where they come from: no range must take them all
    order = ["doc_id", F.octet_length("text"), F.xxhash64("text"), "__place"]
    placed = docs.select("doc_id", "text", F.xxhash64(F.monotonically_increasing_id()).alias("__place"))
    sorted_docs = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    writer = sorted_docs.mapInArrow(rows, SCHEMA).write.option("compression", "zstd")
    for key, value in {
        "parquet.block.size": ROW_GROUP,
        "parquet.page.size": PAGE,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#local_start": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }.items():
        writer = writer.option(key, str(value))
    writer.parquet(out)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def positions(table: DataFrame) -> DataFrame:
    """part and the number of ids before it; reads two number columns, and handles one row per file."""
    totals = table.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    totals = materialize(totals, "token-parts")
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return materialize(totals.select("part", F.coalesce(before, F.lit(0)).alias("before")), "token-starts")


def checksums(table: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<u4")
            sums = np.array([crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), pa.array(sums)], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(rows, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), out, public_tokenizers.path(TOKENIZER))
    table = read_tokens(spark, out)
    return checksums(table).join(positions(table), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
