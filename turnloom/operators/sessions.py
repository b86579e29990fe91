"""Walks over the messages of a session, in Python: a batch of sessions at a time, so that a session costs its own steps only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def walk(log: DataFrame, columns: list[str], step: Callable[[int, list[tuple]], list[tuple]], schema: str, order: str = "idx", least: int = 1) -> DataFrame:
    """Rows (schema) that step makes from a session's id and its rows (order and columns), in order; sessions with fewer than least rows make none.

    A log that is dealt out by session already is not dealt out again.
    """
    by = log.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("l"))
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out)
        for b in batches:
            lists = b.column(1)
            starts, inner = lists.offsets.to_pylist(), lists.values
            rows = list(zip(*(inner.field(i).to_pylist() for i in range(1 + len(columns))), strict=True))
            made = [r for s, a, z in zip(b.column(0).to_pylist(), starts, starts[1:], strict=False) for r in step(s, rows[a:z])]
            cells = zip(*made, strict=True) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, kinds, strict=True)], schema=kinds)

    return (by.where(F.size("l") >= least) if least > 1 else by).mapInArrow(run, out)
