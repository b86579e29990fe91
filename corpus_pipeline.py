"""A corpus pipeline: quality filter, exact dedup, near dedup, mixing by source, packing into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and hands
it, read again, to the next. All stages but the last return the columns of documents.

Every stage takes each row of its input, whole texts, and any further columns, whatever their names. An empty table gives an
empty table in every stage. Per stage, the edge cases are those of its operator:

- quality: texts without words (null, empty, blank) go; a score on the threshold stays; repeated rows are judged alike.
- exact dedup: null counts as empty, and all empty texts are one group; most code points stay, then the smallest doc_id (nulls
  last); of rows that repeat both doc_id and text one stays.
- near dedup: five-word shingles at 0.8; of each component the row with the smallest doc_id stays (nulls last); documents
  without words are linked with nothing and stay.
- mixing: sources by code point, null last; a document may come out several times, or not at all where its source has more
  than its target; a source without words is taken once.
- packing: null and empty texts are the end id alone; repeated rows are packed each by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import dedup, mixing, neardup, packing, quality
from turnloom.llm.common import materialize, read
from turnloom.llm.tokens import TOKENIZER

#: Words of a shingle in the near-duplicate stage; two words are op6's own contract.
SHINGLE = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts one row stays."""
    return neardup.drop_near(docs, SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixing.mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
