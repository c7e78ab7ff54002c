"""A corpus from raw documents to packed sequences: STAGES in order, each written as Parquet and read again as the next one's input.

The stages take documents with columns of any names beside theirs, in any row order, and an empty table; texts may have any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm.common import table, written
from evalloom.llm.exact_dedup import without_copies
from evalloom.llm.near_dedup import without_similar
from evalloom.llm.packing import pack
from evalloom.llm.secret_scan import masked
from evalloom.llm.toxicity import trained, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from the labels rejects go.

    Null and empty texts have no hits and stay; rows of null and repeated ids are judged by their texts like any other.
    """
    return without_toxic(docs, trained(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty), the row with the largest id stays, null ids last; of repeated rows one."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles of similarity at least 0.8, the row with the smallest id stays, null ids last.

    Texts without words form one group. Rows are told apart by themselves, so repeated ids do no harm.
    """
    return without_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of few owners are masked in the texts; all documents stay.

    Owners are counted over the raw documents, whose copies the stages before took away. Null texts stay null.
    """
    return masked(docs, corpus=table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids; a null or empty text is one piece, its end."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: Two stages (a learned model, a tokenizer) have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
