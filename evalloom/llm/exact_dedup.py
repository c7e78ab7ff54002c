"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted externally, so equal texts become neighbours;
each text is compared in full with the one before it. The sort key is the first bytes of the text, its SHA-256 and the
identifier, so splitters stay small whatever the texts' lengths, and the copies of one text may lie in any number of
partitions: no group has to fit in one task. Runs that touch a partition's ends are joined in a second step, over at
most two rows a partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from evalloom.llm.common import anonymous, column_of, named, releasing, shuffle_width, table, written

#: Bytes of a text in its sort key.
PREFIX = 64


def _lowered(text: pa.Array) -> pa.Array:
    return pc.cast(pc.ascii_lower(pc.fill_null(pc.cast(text, pa.string()), "")), pa.binary())


def _keyed(text: int):
    """Rows with their sort key: the beginning of column number `text` in lower case, and its SHA-256."""

    def rows(batches):
        for b in batches:
            body = _lowered(b.column(text))
            sha = pa.array([hashlib.sha256(x.as_buffer()).digest() for x in body], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pc.binary_slice(body, 0, PREFIX), sha], [*b.schema.names, "prefix", "sha"])

    return rows


def _as_before(body: pa.Array, last: bytes | None) -> np.ndarray:
    """Whether each text equals the one before it, compared in full; last: the one before the first."""
    same = np.zeros(len(body), bool)
    same[1:] = pc.equal(body[1:], body[:-1]).to_numpy(zero_copy_only=False)
    same[0] = last is not None and body[0].as_py() == last
    return same


_RUNS = "id long, text_sha256 string, run_keep long, run_size long, run_first boolean, part int, edge binary"


def _runs(batches):
    """Neighbouring rows of equal text form a run. Its first row has the largest id. edge: the text, in the first row of a run that may go on in another partition."""
    ids, starts, shas, last, first_text = [], [], [], None, None
    for b in batches:
        if not b.num_rows:
            continue
        body = _lowered(b.column(1))
        same = _as_before(body, last)
        if first_text is None:
            first_text = body[0].as_py()
        last = body[-1].as_py()
        ids.append(b.column(0))
        starts.append(~same)
        shas += [b.column(2)[int(i)].as_py().hex() for i in np.flatnonzero(~same)]
    if not ids:
        return
    rows, start = pa.concat_arrays(ids), np.concatenate(starts)
    run = np.cumsum(start) - 1
    size, begin = np.bincount(run), np.flatnonzero(start)
    edge = [None] * len(rows)
    edge[0], edge[begin[-1]] = first_text, last
    columns = [rows, pa.array(shas).take(pa.array(run)), rows.take(pa.array(begin[run])), pa.array(size[run].astype(np.int64)), pa.array(start), pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32)), pa.array(edge, pa.binary())]
    whole = pa.RecordBatch.from_arrays(columns, ["id", "text_sha256", "run_keep", "run_size", "run_first", "part", "edge"])
    for at in range(0, len(rows), 50_000):
        yield whole.slice(at, 50_000)


def _first_rows(text: int, columns: int):
    """The first row of each run, with its first `columns` columns, part and edge as in _runs."""

    def rows(batches):
        last, part, held = None, TaskContext.get().partitionId(), None

        def out(b, edges):
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(edges, pa.binary())], [*b.schema.names, "part", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            body = _lowered(b.column(text))
            begins = np.flatnonzero(~_as_before(body, last))
            last = body[-1].as_py()
            if not len(begins):
                continue
            firsts = b.select(list(range(columns))).take(pa.array(begins))
            if held is None:  # the partition's first row is an edge
                yield out(firsts.slice(0, 1), [body[int(begins[0])].as_py()])
                firsts, held = firsts.slice(1), ()
            if firsts.num_rows:
                if held:  # not the last run after all
                    yield out(held[0], [None])
                if firsts.num_rows > 1:
                    yield out(firsts.slice(0, firsts.num_rows - 1), [None] * (firsts.num_rows - 1))
                held = (firsts.slice(firsts.num_rows - 1),)
        if held:
            yield out(held[0], [last])

    return rows


def _order() -> list:
    """The largest id first among equal texts."""
    return ["prefix", "sha", F.col("id").desc_nulls_last()]


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    id stays (null ids come last; of repeated rows one stays). Texts may have any length: only their first bytes and
    SHA-256 are sort keys. Other columns of docs are not read. An empty table gives an empty result.
    """
    n = partitions or shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.mapInArrow(releasing(_keyed(1)), "id long, text string, prefix binary, sha binary")
    sorted_ = keyed.repartitionByRange(n, *_order()).sortWithinPartitions(*_order()).select("id", "text", "sha")
    runs = written(sorted_.mapInArrow(releasing(_runs), _RUNS), "dedup-runs")
    # at most two rows for each of the n partitions
    ends = runs.where("edge is not null").groupBy("edge").agg(F.first("text_sha256").alias("sha"), F.max("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"), F.min("part").alias("first_part"))
    ends = F.broadcast(ends.select("sha", "all_keep", "all_size", "first_part"))
    return runs.join(ends, F.col("text_sha256") == F.col("sha"), "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("sha").isNull(), F.col("run_keep")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("run_first") & (F.col("sha").isNull() | (F.col("part") == F.col("first_part")))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows of docs that content_sort_dedup keeps, with all their columns, which may have any names.

    Rows are sorted with their columns, so a text is shuffled once. Null texts count as empty; of equal texts the row of
    the largest id stays, null ids last, and of repeated rows one. An empty table gives an empty result.
    """
    n, width = partitions or shuffle_width(docs.sparkSession), len(docs.columns)
    base = anonymous(docs)
    text = column_of(docs, text_col)
    rows = base.withColumn("id", F.col(column_of(docs, id_col)).cast("long"))
    fields = rows.schema.fields
    keyed = rows.mapInArrow(releasing(_keyed(base.columns.index(text))), StructType([*fields, StructField("prefix", BinaryType()), StructField("sha", BinaryType())]))
    sorted_ = keyed.repartitionByRange(n, *_order()).sortWithinPartitions(*_order()).select(*base.columns)
    schema = StructType([*fields[:width], StructField("part", IntegerType()), StructField("edge", BinaryType())])
    firsts = written(sorted_.mapInArrow(releasing(_first_rows(base.columns.index(text), width)), schema), "dedup-firsts")
    # at most two rows for each of the n partitions: runs that go on from one partition to the next stay in the first
    ends = F.broadcast(firsts.where("edge is not null").groupBy("edge").agg(F.min("part").alias("first_part")))
    stay = firsts.join(ends, "edge", "left").where("edge is null or part = first_part")
    return named(stay, docs)


def op1_exact_dedup(spark, sf_dir):
    return content_sort_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
