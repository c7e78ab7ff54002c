"""Blocks of whole texts, and the packed messages that blocks and buckets exchange.

A block is one row: the ids and texts of some documents, compressed. Operators that need facts of the whole corpus about
each block's many small items send one message per block and bucket instead of one row per item, and get one back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import flat, pieces, releasing

#: Bytes of text in a block, unless one text is longer.
BLOCK = 6_000_000
#: How hard texts are compressed: they are shuffled and stored once, and read several times.
TEXT_LEVEL = 6


def pack(x: np.ndarray) -> bytes:
    """Compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def bundle(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unbundle(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, np.int64, n, 8))
    return [data[a:z] for a, z in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins among the sorted keys, and their number at the end."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


BLOCK_COLUMNS = "block long, ids binary, missing binary, flags binary, offsets binary, text binary"


def to_blocks(size: int):
    """Rows of whole texts, of ids, texts and flags; ids of null are 0 and missing."""

    def rows(batches):
        for b in batches:
            data, offsets = flat(b.column(1))
            for at, to in pieces(offsets, size):
                ids, flags = b.column(0).slice(at, to - at).to_pylist(), b.column(2).slice(at, to - at).to_numpy(zero_copy_only=False).astype(bool)
                raw, bounds = data[offsets[at] : offsets[to]].tobytes(), offsets[at : to + 1] - offsets[at]
                columns = (pack(np.array([i or 0 for i in ids], np.int64)), np.packbits([i is None for i in ids]).tobytes(), np.packbits(flags).tobytes(), pack(bounds), zstandard.compress(raw, TEXT_LEVEL))
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *[pa.array([x], pa.binary()) for x in columns]], [x.split()[0] for x in BLOCK_COLUMNS.split(", ")])

    return rows


def doc_ids(ids: bytes, missing: bytes) -> list[int | None]:
    number = unpack(ids, np.int64)
    none = np.unpackbits(np.frombuffer(missing, np.uint8))[: len(number)]
    return [None if x else n for n, x in zip(number.tolist(), none.tolist(), strict=True)]


ROW_COLUMNS = "block long, kind int, bucket int, a binary, b binary, c binary"
ROW_NAMES = [x.split()[0] for x in ROW_COLUMNS.split(", ")]
ROW_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def message_rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ROW_SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in ROW_SCHEMA], schema=ROW_SCHEMA)


def ordered(rows: list[dict], kind: int) -> list[dict]:
    return sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])


def joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)



def text_blocks(docs: DataFrame, id_col: str, text_col: str, flag=None) -> DataFrame:
    """The documents in blocks numbered by `block`, to be stored before use, so that each block is the same whenever it is read. Null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.lit(False) if flag is None else flag).alias("flag"))
    return rows.mapInArrow(releasing(to_blocks(BLOCK)), BLOCK_COLUMNS).withColumn("block", F.monotonically_increasing_id())
