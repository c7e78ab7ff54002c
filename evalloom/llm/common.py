"""What the operators of this package share: tables, shared storage, byte helpers."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.plans.registry import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset.

    On a cluster, a warehouse on the driver's machine is no shared folder, and using it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_stages"


def anonymous(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ... by place, so that no column clashes with those an operator adds."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of rows under the names of docs."""
    return rows.select(*[F.col(f"c{k}") for k in range(len(docs.columns))]).toDF(*docs.columns)


def column_of(docs: DataFrame, name: str) -> str:
    """The anonymous name of a column, found as Spark finds it."""
    found = [k for k, c in enumerate(docs.columns) if c == name] or [k for k, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"no single column {name}")
    return f"c{found[0]}"


#: A key of at least total / HOT rows is hot; there are HOT of them at most.
HOT = 1000


def joined_by_key(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """rows with what facts, one row a key, say of their key; n: the key's number of rows, which goes.

    Hot keys, at most HOT of them whatever the tables, are broadcast, so their rows stay where they are; the others are shuffled.
    """
    total = facts.agg(F.sum(n).alias("n")).first()["n"] or 0
    is_hot = F.col(n) * HOT >= total
    hot = F.broadcast(facts.where(is_hot).drop(n))  # at most HOT rows
    some = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(~is_hot).drop(n), key)
    return some.unionByName(rest)


#: Rows of one long up to which a side is broadcast: 16 MB at most.
FEW = 2_000_000


def joined_small(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined (left_semi or left_anti) to keys, of one long column. Keys are counted: FEW at most are broadcast, so wide rows stay where they are; more are shuffled, and rows with them."""
    keys = written(keys, "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, key, how)


def _stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cuts the lineage of df: a Parquet table in the shared folder, read again; by: a column that it is partitioned by.

    Later jobs read the table instead of repeating what made it, and a lost executor costs no more than its own tasks.
    An application's tables lie in one folder named by its id, which can go when the application's results are stored.
    """
    spark = df.sparkSession
    path = _stage_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written, in buckets of key: grouping or joining by key doesn't shuffle the table again."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.option("compression", "zstd").option("path", _stage_path(spark, name)).bucketBy(buckets, key).saveAsTable(table_name)
    return spark.table(table_name)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one buffer, and int64 offsets from 0 on; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n, wide = len(column), pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads uint64 values over all bits (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for each of the 256 bytes, for rolling hashes."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def release() -> None:
    """Gives freed memory back to the system; a worker that goes on to another stage then holds no more than its caches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(rows):
    """rows, a function for mapInArrow, with release() when a partition is done."""

    @functools.wraps(rows)
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            release()

    return run


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def unaligned(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on, as a little-endian uint64; bytes beyond the end are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lane(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first min(8, left) bytes at `at`."""
    return view[at] & _FIRST[np.minimum(left, 8)]


#: Longer words are hashed and compared one by one.
LONG_WORD = 512


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of data, one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return data[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of data, the same wherever it stands; not linear in the bytes, so structured pieces don't collide."""
    size = end - start
    out, view = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), unaligned(data)
    some, done = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(some):
        out[some] = mixed((out[some] ^ _lane(view, start[some] + done, size[some] - done)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        done += 8
        some = some[size[some] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), 42)
    return out


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces of a and of b, of the same sizes, are equal."""
    out, x, y = np.ones(len(size), bool), unaligned(a), unaligned(b)
    some, done = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(some):
        left = size[some] - done
        out[some] &= _lane(x, a_start[some] + done, left) == _lane(y, b_start[some] + done, left)
        done += 8
        some = some[(size[some] > done) & out[some]]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = np.array_equal(a[a_start[k] : a_start[k] + size[k]], b[b_start[k] : b_start[k] + size[k]])
    return out


def grouped(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the first place of each, and for each key its place among the distinct; keys are below bound.

    Where keys and places fit 64 bits together, they are sorted as one number, which is much faster than sorting places.
    """
    n = len(key)
    key = key.astype(np.uint64, copy=False)
    if n and bound * n < 1 << 64:
        both = np.sort(key * np.uint64(n) + np.arange(n, dtype=np.uint64))
        ordered = both // np.uint64(n)
        place = (both - ordered * np.uint64(n)).astype(np.int64)
    else:
        place = np.argsort(key, kind="stable")
        ordered = key[place]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(n, np.int64)
    which[place] = np.cumsum(new) - 1
    return ordered[new], place[new], which


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, in order, of the distinct pieces, the place of one piece for each, and for each piece its place among the distinct.

    All pieces are compared with the one that stands for them; pieces that differ have places of their own, though their hashes be equal.
    """
    hashes = word_hashes(data, start, end)
    # sorted as one number with their places, which takes the hashes' low bits: what these alone would tell apart, the bytes do
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    both = np.sort(hashes & ~low | np.arange(len(hashes), dtype=np.uint64))
    place = (both & low).astype(np.int64)
    both &= ~low
    new = np.ones(len(place), bool)
    new[1:] = both[1:] != both[:-1]
    some, which = place[new], np.empty(len(place), np.int64)
    distinct = hashes[some]
    which[place] = np.cumsum(new) - 1
    size = end - start
    one = some[which]
    same = size == size[one]
    same[same] = same_bytes(data, start[same], data, start[one[same]], size[same])
    if not same.all():  # by bytes
        number: dict[tuple[int, bytes], int] = {}
        which = np.array([number.setdefault((h, data[a:z].tobytes()), len(number)) for h, a, z in zip(hashes.tolist(), start.tolist(), end.tolist(), strict=True)])
        _, some = np.unique(which, return_index=True)
        order = np.argsort(hashes[some], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which, some = place[which], some[order]
        distinct = hashes[some]
    return distinct, some, which


class Rolling:
    """Polynomial hashes, modulo 2**64, of any pieces of a buffer from one running sum; equal bytes give equal hashes wherever they stand.

    Structured bytes may collide, so a hash may say where to look and never that two pieces are equal.
    """

    def __init__(self, seed: int = 0x5DEECE66D):
        self.value = byte_values(seed)
        self.base = (int(mixed(np.array([seed + 7], np.uint64))[0]) & ~7) | 3
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(pow(self.base, -1, 1 << 64), k, 1 << 64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def pieces(offsets: np.ndarray, most: int):
    """Runs of rows (first, last + 1) of about `most` bytes, a longer row by itself."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words_of(data: np.ndarray, offsets: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes, none across rows, and for each row the number of the first word at or after its start (one more at the end)."""
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~apart[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1]
    begins[cut[cut < len(data)]] = inside[cut[cut < len(data)]]
    start = np.flatnonzero(begins)
    ends = inside[:-1] & ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] |= inside[last]
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)
