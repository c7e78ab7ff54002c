"""SimHash near-dedup with vantage-point trees.

Whole texts become 64-bit fingerprints; copies collapse to one fingerprint before anything is compared. A vantage-point
tree over a bounded sample deals all distinct fingerprints to shards: at a node, those within `mu` of the vantage point
go left and the others right. If two fingerprints differ in at most r bits and are parted there, the triangle inequality
says the nearer one's distance is over mu - r, so those go to both sides and no pair is lost. Each shard goes on in the
same way down to small leaves, where all pairs are compared. A shard gives a star per group instead of its pairs, and the
stars are joined over all shards.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import anonymous, column_of, flat, gathered, joined_by_key, joined_small, named, pieces, releasing, table, words_of, written
from evalloom.llm.components import connected, labels

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that fit the sharding tree, in all and for each shard, and how many a shard should hold.
SAMPLE, SAMPLED, SHARD = 131_072, 1024, 50_000
#: Fingerprints of a leaf, whose pairs are all compared; shingles hashed at once.
LEAF, AT_ONCE = 384, 200_000
#: Fingerprints that no vantage point parts from which on changed bits are looked up instead of comparing all pairs.
DENSE = 40_000
SPACE = b" \t\n\v\f\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 for each row of UTF-8 bytes; 0 without words. Shingles are hashed AT_ONCE at a time, so a long text is not worked on as a whole."""
    data = _LOWER[data]
    start, end, first = words_of(data, offsets, SPACE)
    words = np.diff(first)
    shingles = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    ends = np.cumsum(shingles)
    counts, digest = np.zeros((len(words), 64), np.int32), xxhash.xxh64_digest
    for low in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        shingle = np.arange(low, min(low + AT_ONCE, int(ends[-1])))
        row = np.searchsorted(ends, shingle, side="right")
        word = first[row] + shingle - (ends - shingles)[row]
        last = word + np.minimum(words[row], width) - 1
        # the words of these shingles, with one space between them
        a, z = int(word[0]), int(last[-1]) + 1
        size = end[a:z] - start[a:z]
        to = np.cumsum(size + 1) - size - 1
        joined = np.full(int(to[-1] + size[-1] + 1), 32, np.uint8)
        joined[np.repeat(to - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = gathered(data, start[a:z], size)
        raw = joined.tobytes()
        hashed = b"".join([digest(raw[x:y], seed) for x, y in zip(to[word - a].tolist(), (to[last - a] + size[last - a]).tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        counts[row[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > shingles[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprinted(rows_: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """doc_id, fp (long, the fingerprint's bits) and row: row_col, or a number of its own for each row."""

    def rows(batches):
        for b in batches:
            data, offsets = flat(b.column(2))
            for at, to in pieces(offsets, 1_000_000):
                fp = fingerprints(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), pa.array(fp.view(np.int64))], ["row", "doc_id", "fp"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    numbered = rows_.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return numbered.mapInArrow(releasing(rows), "row long, doc_id long, fp long")


def distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(v)).astype(np.int64)


def split(x: np.ndarray, radius: int) -> tuple[int, int] | None:
    """A vantage point among x and mu, for which the larger side is smallest; None if no try parts x well."""
    best = None
    for k in range(4):
        v = x[(len(x) * (2 * k + 1)) // 8]
        counts = np.bincount(distance(x, v), minlength=65)
        left = np.cumsum(counts)
        near = left - np.concatenate([np.zeros(radius, np.int64), left[:-radius]])
        larger = np.maximum(left, len(x) - left + near)
        mu = int(np.argmin(larger))
        if best is None or larger[mu] < best[0]:
            best = int(larger[mu]), int(v), mu
        if best[0] <= 0.65 * len(x):
            break
    return (best[1], best[2]) if best[0] <= 0.9 * len(x) else None


class Tree:
    """Deals fingerprints to leaves; nodes are (vantage point, mu, left, right), leaves -1 - their number."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int = RADIUS):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.root = self._grow(np.unique(sample), max(2.0, len(sample) / max(1, leaves)))

    def _grow(self, x: np.ndarray, most: float) -> int:
        found = split(x, self.radius) if len(x) > most else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        v, mu = found
        d, place = distance(x, v), len(self.nodes)
        self.nodes.append(None)
        self.nodes[place] = (v, mu, self._grow(x[d <= mu], most), self._grow(x[d > mu], most))
        return place

    def dealt(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, leaf) pairs: each fingerprint's own leaf and those beyond a boundary that it is near."""
        out, todo = [], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), -1 - node)))
            elif len(rows):
                v, mu, left, right = self.nodes[node]
                d = distance(x[rows], v)
                todo += [(left, rows[d <= mu]), (right, rows[d > mu - self.radius])]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _leaf_links(x: np.ndarray, radius: int) -> np.ndarray:
    """For each of x, the smallest place that it reaches within x; compared in blocks."""
    label = np.arange(len(x))
    while True:
        after = label.copy()
        for at in range(0, len(x), 512):
            near = np.bitwise_count(x[at : at + 512, None] ^ x[None, :]) <= radius
            after[at : at + 512] = np.where(near, label[None, :], len(x)).min(axis=1)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _flips(radius: int) -> np.ndarray:
    """All values of at most `radius` bits but 0."""
    one = [1 << k for k in range(64)]
    return np.array([sum(c) for n in range(1, radius + 1) for c in itertools.combinations(one, n)], np.uint64)


def _dense_links(x: np.ndarray, radius: int) -> np.ndarray:
    """As _leaf_links, for a large set that no vantage point parts: each value with some bits changed is looked up, so the work grows with len(x) and not its square."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k, flip in enumerate(flips := _flips(radius)):
        y = x ^ flip
        some = np.flatnonzero(y < x)
        at = np.searchsorted(x, y[some])
        hit = x[at] == y[some]  # y < x, so at is within
        a, b = np.concatenate([a, some[hit]]), np.concatenate([b, at[hit]])
        if len(a) > 4 * len(x) + 100_000 or k == len(flips) - 1:
            label = labels(len(x), a, b)
            a = np.flatnonzero(label != np.arange(len(x)))
            b = label[a]
    label = np.arange(len(x))
    label[a] = b
    return label


def linked(x: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """For each of the sorted distinct fingerprints x, the smallest place that it reaches by links of at most radius bits."""
    a, b, todo = [], [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        found = split(x[rows], radius) if len(rows) > leaf else None
        if found is None:
            label = _dense_links(x[rows], radius) if radius <= 2 and len(rows) > DENSE else _leaf_links(x[rows], radius)
            moved = label != np.arange(len(rows))
            a.append(rows[moved])
            b.append(rows[label[moved]])
        else:
            d = distance(x[rows], found[0])
            todo += [rows[d <= found[1]], rows[d > found[1] - radius]]
    return labels(len(x), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(x))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp, enough to give all groups within radius bits."""
    leaves = -(-distinct.count() // shard)
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, SAMPLED * leaves)).collect() if leaves > 1 else []  # at most SAMPLE rows
    tree = Tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), leaves, radius)

    def dealt(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            rows, leaf = tree.dealt(x)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows].view(np.int64)), pa.array(leaf.astype(np.int32))], ["fp", "leaf"])

    def stars(shard_: pa.Table) -> pa.Table:
        x = np.unique(shard_.column("fp").to_numpy().view(np.uint64))
        label = linked(x, radius)
        moved = np.flatnonzero(label != np.arange(len(x)))
        return pa.table({"a": x[moved].view(np.int64), "b": x[label[moved]].view(np.int64)})

    return distinct.select("fp").mapInArrow(dealt, "fp long, leaf int").groupBy("leaf").applyInArrow(stars, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp, fingerprint, component_id (the smallest doc_id that the row reaches), and row.

    Null texts count as empty; all empty texts have fingerprint 0 and are linked. Null ids are never the smallest, unless
    the component has no other. Repeated rows and ids are rows like any other. Texts may have any length. Other columns
    of docs are not read. An empty table gives an empty result. row is row_col, or a
    number of its own for each row; root is the same for all rows of a component.
    """
    rows = written(fingerprinted(docs, id_col, text_col, width, row_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected(fingerprint_links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"))
    of = written(joined_by_key(rooted, group, "root", "rows").select("fp", "root", "component_id", "n"), "fingerprint-components")
    return joined_by_key(rows, of, "fp", "n").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row", "root")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, null ids last, and of repeated ids one row.

    Rows are told apart by themselves, not by their ids. docs may have any columns. An empty table gives an empty result.
    """
    rows = written(anonymous(docs).withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    found = near_copies(rows, column_of(docs, id_col), column_of(docs, text_col), radius, width, row_col="row")
    return named(joined_small(rows, one_of_each(found, "root").select(F.col("gone").alias("row")), "row", "left_anti"), docs)


def one_of_each(rows: DataFrame, group: str) -> DataFrame:
    """gone: the row numbers of all rows (doc_id, row) of each group but the one of the smallest doc_id, null last, and of these the smallest row."""
    first = rows.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    return joined_by_key(rows, first.select(group, F.col("first.row").alias("stays"), "rows"), group, "rows").where("row <> stays").select(F.col("row").alias("gone"))


def op3_simhash(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
