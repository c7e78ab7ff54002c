"""Near copies by the Jaccard similarity of 5-word shingles, at least 0.8, with no pair lost.

SimHash fingerprints of the same shingles, linked through vantage-point trees, give the closest pairs first. Fingerprints
of 64 bits can't give them all: at a similarity of 0.8 some ten bits differ, up to 18 or so, and at such a radius no
vantage point parts fingerprints whose distances all lie near 32. What the trees don't join is searched by prefixes.

Each document's distinct shingles are put in one order for all documents: those that a bounded sample finds frequent come
last, by how frequent, and the others go by hash. Of n shingles in that order, two documents that are alike share one of
the first n - ceil(0.8 n) + 1, whatever the order is, so only these are exchanged. Documents that share one are candidates
if their sizes allow 0.8 and so do their parity sketches: the sketches' differing bits are never more than the shingles
that one document has and the other lacks. Candidates are settled by the shingles of their texts.

In a large group of documents with a shingle, all are compared with the group's first row. Of those that no links join
then, the rows that chains of allowed pairs join are settled by their shingles, pairs that links found before join left
out. Large groups are dealt over tasks in parts, each two of which meet unless links join all their rows. What goes from
task to task grows with the rows, never with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.common import anonymous, column_of, flat, joined_by_key, joined_small, mixed, named, pieces, releasing, shuffle_width, word_hashes, words_of, written
from evalloom.llm.components import connected, labels
from evalloom.llm.simhash import _LOWER, SPACE, near_copies, one_of_each

#: Words of a shingle; documents of fewer words have one shingle, those without words the shingle 0.
WIDTH = 5
#: Documents whose shingles tell what is frequent, and shingles that count as frequent, at most; both bear on the order only.
SAMPLE, FREQUENT, OFTEN = 16_384, 100_000, 4
#: The last class of sketch sizes; documents of a group whose pairs are all compared at once; rows of a bucket of groups.
CLASSES, SMALL, BUCKET = 7, 16, 100_000
#: Rows of a part of a large group; pairs that share a text, in one task.
PART, SALTED = 4096, 500
#: Bytes of text hashed at once.
SLICE = 1_000_000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each row of UTF-8 bytes, sorted, and each hash's row."""
    data = _LOWER[data]
    start, end, first = words_of(data, offsets, SPACE)
    word = word_hashes(data, start, end)
    words = np.diff(first)
    many = np.maximum(words - WIDTH + 1, 1)
    row = np.repeat(np.arange(len(words)), many)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(words, WIDTH)[row]
    found = np.zeros(len(row), np.uint64)
    for k in range(WIDTH):
        some = np.flatnonzero(length > k)
        found[some] = mixed(found[some] * np.uint64(0x9E3779B97F4A7C15) + word[at[some] + k] + np.uint64(k + 1))
    place = np.lexsort((found, row))
    found, row = found[place], row[place]
    keep = np.ones(len(row), bool)
    keep[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[keep], row[keep]


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """Of n shingles, the first ones among which documents of similarity 0.8 meet."""
    return n - (4 * n + 4) // 5 + 1


def size_class(n: np.ndarray) -> np.ndarray:
    """A sketch of class c has 512 << c bits, no fewer than there are shingles, up to the last class."""
    return np.minimum(np.ceil(np.log2(np.maximum(n, 512) / 512)).astype(np.int64), CLASSES)


def sketches(found: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each row its sketch: bits, each the parity of the shingles that fall on it."""
    size = np.int64(512) << size_class(n)
    first = np.cumsum(size) - size
    bit = first[row] + (mixed(found ^ np.uint64(0x5851F42D4C957F2D)) & (size[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(bit, minlength=int(size.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[a : a + z] for a, z in zip((first >> 3).tolist(), (size >> 3).tolist(), strict=True)]


class Sketches:
    """Differing bits of pairs of sketches, those of the larger class folded to the smaller."""

    def __init__(self, sketch: list[bytes]):
        size = np.array(list(map(len, sketch)), np.int64)
        self.kind = np.round(np.log2(np.maximum(size, 64) / 64)).astype(np.int64)
        self.at = np.zeros((CLASSES + 1, len(sketch)), np.int64)
        self.words: list[np.ndarray] = []
        for c in range(CLASSES + 1):
            own = np.flatnonzero(self.kind == c)
            one_more = np.flatnonzero(self.kind == c + 1)
            self.at[c, own], self.at[c, one_more] = np.arange(len(own)), len(own) + np.arange(len(one_more))
            wide = 8 << c
            mine = np.frombuffer(b"".join([sketch[k] for k in own.tolist()]), np.uint64).reshape(-1, wide)
            folded = np.frombuffer(b"".join([sketch[k] for k in one_more.tolist()]), np.uint64).reshape(-1, 2, wide)
            self.words.append(np.concatenate([mine, folded[:, 0] ^ folded[:, 1]]))

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs whose classes differ by one at most; other pairs count as not differing."""
        out, lower, upper = np.zeros(len(x), np.int64), np.minimum(self.kind[x], self.kind[y]), np.maximum(self.kind[x], self.kind[y])
        for c in np.unique(lower).tolist():
            some, step = np.flatnonzero((lower == c) & (upper <= c + 1)), max(1, 400_000 // (8 << c))
            for k in range(0, len(some), step):
                i = some[k : k + step]
                out[i] = np.bitwise_count(self.words[c][self.at[c, x[i]]] ^ self.words[c][self.at[c, y[i]]]).sum(axis=1, dtype=np.int64)
        return out


def _ordered(found: np.ndarray, row: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the rare shingles by hash, then the frequent ones by count."""
    count = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        count = np.where(frequent[at] == found, often[at], 0)
    place = np.lexsort((found, count, row))
    return found[place], row[place]


def _texts(batches):
    """(row numbers, bytes, offsets) of slices of batches of row and text."""
    for b in batches:
        data, offsets = flat(b.column(1))
        for at, to in pieces(offsets, SLICE):
            yield b.column(0).slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several of at most SAMPLE documents hold, and how many of them do."""

    def rows(batches):
        for _, data, offsets in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(data, offsets)[0].view(np.int64))], ["h"])

    some = F.broadcast(docs.select("row").orderBy(F.xxhash64("row"), "row").limit(SAMPLE))
    counts = docs.join(some, "row", "left_semi").select("row", "text").mapInArrow(releasing(rows), "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    found = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    place = np.argsort(h)
    return h[place], np.array([r["count"] for r in found], np.int64)[place]


def _prefixes(frequent: np.ndarray, often: np.ndarray):
    def rows(batches):
        for ids, data, offsets in _texts(batches):
            found, row = shingles(data, offsets)
            n = np.bincount(row, minlength=len(ids))
            sketch = sketches(found, row, n)
            found, row = _ordered(found, row, frequent, often)
            first, take = np.cumsum(n) - n, prefix_sizes(n)
            keep = np.arange(len(row)) - first[row] < take[row]
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)).astype(np.int32)), pa.array(found[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), pa.array(sketch, pa.binary()), prefix], ["row", "n", "sketch", "prefix"])

    return rows


class _Entries:
    """Rows of a bucket's groups in order of group, parts and size; start: where each group's two parts begin."""

    def __init__(self, part: pa.Table):
        columns = [part.column(c).to_numpy() for c in ("g", "pa", "pb", "n", "row", "root", "mine", "first")]
        place = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
        group, part_a, part_b, n, self.row, self.root, self.mine, self.first = (x[place] for x in columns)
        self.n, self.one = n.astype(np.int64), part_a == part_b
        self.sketch = Sketches(part.column("sketch").take(pa.array(place)).to_pylist())
        self.start = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part_a[1:] != part_a[:-1]) | (part_b[1:] != part_b[:-1])))
        self.size = np.diff(np.append(self.start, len(group)))
        self.end = np.repeat(self.start + self.size, self.size)

    def allowed(self, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Which pairs have different labels, and sizes and sketches that allow the similarity."""
        out = (5 * np.minimum(self.n[x], self.n[y]) >= 4 * np.maximum(self.n[x], self.n[y])) & (label[x] != label[y])
        out &= (self.mine[x] != self.mine[y]) | self.one[x]  # two parts of a group meet each other here, not themselves
        some = np.flatnonzero(out)
        out[some] = 9 * self.sketch.differing(x[some], y[some]) <= self.n[x[some]] + self.n[y[some]]
        return out

    def with_first(self, large: np.ndarray):
        """Of large groups, pairs of each row with the group's first, or else with one that is here."""
        for k in np.flatnonzero(large[self.start]).tolist():
            others = np.arange(self.start[k], self.start[k] + self.size[k])
            here = np.flatnonzero(self.row[others] == self.first[others])
            yield np.full(len(others), others[here[0] if len(here) else 0]), others

    def all_pairs(self, which: np.ndarray):
        """All pairs of each group, but for those whose sizes rule them out."""
        left, step = np.flatnonzero(which), 1
        while len(left := left[left + step < self.end[left]]):
            left = left[5 * self.n[left] >= 4 * self.n[left + step]]  # sizes ascend, so none beyond will do
            for k in range(0, len(left), 200_000):
                yield left[k : k + 200_000], left[k : k + 200_000] + step
            step += 1


def _candidates(part: pa.Table) -> pa.Table:
    """Pairs (a, b) of rows of a bucket's groups, with different roots, that sizes and sketches allow: all of small groups, and those with the first row of large ones."""
    e, out = _Entries(part), []
    small = np.repeat(e.size <= SMALL, e.size)
    for pairs in (e.with_first(~small), e.all_pairs(small)):
        for x, y in pairs:
            some = e.allowed(x, y, e.root)
            x, y = e.row[x[some]], e.row[y[some]]
            out.append(np.column_stack([np.maximum(x, y), np.minimum(x, y)]))
            if len(out) > 500:
                out = [np.unique(np.concatenate(out), axis=0)]
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _may_be_alike(part: pa.Table) -> pa.Table:
    """Pairs (a, b) of rows of a bucket's groups that join all rows which pairs allowed by sizes and sketches join, and no more than rows."""
    e = _Entries(part)
    rows, of = np.unique(e.row, return_inverse=True)
    label, every = np.arange(len(rows)), np.ones(len(e.row), bool)
    for pairs in (e.with_first(every), e.all_pairs(every)):
        for x, y in pairs:
            some = label[of[x]] != label[of[y]]
            x, y = x[some], y[some]
            some = e.allowed(x, y, e.root)
            if some.any():
                label = labels(len(rows), label[of[x[some]]], label[of[y[some]]])[label]
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return pa.table({"a": rows[moved], "b": rows[label[moved]]})


def _settled(part: pa.Table, sets: pa.Table) -> pa.Table:
    """Links (a, b) of rows of a bucket's groups, enough to join all rows that pairs of similarity at least 0.8 join.

    sets: the rows' shingles. All pairs are candidates; those that earlier links of this bucket join are left out, so a
    group of many documents that are alike costs about one comparison of shingles a document, and no more links than rows.
    """
    if not part.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    e = _Entries(part)
    held = dict(zip(sets.column("row").to_pylist(), sets.column("shingles"), strict=True))
    found: dict[int, np.ndarray] = {}

    def shingles_of(row: int) -> np.ndarray:
        if row not in found:
            found[row] = np.frombuffer(held[row].as_buffer(), np.uint64)
        return found[row]

    roots, label = np.unique(e.root, return_inverse=True)
    label, links, every = label.astype(np.int64), [], np.ones(len(e.row), bool)  # entries of one row have one root

    def settle(x, y):
        nonlocal label
        while len(x):
            # one pair for each two labels at a time: the others may need no comparison then
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            _, some = np.unique(low * len(roots) + high, return_index=True)
            alike = np.zeros(len(some), bool)
            for k, (a, b) in enumerate(zip(e.row[x[some]].tolist(), e.row[y[some]].tolist(), strict=True)):
                p, q = shingles_of(a), shingles_of(b)
                alike[k] = 9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q))
            links.append(np.column_stack([e.row[x[some[alike]]], e.row[y[some[alike]]]]))
            label = labels(len(roots), low[some[alike]], high[some[alike]])[label]
            keep = label[x] != label[y]
            keep[some] = False
            x, y = x[keep], y[keep]

    for pairs in (e.with_first(every), e.all_pairs(every)):
        for x, y in pairs:
            some = e.allowed(x, y, label)
            settle(x[some], y[some])
    pairs = np.concatenate([*links, np.zeros((0, 2), np.int64)])
    return pa.table({"a": pairs.max(axis=1), "b": pairs.min(axis=1)})


def _alike(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of rows (a, b, salt, text) and the texts of (b, salt): the pairs (a, b) of similarity at least 0.8. The shingles of a text b are found once."""
    a, b, salt = (left.column(c).to_numpy() for c in ("a", "b", "salt"))
    place = np.lexsort((salt, b))
    texts = left.column("text").take(pa.array(place))
    a, b, salt = a[place], b[place], salt[place]
    data, offsets = flat(texts)
    other = {(x, y): k for k, (x, y) in enumerate(zip(right.column("b").to_pylist(), right.column("salt").to_pylist(), strict=True))}
    keep = np.zeros(len(a), bool)
    begins = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (salt[1:] != salt[:-1]))) if len(a) else np.zeros(0, np.int64)
    for at, to in zip(begins.tolist(), np.append(begins[1:], len(a)).tolist(), strict=True):
        theirs = shingles(*flat(right.column("text").slice(other[int(b[at]), int(salt[at])], 1)))[0]
        for x, y in pieces(offsets[at : to + 1], SLICE):
            x, y = at + x, at + y
            own, row = shingles(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            place = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
            both = np.bincount(row[theirs[place] == own], minlength=y - x)
            keep[x:y] = 9 * both >= 4 * (np.bincount(row, minlength=y - x) + len(theirs))
    return pa.table({"a": a[keep], "b": b[keep]})


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose texts are alike. A text b that many pairs share is dealt over as many tasks as its pairs need."""
    spark = docs.sparkSession
    pairs = written(pairs.distinct(), "near-pairs")
    texts = joined_small(docs.select("row", "text"), pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row", "left_semi")
    texts = written(texts, "near-texts")
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALTED).alias("salts"), F.count("*").alias("n"))
    dealt = joined_by_key(pairs, many, "b", "n").withColumn("salt", F.pmod(F.xxhash64("a"), "salts"))
    buckets = max(shuffle_width(spark), -(-pairs.count() // (4 * SALTED)))
    bucket = F.pmod(F.xxhash64("b", "salt"), F.lit(buckets)).alias("bucket")
    left = dealt.join(texts.withColumnRenamed("row", "a"), "a").select(bucket, "a", "b", "salt", "text").toDF("bucket", "a", "b", "salt", "text")
    right = dealt.select("b", "salt").distinct().join(texts.withColumnRenamed("row", "b"), "b").select(bucket, "b", "salt", "text").toDF("bucket", "b", "salt", "text")  # as columns of its own
    return written(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_alike, "a long, b long"), "near-links")


def _with_first(groups: DataFrame) -> DataFrame:
    """Rows of groups g in parts of about PART rows, each with the group's first row beside it."""
    parts = F.ceil(F.col("held") / PART).cast("int")
    own = F.pmod(F.xxhash64("row"), parts).cast("int")
    to = F.when(F.col("row") == F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    return groups.select("g", "row", "n", "root", "first", "sketch", own.alias("mine"), F.explode(to).alias("pa")).withColumn("pb", F.col("pa"))


def _all_meet(groups: DataFrame) -> DataFrame:
    """Rows of groups g in parts of at most about PART / 2 rows, each two parts together, but for those whose rows all have the group's main root."""
    sizes = written(groups.groupBy("g", "root").agg(F.count("*").alias("c")), "group-roots")
    main = sizes.groupBy("g").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("m"), F.sum("c").alias("all"))
    rows = joined_by_key(groups.select("g", "row", "n", "root", "first", "sketch"), written(main.withColumn("held", F.col("all")), "group-mains"), "g", "all")
    others, mains = (F.ceil(2 * c / PART).cast("int") for c in (F.col("held") - F.col("m"), F.col("m")))
    is_main = F.col("root") == F.col("main")
    own = F.when(is_main, others + F.pmod(F.xxhash64("row"), mains)).otherwise(F.pmod(F.xxhash64("row"), others)).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.when(is_main, others - 1).otherwise(others + mains - 1)), lambda k: F.struct(F.least(own, k).alias("pa"), F.greatest(own, k).alias("pb")))
    return rows.select("g", "row", "n", "root", "first", "sketch", own.alias("mine"), F.explode(to).alias("to")).select("*", "to.pa", "to.pb").drop("to")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(node, root) for each row number that links of similarity at least 0.8 join to a smaller one, the root, of rows (row, text)."""
    spark = docs.sparkSession
    # the closest pairs, by fingerprints of the same shingles and vantage-point trees; what is joined here isn't compared again
    close = near_copies(docs, "row", "text", width=WIDTH, row_col="row").where("row <> component_id")
    links = _confirmed(close.select(F.col("row").alias("a"), F.col("component_id").alias("b")), docs)

    prefixes = written(docs.mapInArrow(releasing(_prefixes(*frequent_shingles(docs))), "row long, n int, sketch binary, prefix array<long>"), "shingle-prefixes")
    by = Window.partitionBy("h")
    rows = prefixes.select("row", F.explode("prefix").alias("h"))
    rows = rows.select("row", "h", F.count("*").over(by).alias("held"), F.min("row").over(by).alias("first"), F.bit_xor(F.xxhash64("row")).over(by).alias("x"), F.sum(F.shiftright(F.xxhash64("row", F.lit(1)), 24)).over(by).alias("s")).where("held > 1")
    rows = written(rows, "shared-shingles")
    # shingles that the very same rows hold, such as those of one passage, are one group
    one = rows.where("row = first").groupBy("held", "first", "x", "s").agg(F.min("h").alias("h")).select("h")
    groups = written(rows.join(one, "h", "left_semi").select(F.col("h").alias("g"), "row", "held", "first"), "shingle-groups")

    sketch = prefixes.select("row", "n", "sketch")

    def roots_of(links: DataFrame) -> DataFrame:
        return connected(links).withColumnRenamed("node", "row")

    def apart(links: DataFrame, least: int) -> DataFrame:
        """Groups of more than `least` rows that links don't join yet."""
        rooted = groups.where(F.col("held") > least).join(roots_of(links), "row", "left").withColumn("root", F.coalesce("root", "row"))
        rooted = written(rooted, "rooted-groups")
        more = rooted.groupBy("g").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("g")
        return written(rooted.join(more, "g", "left_semi").join(sketch, "row"), "groups-apart")

    def bucket(entries: DataFrame, each: int):
        return F.pmod(F.xxhash64("g", "pa", "pb"), F.lit(max(shuffle_width(spark), -(-entries.count() // each))))

    first = apart(links, 1)
    links = links.unionByName(_confirmed(_with_first(first).groupBy(bucket(first, BUCKET)).applyInArrow(_candidates, "a long, b long"), docs))
    # of what is still apart, rows that chains of allowed pairs join; only their shingles go along, and settle which pairs are links
    rest = apart(links, SMALL)
    chains = written(roots_of(written(_all_meet(rest).groupBy(bucket(rest, BUCKET)).applyInArrow(_may_be_alike, "a long, b long"), "may-be-alike")), "chains").toDF("row", "g")
    chained = chains.unionByName(chains.select(F.col("g").alias("row"), "g").distinct())
    facts = written(rest.select("row", "root", "n", "sketch").dropDuplicates(["row"]).join(chained, "row").withColumn("first", F.col("g")), "chained-rows")
    sets = written(joined_small(docs.select("row", "text"), facts.select("row"), "row", "left_semi").mapInArrow(releasing(_sets), "row long, shingles binary"), "shingle-sets")
    dealt = written(_all_meet(facts).withColumn("bucket", bucket(facts, BUCKET // 20)), "groups-dealt")
    of = dealt.select("bucket", "row").distinct().join(sets, "row").toDF("row", "bucket", "shingles")
    more = written(dealt.groupBy("bucket").cogroup(of.groupBy("bucket")).applyInArrow(_settled, "a long, b long"), "near-links")
    return connected(links.unionByName(more))


def _sets(batches):
    for ids, data, offsets in _texts(batches):
        found, row = shingles(data, offsets)
        ends = np.cumsum(np.bincount(row, minlength=len(ids)))
        yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in np.split(found, ends[:-1])], pa.binary())], ["row", "shingles"])


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id, null ids last, and of repeated ids one row.

    Rows are told apart by themselves, not by their ids; null texts count as empty, and all texts without words are
    alike. Texts may have any length. docs may have any columns. An empty table gives an empty result.
    """
    rows = written(anonymous(docs).withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    ids, text = F.col(column_of(docs, id_col)).cast("long"), F.col(column_of(docs, text_col)).cast("string")
    groups = similar_groups(rows.select("row", F.coalesce(text, F.lit("")).alias("text")))
    members = groups.select(F.col("node").alias("row"), "root").unionByName(groups.select(F.col("root").alias("row"), "root").distinct())
    members = written(members.join(rows.select("row", ids.alias("doc_id")), "row"), "group-members")
    return named(joined_small(rows, one_of_each(members, "root").select(F.col("gone").alias("row")), "row", "left_anti"), docs)
