"""Suffix-array dedup: bytes that a string of LENGTH bytes covers go if the string also starts earlier.

A position's longest previous factor (LPF) is the longest string that starts there and also somewhere earlier; a string of
LENGTH bytes is a repeat exactly if the LPF at its start is LENGTH at least. One suffix array over the whole corpus fits no
task, so positions are dealt by content: a window of LENGTH bytes goes by the least hash of its GRAM-byte pieces (its
anchor). Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so a document
becomes runs of windows with one anchor, about one in 35 bytes.

1. Blocks of texts ask for each of their anchors whether other runs have it; buckets of anchors answer. Runs that have
   their anchor alone hold no repeats. Copies of a run inside a block, compared byte by byte, are repeats and not sent.
2. The other runs are sent with their bytes. A bucket makes equal runs one; of these, all but the first are repeats. For
   the distinct runs it builds the suffix order of the windows' starts and the longest common prefixes of neighbours. The
   previous and the next smaller position in suffix order then give each LPF.
3. Blocks mark the repeats' bytes in their texts and cut them out.

Hashes only say where strings meet; every removal rests on equal bytes. Copies of a long passage meet as one row per block
and run. Pieces that very many documents hold, such as a short line of boilerplate, are anchors only of windows that have
no other: in a bounded sample of blocks the frequent pieces are counted, and the order of hashes puts them last. So a
window that reaches out of such a line is anchored outside it, and doesn't meet the same line's windows of all other
documents. Where over HOT_RUNS runs still share an anchor, their windows are dealt one by one, by hashes of the windows.
Which pieces are put last, and how windows are dealt, changes where they meet, never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.blocks import ROW_COLUMNS, bucket_bounds, bundle, doc_ids, joined, message_rows, ordered, pack, pack_sorted, text_blocks, unbundle, unpack, unpack_sorted
from evalloom.llm.common import Rolling, bucketed, distinct_words, gathered, mixed, pieces, release, releasing, same_bytes, shuffle_width, table, unaligned, word_hashes, written

LENGTH, GRAM = 100, 32
#: Bytes hashed at once.
SLICE = 250_000
#: Blocks that are sampled for frequent pieces, the share of the sample's documents from which on a piece is frequent, and how many such pieces are put last.
SAMPLE_BLOCKS, FREQUENT, LAST = 8, 0.002, 65_536
#: Ranges of keys that a bucket works on one after another, to use little memory.
PARTS = 8
#: Runs of one anchor beyond which their windows are dealt one by one.
HOT_RUNS = 20_000
ALONE, SHARED, HOT = 0, 1, 2
ASKED, SENT = 0, 1
_LAST = np.iinfo(np.int64).max


class Order:
    """The order of pieces: by hash, the frequent ones last."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.unique(frequent.astype(np.uint64))
        self.may = np.zeros(1 << 20, bool)
        self.may[self.frequent & np.uint64((1 << 20) - 1)] = True

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        key = hashes >> np.uint64(1)
        if len(self.frequent):
            some = np.flatnonzero(self.may[hashes & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(self.frequent, hashes[some]), len(self.frequent) - 1)
            some = some[self.frequent[at] == hashes[some]]
            key[some] |= np.uint64(1 << 63)
        return key


class Runs:
    """The runs of windows of a block's texts, in text order.

    start, stop: first window start and one beyond the last. anchor: a hash. first: the runs but the copies of earlier ones, by anchor.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, docs: list[int | None], order: Order):
        grams, wholes, found = Rolling(11), Rolling(23), []
        for at, to in pieces(offsets, SLICE):
            low, high = int(offsets[at]), int(offsets[to])
            # of one long text, the windows that begin in each slice
            cuts = [(low, high, offsets[at : to + 1] - low)] if to > at + 1 or high - low <= 2 * SLICE else [(x, z, np.array([0, z - x])) for x in range(low, high - LENGTH + 1, SLICE) for z in [min(x + SLICE + LENGTH - 1, high)]]
            for x, z, bounds in cuts:
                got = _runs_of(data[x:z], bounds, grams, wholes, order)
                got[0] += x
                got[1] += x
                found.append(got)
        self.start, self.stop, self.anchor, whole = (joined([f[k] for f in found], kind) for k, kind in enumerate([np.int64] * 2 + [np.uint64] * 2))
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        # place in the order of documents: by id, null ids last, then as they stand
        ids = np.array([_LAST if d is None else d for d in docs], np.int64)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        place = np.lexsort((self.start, rank[self.doc], whole, self.anchor))
        new = np.ones(len(place), bool)
        new[1:] = (self.anchor[place][1:] != self.anchor[place][:-1]) | (whole[place][1:] != whole[place][:-1])
        head = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
        size = self.stop - self.start + LENGTH - 1
        some = np.flatnonzero(~new)
        equal = size[place[some]] == size[head[some]]
        equal[equal] = same_bytes(data, self.start[place[some[equal]]], data, self.start[head[some[equal]]], size[head[some[equal]]])
        new[some[~equal]] = True
        self.first = place[new]
        self.id = ids[self.doc] if len(ids) else np.zeros(0, np.int64)
        self.at = self.start - offsets[self.doc] if len(self.start) else self.start

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors of first, in order, and how many runs have each."""
        return np.unique(self.anchor[self.first], return_counts=True)

    def sent(self, told: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """What goes to buckets, in order: starts, numbers of windows, ids and places, and where each bucket's PARTS begin. told: by distinct anchor."""
        told = np.repeat(told, self.anchors()[1])
        some, hot = self.first[told == SHARED], self.first[told == HOT]
        key, start, windows = self.anchor[some], self.start[some], (self.stop - self.start)[some]
        if len(hot):
            n = self.stop[hot] - self.start[hot]
            single = np.repeat(self.start[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key, start = np.concatenate([key, word_hashes(data, single, single + LENGTH)]), np.concatenate([start, single])
            windows, some = np.concatenate([windows, np.ones(len(single), np.int64)]), np.concatenate([some, np.repeat(hot, n)])
        place = np.argsort(key, kind="stable")
        start, some = start[place], some[place]
        return start, windows[place], self.id[some], self.at[some] + start - self.start[some], bucket_bounds(key[place], buckets * PARTS)


def _runs_of(data: np.ndarray, offsets: np.ndarray, grams: Rolling, wholes: Rolling, order: Order) -> list[np.ndarray]:
    n, width = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return [none, none, none.astype(np.uint64), none.astype(np.uint64)]
    sums = grams.sums(data)
    at = np.arange(n - GRAM + 1)
    hashes = grams.hashes(sums, at, at + GRAM)
    bits = np.uint64(32)  # the same for all slices, or else equal windows could differ in what ties
    # least hash (by its upper half), leftmost on ties, of each window, by windows of twice the width
    least, have = (order.keys(hashes) >> bits << bits) | at.astype(np.uint64), 1
    key = least
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    rest = width - have
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)
    long = size >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(inside[: len(place)]) > 0
    window = np.flatnonzero(valid)
    place = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    begins = offsets[:-1][long]
    new[np.searchsorted(window, begins)] = True
    first = np.flatnonzero(new)
    start, stop, anchor = window[first], window[np.append(first[1:], len(window)) - 1] + 1, place[first]
    whole = wholes.hashes(wholes.sums(data), start, stop + LENGTH - 1) ^ ((anchor - start).astype(np.uint64) << np.uint64(56))
    return [start, stop, mixed(hashes[anchor]), whole]  # least hashes are small; mixed anew, they fill all buckets


def _block(row: dict, order: Order) -> tuple[list[int | None], np.ndarray, np.ndarray, Runs]:
    docs, offsets = doc_ids(row["ids"], row["missing"]), unpack(row["offsets"], np.int64)
    data = np.frombuffer(zstandard.decompress(row["text"]), np.uint8)
    return docs, data, offsets, Runs(data, offsets, docs, order)


def _each(batch):
    return (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def _ask(buckets: int, order: Order):
    """For each block and bucket: the distinct anchors, and how many runs of the block have each."""

    def rows(batches):
        for b in batches:
            for row in _each(b):
                anchor, runs = _block(row, order)[3].anchors()
                bounds = bucket_bounds(anchor, buckets).tolist()
                out = [(row["block"], ASKED, k, pack_sorted(anchor[a:z]), pack(runs[a:z].astype(np.uint32)), None) for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < z]
                yield from message_rows(out).to_batches()

    return rows


def _answer(hot_runs: int):
    def found(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        anchors = [unpack_sorted(r["a"]) for r in rows]
        distinct, which = np.unique(np.concatenate(anchors), return_inverse=True)
        runs = np.bincount(which, weights=np.concatenate([unpack(r["b"], np.uint32) for r in rows]), minlength=len(distinct))
        told, at, out = np.where(runs == 1, ALONE, np.where(runs <= hot_runs, SHARED, HOT)).astype(np.uint8)[which], 0, []
        for r, x in zip(rows, anchors, strict=True):
            out.append((r["block"], ASKED, r["bucket"], pack(told[at : at + len(x)]), None, None))
            at += len(x)
        return message_rows(out)

    return found


def _told(answers: list[dict]) -> np.ndarray:
    return joined([unpack(r["a"], np.uint8) for r in ordered(answers, ASKED)], np.uint8)


def _send(buckets: int, order: Order):
    """The runs of a block that share their anchor with others, with their bytes."""

    def rows(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, told = [], answers.to_pylist()
        for row in blocks.to_pylist():
            _, data, _, runs = _block(row, order)
            start, windows, ids, at, bounds = runs.sent(_told([r for r in told if r["block"] == row["block"]]), data, buckets)
            for k in range(buckets):
                parts = list(zip(bounds[k * PARTS : (k + 1) * PARTS].tolist(), bounds[k * PARTS + 1 : (k + 1) * PARTS + 1].tolist(), strict=True))
                if parts[0][0] < parts[-1][1]:
                    numbers = [bundle(pack(windows[a:z].astype(np.uint8)), pack(ids[a:z]), pack(at[a:z].astype(np.uint32))) if a < z else b"" for a, z in parts]
                    texts = [zstandard.compress(gathered(data, start[a:z], windows[a:z] + LENGTH - 1).tobytes(), 3) if a < z else b"" for a, z in parts]
                    out.append((row["block"], SENT, k, bundle(*numbers), bundle(*texts), None))
        release()
        return message_rows(out)

    return rows


def prefix_ranks(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks, in suffix order, of the prefixes of `length` bytes that begin at start; equal prefixes have equal ranks. Prefix doubling, from 8 bytes on."""
    n = len(data)
    rank = unaligned(data)[:n].byteswap()
    have = 8
    while True:
        step = min(have, length - have)
        if step <= 0:
            return rank[start]
        place = np.argsort(rank)
        ordered_ = rank[place]
        rank[place] = np.cumsum(np.append(False, ordered_[1:] != ordered_[:-1]), dtype=np.uint64)
        most = int(rank.max()) + 2 if n else 1
        after = np.zeros(n, np.uint64)
        after[: n - step] = rank[step:]
        rank = rank * np.uint64(most) + after
        have += step


def common_prefixes(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """How many bytes, up to `length`, each string at start has in common with the one before it; 0 for the first."""
    view, out = unaligned(np.concatenate([data, np.zeros(length + 8, np.uint8)])), np.zeros(len(start), np.int64)
    some, done = np.arange(1, len(start)), 0
    while len(some) and done < length:
        differ = view[start[some] + done] ^ view[start[some - 1] + done]
        out[some] = done + np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3)
        some, done = some[differ == 0], done + 8
    return np.minimum(out, length)


def _previous_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of a suffix order, the common prefix with the nearest place before it of a smaller position; 0 where there is none. lcp: with the place before."""
    at, least = np.arange(len(position)) - 1, lcp.copy()
    while True:
        some = np.flatnonzero((at >= 0) & (least > 0))
        some = some[position[at[some]] > position[some]]
        if not len(some):
            return np.where(at >= 0, least, 0)
        # what lies between a place and its candidate is larger than either, so the candidate's candidate is next
        to = at[some]
        least[some], at[some] = np.minimum(least[some], least[to]), at[to]


def longest_previous_factors(data: np.ndarray, start: np.ndarray, position: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the strings of `length` bytes at start, whose order is given by distinct positions: the longest common prefix, up to `length`, with one of a smaller position."""
    place = np.argsort(prefix_ranks(data, start, length), kind="stable")
    lcp = common_prefixes(data, start[place], length)
    before = _previous_smaller(position[place], lcp)
    after = _previous_smaller(position[place][::-1], np.append(lcp[1:], 0)[::-1])[::-1]
    out = np.empty(len(start), np.int64)
    out[place] = np.maximum(before, after)
    return out


def repeated_windows(data: np.ndarray, start: np.ndarray, windows: np.ndarray, doc: np.ndarray, block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the runs' windows occur earlier; (doc, block, at) is the runs' order in the corpus."""
    order = np.lexsort((at, block, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    _, _, which = distinct_words(data, start, start + windows + LENGTH - 1)
    earliest = np.full(int(which.max()) + 1 if len(which) else 0, len(order))
    np.minimum.at(earliest, which, rank)
    first = earliest[which] == rank  # of equal runs
    out = np.repeat(~first, windows)
    own = np.flatnonzero(first)
    n = windows[own]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    window, run = np.repeat(start[own], n) + within, np.repeat(own, n)
    # a window whose hash no other has is no repeat, and needs no place in the suffix order
    rolling = Rolling(31)
    _, same, times = np.unique(rolling.hashes(rolling.sums(data), window, window + LENGTH), return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[same] > 1)
    if len(some):
        keep = np.unique(run[some])
        size = windows[keep] + LENGTH - 1
        moved = np.zeros(len(start), np.int64)
        moved[keep] = np.cumsum(size) - size
        # by document, block and place of the window
        key = np.lexsort((at[run[some]] + within[some], block[run[some]], doc[run[some]]))
        position = np.empty(len(some), np.int64)
        position[key] = np.arange(len(some))
        lpf = longest_previous_factors(gathered(data, start[keep], size), moved[run[some]] + within[some], position)
        to = np.cumsum(windows) - windows
        out[to[run[some]] + within[some]] = lpf >= LENGTH
    return out


def _resolve(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    numbers, texts, found = [unbundle(r["a"]) for r in rows], [unbundle(r["b"]) for r in rows], [[] for _ in rows]
    for part in range(PARTS):
        some = [k for k in range(len(rows)) if numbers[k][part]]
        if not some:
            continue
        windows, docs, ats = [], [], []
        for k in some:
            n, doc, at = (unpack(x, kind) for x, kind in zip(unbundle(numbers[k][part]), (np.uint8, np.int64, np.uint32), strict=True))
            windows.append(n.astype(np.int64))
            docs.append(doc)
            ats.append(at.astype(np.int64))
        data = np.frombuffer(b"".join([zstandard.decompress(texts[k][part]) for k in some]), np.uint8)
        n = np.concatenate(windows)
        size = n + LENGTH - 1
        repeats = repeated_windows(data, np.cumsum(size) - size, n, np.concatenate(docs), np.repeat(some, list(map(len, windows))), np.concatenate(ats))
        a = 0
        for k, w in zip(some, windows, strict=True):
            found[k].append(repeats[a : a + int(w.sum())])
            a += int(w.sum())
    release()
    return message_rows([(r["block"], SENT, r["bucket"], zstandard.compress(np.packbits(np.concatenate(x)).tobytes(), 1), None, None) for r, x in zip(rows, found, strict=True)])


def _cut(with_text: bool, buckets: int, order: Order):
    def rows(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        told, out = answers.to_pylist(), []
        for row in blocks.to_pylist():
            docs, data, offsets, runs = _block(row, order)
            mine = [r for r in told if r["block"] == row["block"]]
            start, windows, _, _, bounds = runs.sent(_told(mine), data, buckets)
            # +1 where a covered stretch begins, -1 after its end
            edge = np.zeros(len(data) + LENGTH + 1, np.int16)  # at most LENGTH windows cover a byte
            copies = np.ones(len(runs.start), bool)
            copies[runs.first] = False
            np.add.at(edge, runs.start[copies], 1)
            np.add.at(edge, runs.stop[copies] + LENGTH - 1, -1)
            for r in ordered(mine, SENT):
                a, z = bounds[r["bucket"] * PARTS], bounds[(r["bucket"] + 1) * PARTS]
                n = windows[a:z]
                window = np.repeat(start[a:z] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                window = window[np.unpackbits(np.frombuffer(zstandard.decompress(r["a"]), np.uint8))[: len(window)].astype(bool)]
                np.add.at(edge, window, 1)
                np.add.at(edge, window + LENGTH, -1)
            covered = np.cumsum(edge[: len(data)], dtype=np.int16) > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begins[heads] = covered[heads]
            removed, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (covered, begins))
            for k, doc in enumerate(docs):
                a, z = int(offsets[k]), int(offsets[k + 1])
                kept = data[a:z].tobytes() if removed[k] == removed[k + 1] else data[a:z][~covered[a:z]].tobytes()
                out.append((doc, z - a, int(removed[k + 1] - removed[k]), int(spans[k + 1] - spans[k]), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        release()
        names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64()] * 4 + [pa.string(), pa.binary()]
        n = 5 + with_text
        columns = list(zip(*out, strict=True)) if out else [[]] * n
        return pa.table([pa.array(c, t) for c, t in zip(columns, types[:n], strict=True)], names=names[:n])

    return rows


def _counted(batches):
    """Pieces that a block holds several times, with the block's documents."""
    for b in batches:
        for row in _each(b):
            data, offsets, grams, found = np.frombuffer(zstandard.decompress(row["text"]), np.uint8), unpack(row["offsets"], np.int64), Rolling(11), []
            for at, to in pieces(offsets, SLICE):
                part = data[offsets[at] : offsets[to]]
                if len(part) >= GRAM:
                    start = np.arange(len(part) - GRAM + 1)
                    found.append(grams.hashes(grams.sums(part), start, start + GRAM))
            gram, n = np.unique(joined(found, np.uint64), return_counts=True)
            few = n < 4
            yield pa.RecordBatch.from_arrays([pa.array(gram[~few].view(np.int64)), pa.array(n[~few].astype(np.int64)), pa.array(np.full(int((~few).sum()), len(offsets) - 1))], ["gram", "n", "docs"])


def frequent_pieces(blocks: DataFrame) -> np.ndarray:
    """At most LAST hashes of pieces that are frequent in SAMPLE_BLOCKS blocks, those whose hashed numbers come first."""
    some = [r["block"] for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()]
    if not some:
        return np.zeros(0, np.uint64)
    sample = blocks.where(F.col("block").isin(some))
    docs = sum(len(unpack(r["offsets"], np.int64)) - 1 for r in sample.select("offsets").collect())  # SAMPLE_BLOCKS rows
    counts = sample.mapInArrow(_counted, "gram long, n long, docs long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= max(8, FREQUENT * docs)).orderBy(F.desc("n"), "gram").limit(LAST).select("gram").collect()
    return np.array([r["gram"] for r in top], np.int64).view(np.uint64)


def repeats_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the bytes kept.

    Texts are UTF-8 bytes, null empty; matches never cross rows. Rows are ordered by id, null ids last, and rows of equal
    ids as they are read. A text may have any length; its windows are worked on in slices. Other columns are not read. An
    empty table gives an empty result.
    """
    buckets = shuffle_width(docs.sparkSession)
    blocks = bucketed(text_blocks(docs, id_col, text_col), "text_blocks", "block", buckets)
    order = Order(frequent_pieces(blocks))
    asked = blocks.mapInArrow(releasing(_ask(buckets, order)), ROW_COLUMNS)
    answers = written(asked.groupBy("bucket").applyInArrow(_answer(HOT_RUNS), ROW_COLUMNS), "run-answers")
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(buckets, order), ROW_COLUMNS)
    resolved = sent.groupBy("bucket").applyInArrow(_resolve, ROW_COLUMNS)
    told = answers.unionByName(resolved)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cut(with_text, buckets, order), result)


def op9_suffix_dedup(spark, sf_dir):
    return repeats_cut(table(spark, sf_dir, "documents"))
