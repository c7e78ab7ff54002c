"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

A document's ids are cut into pieces of the sequence length and a rest, so only lengths matter for packing. The driver
sees the histogram of piece lengths (at most `size` rows, whatever the corpus) and fills packing patterns from it: longest
pieces first, each onto the least filled open pattern that has room, with counts instead of single sequences. A pattern
slot takes a range of ranks among the pieces of its length; pieces are ranked by their map task and place within it, and
find their slot by binary search.
"""

from __future__ import annotations

import array
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.common import distinct_words, flat, gathered, pieces, releasing, same_bytes, table, words_of, written

SIZE = 2048
#: Words that a worker remembers the ids of, before it forgets the rarest.
REMEMBERED = 800_000
#: Bytes of texts, unless one is longer, and words encoded at once.
SLICE, WORDS = 1_000_000, 250_000


#: A word of letters up to U+00FF and marks after it: such a word splits there, and lower-casing it is simple.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?%$#&*]*)")


def _byte_letters() -> dict[int, str]:
    """For letters from U+0080 to U+00FF, how byte-level vocabularies write their UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


_PROBES = ["the", "thonenanou", "élève", "straße", "%%%", "señorías", ".", "çà"]


def _compacted(flat_: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces that begin there, one after another, and where they begin now."""
    return gathered(flat_, begin.astype(np.int64), length), (np.cumsum(length, dtype=np.int64) - length).astype(np.int32), length


class WordEncoder:
    """Encodes by words: in a tokenizer that never joins characters across white space, words can be encoded one by one.

    Ids are kept by the word's 64-bit hash, in sorted arrays, beside the word's bytes: a word is known if these are equal, so
    words of equal hashes cost time and nothing else. Beyond REMEMBERED words, those seen only once are forgotten.
    A new word made of simple letters and marks is put together from its parts, so case and punctuation don't make the
    tokenizer run again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # simple parts need neither normalising nor splitting; probes tell whether this tokenizer is of that kind
        self.bare, self.letters = Tokenizer(self.tokenizer.model), _byte_letters()
        plain = [e.ids for e in self.tokenizer.encode_batch(_PROBES, add_special_tokens=False)]
        self.short_cut = plain == [e.ids for e in self.bare.encode_batch([x.translate(self.letters) for x in _PROBES], add_special_tokens=False)]
        self.parts: dict[str, bytes] = {}
        self.empty(self.tokenizer.get_vocab_size())

    def empty(self, vocabulary: int) -> None:
        self.hashes, self.flat, self.text = np.zeros(0, np.uint64), np.zeros(0, np.uint16 if vocabulary <= 1 << 16 else np.uint32), np.zeros(0, np.uint8)
        self.begin, self.length, self.seen, self.at, self.size = (np.zeros(0, np.int32) for _ in range(5))

    def _forget(self) -> None:
        stay = np.flatnonzero(self.seen > 1)
        if len(stay) > REMEMBERED // 2:
            stay = np.sort(stay[np.argsort(self.seen[stay])[-REMEMBERED // 2 :]])
        self.flat, self.begin, self.length = _compacted(self.flat, self.begin[stay], self.length[stay])
        self.text, self.at, self.size = _compacted(self.text, self.at[stay], self.size[stay])
        self.hashes, self.seen = self.hashes[stay], np.ones(len(stay), np.int32)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words_of(data, offsets, b" \n")

    def ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids as 32-bit integers."""
        if len(self.parts) > REMEMBERED // 20:
            self.parts = {}
        split, parts, simple, other = [], self.parts, {}, {}
        for w in words:
            m = _SIMPLE.fullmatch(w) if self.short_cut else None
            pair = (m[1].lower(), m[2]) if m else (w, "")
            split.append(pair)
            for x in pair:
                if x not in parts:
                    (simple if m else other)[x] = None
        for new, encoder in ((list(simple), self.bare), (list(other), self.tokenizer)):
            given = [x.translate(self.letters) for x in new] if encoder is self.bare else new
            for at in range(0, len(new), 4096):
                for x, e in zip(new[at : at + 4096], encoder.encode_batch_fast(given[at : at + 4096], add_special_tokens=False), strict=True):
                    parts[x] = array.array("I", e.ids).tobytes()
        return [parts[a] + parts[b] for a, b in split]

    def _ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids([data[a:z].tobytes().decode() for a, z in zip(start.tolist(), end.tolist(), strict=True)])
        return np.frombuffer(b"".join(ids), np.uint32).astype(self.flat.dtype), np.fromiter(map(len, ids), np.int32, len(ids)) // 4

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Words in the order of their hashes, no two of which are equal, nor equal to one that is known."""
        ids, length = self._ids_of(data, start, end)
        size = (end - start).astype(np.int32)
        place = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, place, (len(self.flat) + np.cumsum(length) - length).astype(np.int32))
        self.at = np.insert(self.at, place, (len(self.text) + np.cumsum(size) - size).astype(np.int32))
        self.length, self.size = np.insert(self.length, place, length), np.insert(self.size, place, size)
        self.seen, self.hashes = np.insert(self.seen, place, 0), np.insert(self.hashes, place, hashes)
        self.flat = np.concatenate([self.flat, ids])
        self.text = np.concatenate([self.text, gathered(data, start, size)])

    def _known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's place among the hashes, whether that hash is there, and whether it is that very word's, by its bytes."""
        place = np.searchsorted(self.hashes, hashes)
        there = place < len(self.hashes)
        there[there] = self.hashes[place[there]] == hashes[there]
        same = there.copy()
        same[there] = self.size[place[there]] == (end - start)[there]
        same[same] = same_bytes(data, start[same], self.text, self.at[place[same]].astype(np.int64), (end - start)[same])
        return place, there, same

    def _encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, and each word's number of ids."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        hashes, some, which = distinct_words(data, start, end)
        start, end = start[some], end[some]
        _, there, _ = self._known(data, start, end, hashes)
        new = ~there
        new[1:] &= hashes[1:] != hashes[:-1]
        if new.any():
            self._learn(data, start[new], end[new], hashes[new])
        place, _, same = self._known(data, start, end, hashes)
        pool = self.flat
        begin, length = np.zeros(len(some), np.int64), np.zeros(len(some), np.int32)
        begin[same], length[same] = self.begin[place[same]], self.length[place[same]]
        self.seen[place[same]] += np.bincount(which, minlength=len(some)).astype(np.int32)[same]
        if not same.all():  # another word has this hash
            ids, n = self._ids_of(data, start[~same], end[~same])
            begin[~same], length[~same] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids])
        return gathered(pool, begin[which], length[which]), length[which]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows' bytes in one array, and each row's number of ids. Words are taken WORDS at a time, so a long text is not worked on as a whole."""
        start, end, first = self.words(data, offsets)
        ids, ends, total = [], [np.zeros(1, np.int64)], 0
        for at in range(0, len(start), WORDS):
            a, z = start[at : at + WORDS], end[at : at + WORDS]
            low = int(a[0])
            found, length = self._encode_words(data[low : z[-1]], a - low, z - low)
            ids.append(found)
            ends.append(total + np.cumsum(length, dtype=np.int64))
            total = int(ends[-1][-1])
        return np.concatenate([*ids, np.zeros(0, self.flat.dtype)]), np.diff(np.concatenate(ends)[first])


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def _piece_rows(path: str, size: int, end_id: int | None, with_ids: bool):
    def rows(batches):
        encoder, seen, part = _encoder(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for at, to in pieces(offsets, SLICE):
                b = batch.slice(at, to - at)
                tokens, counts = encoder.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                out, ids, begin = [], [], 0
                for doc, n in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
                    own = tokens[begin : begin + n].astype("<u4")
                    begin += n
                    if end_id is not None:
                        own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), size):
                        piece = own[start : start + size]
                        out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(own), part, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                if out:
                    columns = [pa.array(x, pa.int32() if k == 5 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))]
                    if with_ids:
                        columns.append(pa.array(ids, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids)

    return rows


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold each length as often as the histogram says, none over size.

    Lengths are placed longest first, each onto the packs with the most room; packs are opened only where none has room.
    """
    open_packs: list[list[tuple[int, tuple | None]]] = [[] for _ in range(size + 1)]  # by room left; a pack is (length, rest of the pack)
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], size
        while left and room >= length:
            if not open_packs[room]:
                room -= 1
                continue
            count, pack = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((count - used, pack))
            open_packs[room - length].append((used, (length, pack)))
            left -= used
        # new packs: a second one of this length goes onto the first as long as it has room
        for times, k in ((left // (size // length), size // length), (1 if left % (size // length) else 0, left % (size // length))):
            if times:
                pack = None
                for _ in range(k):
                    pack = (length, pack)
                open_packs[size - k * length].append((times, pack))
    out = []
    for count, pack in (x for packs in open_packs for x in packs):
        lengths = []
        while pack:
            lengths.append(pack[0])
            pack = pack[1]
        out.append((count, lengths[::-1]))
    return out


def _slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank), and for each the sequence of that rank, the offset there and the sequence's tokens."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset, total = 0, sum(lengths)
        for length in lengths:
            first = taken.get(length, 0)
            rows.append(((length << 48) + first, sequence - first, offset, total))
            taken[length], offset = first + count, offset + length
        sequence += count
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table_[:, 0].copy(), table_[:, 1].copy(), table_[:, 2].copy(), table_[:, 3].copy()


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, and with_ids the ids.

    A document's ids are those of its whole text (null: empty), then end_id; each lies in exactly one piece. Without
    end_id, empty texts have no piece. Null and repeated doc_ids are packed like any other. Other columns of docs are
    not read. A text may have any length; its ids are held by one task, its words are encoded WORDS at a time. Lengths
    that tie are placed in the order of their pieces. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = written(rows.mapInArrow(releasing(_piece_rows(tokenizer_path, size, end_id, with_ids)), _PIECES + ", ids array<int>" * with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    keys, sequences, offsets, totals = _slots(pack_histogram(histogram, size))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))

    def placed(batches):
        for b in batches:
            rank, length = b.column(b.schema.get_field_index("rank")).to_numpy(), b.column(b.schema.get_field_index("length")).to_numpy()
            slot = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            columns = [b.column(b.schema.get_field_index(x)) for x in kept]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in (sequences[slot] + rank, offsets[slot], totals[slot])], kept + ["sequence_id", "offset", "sequence_tokens"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return ranked.select(*kept, "rank").mapInArrow(placed, _PIECES.partition(", part")[0] + ", ids array<int>" * with_ids + ", sequence_id long, offset long, sequence_tokens long")


def op2_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
