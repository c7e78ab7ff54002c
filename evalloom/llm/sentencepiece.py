"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text's marked words (a run of word marks and what follows it) are encoded by themselves, the distinct new ones of a
batch at a time. In sorted order they are the depth-first walk of their trie: the forward table of a word is kept as far
as the next word shares its prefix, so a common prefix is scored once.

For a unigram model the table holds the best score of each prefix. A BPE model gives no sum to maximise: its table holds
the one piece that ends the prefix's merge result. A piece may follow another only if merging their joint text gives just
the two; by that rule each prefix has exactly one last piece, and the backward walk gives the ids that merging gives.
Words that hold a run of word marks are merged directly, as such pieces have equal ranks.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import flat, pieces, table
from evalloom.llm.packing import SLICE, WordEncoder

MARK = "▁"
#: Scores of unknown characters lie this far below the least score of a unigram model (fixed by the format's library).
UNKNOWN_PENALTY = 10.0


class PieceEncoder(WordEncoder):
    """Reads a SentencePiece model of type unigram or BPE whose normaliser is the identity."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation, with word marks before words, are read")
        self.bpe = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL}
        self.number = {p.piece: k for k, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
        self.longest = max(map(len, self.score), default=1)
        #: whether words and line ends never share a piece
        self.parted = not any(MARK in x.lstrip(MARK) or ("\n" in x and x != "\n") for x in self.score)
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.surface = [b""] * len(model.pieces)
        for x, k in self.number.items():
            self.surface[k] = x.replace(MARK, " ").encode()
        for b, k in self.byte.items():
            self.surface[k] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_size = np.array(list(map(len, self.surface)), np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.whole: dict[str, bool] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.empty(len(model.pieces))

    def merged(self, text: str) -> list[str]:
        """What merging the best-ranked neighbours first, leftmost on ties, makes of text."""
        part: list[str | None] = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(part):
                joined = part[a] + part[b]
                if joined in self.score:
                    heapq.heappush(heap, (-self.score[joined], a, b, joined))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b], after[a] = joined, None, after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [x for x in part if x is not None]

    def _whole(self, piece: str) -> bool:
        if piece not in self.whole:
            self.whole[piece] = piece in self.score and self.merged(piece) == [piece]
        return self.whole[piece]

    def _follows(self, a: str, b: str) -> bool:
        """Whether merging a + b leaves a and b as they are."""
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 400_000:
                self.follows.clear()
            found = self.follows[a, b] = self.merged(a + b) == [a, b]
        return found

    def _last_piece(self, word: str, i: int, ends: list[str]) -> str:
        """ends[k]: the last piece of the word's first k characters, for k < i."""
        whole = self.whole
        for k in range(max(0, i - self.longest), i):
            piece = word[k:i]
            if piece in self.score and (whole[piece] if piece in whole else self._whole(piece)) and (not k or self._follows(ends[k], piece)):
                return piece
        return word[i - 1]  # a character without a piece

    def segmented(self, words: list[str]) -> dict[str, list[str]]:
        """The pieces of each of the distinct words."""
        out, path, ends, best = {}, "", [""], [0.0]
        for word in sorted(words):
            if self.bpe and MARK + MARK in word:
                out[word] = self.merged(word)
                continue
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del ends[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                if self.bpe:
                    ends.append(self._last_piece(word, i, ends))
                    continue
                top, piece = best[i - 1] + self.least, word[i - 1]
                for k in range(max(0, i - self.longest), i):
                    s = self.score.get(word[k:i])
                    if s is not None and best[k] + s > top:
                        top, piece = best[k] + s, word[k:i]
                ends.append(piece)
                best.append(top)
            path, i, found = word, len(word), []
            while i:
                found.append(ends[i])
                i -= len(ends[i])
            out[word] = found[::-1]
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        marked = [w.replace(" ", MARK) for w in words]
        found, out = self.segmented(list(set(marked))), []
        for w in marked:
            ids: list[int] = []
            for x in found[w]:
                if x in self.number:
                    ids.append(self.number[x])
                elif self.byte:
                    ids += [self.byte[b] for b in x.encode()]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
            out.append(array.array("I", ids).tobytes())
        return out

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A word begins at a row's start, at a space after another byte, and at and after a line end."""
        begins = np.zeros(len(data) + 1, bool)
        if self.parted:
            space, line = data == 32, data == 10
            begins[:-1] = space | line
            begins[1:-1] &= ~(space[1:] & space[:-1])
            begins[1:] |= line
        begins[offsets] = True
        start = np.flatnonzero(begins[:-1]) if len(data) else np.zeros(0, np.int64)
        return start, np.append(start[1:], len(data)) if len(start) else start, np.searchsorted(start, offsets)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """All ids and each row's number of them, then the marked text they encode and its offsets."""
        if self.prefix:
            some = np.diff(offsets) > 0
            added = np.concatenate([[0], np.cumsum(some)])
            marked = np.full(len(data) + int(added[-1]), 32, np.uint8)
            marked[np.arange(len(data)) + np.repeat(added[1:], np.diff(offsets))] = data
            data, offsets = marked, offsets + added
        return *self.encode(data, offsets), data, offsets

    def decode_rows(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, with the prefix mark, and each row's offsets."""
        size = self.surface_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.surface_bytes[np.repeat(self.surface_at[ids] - (ends - size), size) + np.arange(total)]
        return data, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


_encoders: dict[str, PieceEncoder] = {}


def encoder_at(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each whole text; null counts as empty, which has no ids. Other columns are not read."""

    def rows(batches):
        for doc, ids, counts, _ in _sliced(batches, model_path):
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(rows_: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids count as none. Bytes that are no UTF-8 become replacement characters."""

    def rows(batches):
        encoder = encoder_at(model_path)
        for b in batches:
            lists = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            data, offsets = encoder.decode_rows(np.concatenate([*lists, np.zeros(0, np.int64)]), np.array(list(map(len, lists)), np.int64))
            texts = [data[a:z].tobytes() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(t[1:] if encoder.prefix and t[:1] == b" " else t).decode("utf-8", "replace") for t in texts])], ["doc_id", "text"])

    return rows_.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(rows, "doc_id long, text string")


def _sliced(batches, model_path: str):
    """(doc ids, ids, their counts, whether decoding gives each text back) for slices of the batches."""
    encoder = encoder_at(model_path)
    for b in batches:
        texts = b.column(1)
        data, offsets = flat(texts)
        given = data
        if MARK.encode() in data.tobytes():  # a mark in the text counts as a space
            data, offsets = flat(pa.array([(x or "").replace(MARK, " ") for x in texts.to_pylist()], pa.string()))
            given = None
        for at, to in pieces(offsets, SLICE):
            ids, counts, marked, bounds = encoder.encode_rows(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            back, ends = encoder.decode_rows(ids, counts)
            if np.array_equal(back, marked) and np.array_equal(ends, bounds):
                same = np.ones(to - at, bool)
            else:
                same = np.array([np.array_equal(back[a:z], marked[p:q]) for a, z, p, q in zip(ends[:-1], ends[1:], bounds[:-1], bounds[1:], strict=True)], bool)
            if given is None:
                same &= np.array([MARK not in (x or "") for x in texts.slice(at, to - at).to_pylist()], bool)
            yield b.column(0).slice(at, to - at), ids, counts, same


def digested(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 and ids_sha256 (of little-endian unsigned 32-bit ids), and whether decoding gives the text back.

    One row per row: null and repeated ids are kept, null texts count as empty, which have no ids. Texts may have any
    length. A word mark in a text counts as a space, so decoding doesn't give it back. Other columns are not read. An
    empty table gives an empty result.
    """

    def rows(batches):
        for doc, ids, counts, same in _sliced(batches, model_path):
            ids, out, at = ids.astype("<u4"), [], 0
            for n in counts.tolist():
                own = ids[at : at + n].tobytes()
                at += n
                out.append((n, zlib.crc32(own), hashlib.sha256(own).hexdigest()))
            n, crc, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "ids_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, "doc_id long, n_ids long, ids_crc32 long, ids_sha256 string, round_trip boolean")


def op4_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return digested(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
