import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import evalloom.llm.packing as packing
from evalloom.llm import common
from evalloom.llm.common import flat

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_histogram():
    for seed in range(200):
        random.seed(seed)
        size = random.choice([8, 16, 64])
        histogram = {random.randint(1, size): random.randint(1, 50) for _ in range(random.randint(0, 20))}
        held = {}
        for count, lengths in packing.pack_histogram(histogram, size):
            assert sum(lengths) <= size and count > 0
            for n in lengths:
                held[n] = held.get(n, 0) + count
        assert held == histogram


@pytest.mark.parametrize("remembered", [10, 1_000_000])
def test_ids(sample, odd, remembered, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    texts = [r.text or "" for r in sample.limit(60).collect() + odd.collect()] + ["don't it's X'S", "Σίσυφος ΟΔΟΣ", "a　b\tc\r\nd", "ÀÉ %%% ...", "<|endoftext|>"]
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for at in range(0, len(texts), 7):
        ids, counts = encoder.encode(*flat(pa.array(texts[at : at + 7])))
        want = [e.ids for e in tokenizer.encode_batch(texts[at : at + 7], add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_pieces(odd):
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(odd, PATH, with_ids=True).collect()
    rows = odd.collect()
    want = sorted((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in rows if r.doc_id not in (None, 2))
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted((d, tuple(i for r in sorted(x, key=lambda r: r.start) for i in r.ids)) for d, x in by_doc.items() if d not in (None, 2)) == want
    assert sum(r.start == 0 for r in got) == len(rows)
    for x in by_sequence.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == x[0].sequence_tokens <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_little_padding(sample):
    got = packing.pack(sample, PATH).collect()
    assert sum(r.length for r in got) / (2048 * len({r.sequence_id for r in got})) > 0.97


def test_empty(none):
    assert packing.pack(none, PATH).collect() == []


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_of_equal_polynomial_hashes(spark, n):
    """Thue-Morse words collide in polynomial hashes modulo 2**64, whatever the base."""
    texts = [thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]
    tokenizer = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids_crc32 for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert got == {k: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in enumerate(texts)}


def test_words_of_equal_hashes(monkeypatch):
    """A hash says where to look only: with seven hashes in all, ids stay right."""
    real = common.word_hashes
    monkeypatch.setattr(common, "word_hashes", lambda *x: real(*x) % np.uint64(7))
    monkeypatch.setattr(packing, "WORDS", 50)
    rng = random.Random(2)
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("abcé'") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 60))) for _ in range(20)]
        ids, counts = encoder.encode(*flat(pa.array(texts)))
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
