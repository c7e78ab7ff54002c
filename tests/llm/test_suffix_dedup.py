import hashlib
import random

import numpy as np
import pytest

import evalloom.llm.blocks as blocks
import evalloom.llm.suffix_dedup as S
from evalloom.llm.suffix_dedup import repeats_cut


def plain(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    random.seed(seed)
    words = ["ab", "cde", "fgh ", "the ", "xx", "é"]
    passages = ["".join(random.choice(words) for _ in range(random.randint(20, 120))) for _ in range(12)]
    piece = lambda: random.choice(passages)[random.randint(0, 30) : random.randint(60, 300)] if random.random() < 0.7 else "".join(random.choice(words) for _ in range(random.randint(1, 50)))
    rows = [(k, "".join(piece() for _ in range(random.randint(0, 9)))) for k in range(120)]
    random.shuffle(rows)
    return [*rows, (900, "a" * 500), (901, "a" * 99), (902, "ab" * 150), (903, None), (904, ""), (None, "a" * 101), (905, "a" * 100 + "b")]


@pytest.mark.parametrize(("seed", "hot", "slice_"), [(1, 20_000, 250_000), (2, 2, 250_000), (3, 5, 150)])
def test_against_a_set_of_windows(spark, seed, hot, slice_, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 5000)
    monkeypatch.setattr(S, "HOT_RUNS", hot)
    rows = [*made(seed), (2000, thue_morse(2048, "a", "b")), (2001, thue_morse(2048, "b", "a")), (2002, "x" + thue_morse(2048, "a", "b"))]
    order = S.Order(np.zeros(0, np.uint64))
    for text in (rows[0][1] * 9, "".join(t or "" for _, t in rows)):  # runs cut in slices hold the same windows
        data, whole = np.frombuffer(text.encode(), np.uint8), []
        for size in (slice_, 250_000):
            monkeypatch.setattr(S, "SLICE", size)
            r = S.Runs(data, np.array([0, len(data)]), [1], order)
            whole.append(sorted((int(w), int(x)) for a, z, x in zip(r.start, r.stop, r.anchor, strict=True) for w in range(a, z)))
        assert whole[0] == whole[1]
    got = repeats_cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


def test_longest_previous_factors():
    """Against all pairs of positions."""
    rng = np.random.default_rng(4)
    for letters, n in ((2, 90), (3, 150), (1, 40), (2, 1)):
        data = rng.integers(97, 97 + letters, n, dtype=np.uint8)
        start = rng.permutation(n)[: max(1, n // 2)]
        position = rng.permutation(len(start))
        got = S.longest_previous_factors(np.concatenate([data, np.zeros(20, np.uint8)]), start, position, 12)
        padded = data.tobytes() + bytes(20)
        same = lambda x, y: next((k for k in range(12) if padded[x + k] != padded[y + k]), 12)
        want = [max((same(x, y) for y, q in zip(start, position, strict=True) if q < p), default=0) for x, p in zip(start, position, strict=True)]
        assert got.tolist() == want


def test_removal_rests_on_bytes(spark, monkeypatch):
    """With all hashes of runs and windows alike, results are the same."""
    monkeypatch.setattr(S.Rolling, "hashes", lambda self, sums, start, end: np.full(len(start), 5, np.uint64))
    rows = made(5)[:30]
    data = "".join(t or "" for _, t in rows).encode()
    start = np.arange(0, len(data) - 140, 7)
    n = np.full(len(start), 20)
    got = S.repeated_windows(np.frombuffer(data, np.uint8), start, n, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), start)
    seen, want = set(), {}
    for w in sorted({int(s) + k for s in start for k in range(20)}):
        want[w] = data[w : w + 100] in seen
        seen.add(data[w : w + 100])
    firsts = {}
    for k, w in enumerate((start[:, None] + np.arange(20)).ravel().tolist()):
        if w not in firsts:
            firsts[w] = True
            assert got[k] == want[w]


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()]
    assert sorted(map(tuple, repeats_cut(odd.where("doc_id is not null")).collect()), key=str) == plain(rows)
    assert repeats_cut(none).collect() == []


def test_text_kept(spark):
    line = "".join(map(str, range(60)))
    rows = spark.createDataFrame([(1, line + "x"), (2, "y" + line + "z")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in repeats_cut(rows, with_text=True).collect()} == {1: (line + "x").encode(), 2: b"yz"}
