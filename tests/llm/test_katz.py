import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import evalloom.llm.blocks as blocks
import evalloom.llm.katz as katz
from evalloom.llm.katz import K, good_turing, score


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def discounted(c, d):
    return c if c > K else c * d[c]


def plain(rows, order=3):
    """(rows scored by a plain recursion, a function for P(w | h))"""
    counts = [Counter() for _ in range(order + 1)]  # by length: n-grams, as tuples
    followers = defaultdict(set)
    for i, t in rows:
        stream = [b"<s> ", *tokens(t)] if not held(i) else []
        for k in range(1, order + 1):
            for at in range(1 if k == 1 else k - 1, len(stream)):
                gram = tuple(stream[at - k + 1 : at + 1])
                counts[k][gram] += 1
                followers[gram[:-1]].add(gram[-1])
    n, v = sum(counts[1].values()), len(counts[1])
    d = [None] + [good_turing([sum(x == r for x in c.values()) for r in range(1, K + 2)]) for c in counts[1:]]

    @functools.cache
    def total(h):
        seen = [counts[len(h) + 1][*h, w] for w in followers[h]]
        return sum(seen) + (min(seen) > K if seen else 0)

    @functools.cache
    def p(h, w):
        if counts[len(h) + 1][*h, w]:
            return discounted(counts[len(h) + 1][*h, w], d[len(h) + 1]) / total(h)
        if not h:
            return 1 - sum(discounted(c, d[1]) for c in counts[1].values()) / total(()) if n else 1.0
        return weight(h) * p(h[1:], w)

    @functools.cache
    def weight(h):
        return (1 - sum(p(h, w) for w in followers[h])) / (1 - sum(p(h[1:], w) for w in followers[h])) if followers[h] else 1.0

    out = []
    for i, t in rows:
        stream = [b"<s> ", *tokens(t)]
        base = sum(math.log10((counts[1][w,] + 0.5) / (n + 0.5 * (v + 1))) for w in stream[1:])
        total_ = sum(math.log10(p(tuple(stream[max(0, at - order + 1) : at]) if order > 1 else (), stream[at])) for at in range(1, len(stream)))
        out.append((i, held(i), len(stream) - 1, sum(counts[1][w,] > 0 for w in stream[1:]), n, base, total_))
    return out, p, [w for w, in counts[1]], [h for h in followers]


def key(r):
    return str((r[0], r[1], r[2], r[3], round(r[5], 3)))


@pytest.mark.parametrize("block", [3000, 6_000_000])
def test_against_counters(spark, sample, odd, block, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows = sample.limit(60).select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(3).cache()
    same(score(rows).collect(), plain([tuple(r) for r in rows.collect()])[0])


def same(got, want):
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-6) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-6)


def small_words(seed, n=120):
    """Few words, so that counts of all sizes, and histories of frequent words only, occur."""
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice("a b c dd ee Ff g h".split()[: rng.choice([2, 5, 8])]) for _ in range(rng.randrange(0, 25)))) for i in range(n)]
    return [*out, (None, "a b"), (3, "zz a zz"), (n + 1, None)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("hot", [5, 1000])
def test_few_words(spark, order, hot, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 300)
    monkeypatch.setattr(katz, "HOT", hot)
    rows = small_words(order)
    same(score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order).collect(), plain(rows, order)[0])


def test_probabilities_sum_to_one():
    """Of all words and the unknown ones, for each history, seen or not."""
    for seed in range(3):
        _, p, words, histories = plain(small_words(seed))
        for h in [*histories, (b"a", b"never"), (b"never",)]:
            assert math.isclose(sum(p(h, w) for w in words) + p(h, b"unknown"), 1, rel_tol=1e-9)


def test_words_of_equal_polynomial_hashes(spark):
    x, y = ("".join((a, b)[k.bit_count() % 2] for k in range(1024)) for a, b in ("ab", "ba"))
    train, out = next(i for i in range(99) if not held(i)), next(i for i in range(99) if held(i))
    got = {r.doc_id: r.n_known for r in score(spark.createDataFrame([(train, x), (out, y)], "doc_id long, text string")).collect()}
    assert got == {train: 2, out: 1}


def test_nothing_to_train_on(spark):
    out = [i for i in range(99) if held(i)][:3]
    got = score(spark.createDataFrame([(i, f"a b {i}") for i in out], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in got] == [(0, 0, 0.0)] * 3


def test_train_column(spark):
    """Any table can be scored by the counts of another."""
    rows = [(i, t, i is not None and i < 60) for i, t in small_words(7)]
    got = score(spark.createDataFrame(rows, "doc_id long, text string, ours boolean"), train_col="ours").collect()
    assert {r.held_out for r in got if r.doc_id is not None and r.doc_id >= 60} == {True}
    assert got[0].train_tokens == sum(len(tokens(t)) for _, t, x in rows if x)


def test_better_than_the_base(spark, sf):
    got = [r for r in score(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_empty(none):
    assert score(none).collect() == []


def test_bigrams_seen_once(spark):
    """A bigram that training holds once is likelier than one that it lacks, of words as frequent."""
    train = [i for i in range(100) if not held(i)]
    rows = [(train[0], "rare pair"), (train[1], "some other"), *[(i, f"filler{i % 7} text") for i in train[2:]]]
    out = [i for i in range(100, 200) if held(i)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame([*rows, (out[0], "rare pair"), (out[1], "rare other")], "doc_id long, text string")).collect()}
    assert got[out[0]] > got[out[1]] + 0.1
