import random

import numpy as np
import pytest
from pyspark.sql import Row

import evalloom.llm.near_dedup as N
from evalloom.llm.components import labels


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def clusters(texts):
    """By brute force: the least place that each text reaches."""
    sets = [plain(t) for t in texts]
    a, b = [], []
    for k, x in enumerate(sets):
        for m in range(k):
            if 5 * len(x & sets[m]) >= 4 * len(x | sets[m]):
                a.append(k)
                b.append(m)
    return labels(len(sets), np.array(a, int), np.array(b, int)).tolist()


def stays(rows):
    """Of rows (id, text), one of each group: that of the smallest id, null ids last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return [r for k, (r, c) in enumerate(zip(rows, clusters([t for _, t in rows]), strict=True)) if k == c]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [16, 2])
def test_against_all_pairs(spark, odd, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rng = random.Random(4)
    line = " ".join(f"common{k}" for k in range(12))
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(4, 150))]
        texts += [" ".join(words), f"{line} {' '.join(words)}", *(edited(rng, words, k) for k in (1, 1, 2, 3, 4, 5))]
    base = [f"b{k}" for k in range(120)]
    texts += [edited(rng, base, rng.randrange(1, 4)) for _ in range(60)]  # a group whose ends are not all alike
    ids = rng.sample(range(10**6), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[0]), (-5, ""), (-6, " \n"), (-7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = stays(rows)
    assert len(want) < len(rows) - 60
    assert sorted(map(str, N.without_similar(docs).collect())) == sorted(map(str, map(lambda r: docs_row(*r), want)))


def docs_row(i, t):
    return Row(doc_id=i, text=t)


@pytest.mark.parametrize("part", [4, 64])
def test_large_groups_in_parts(spark, monkeypatch, part):
    """A group dealt over tasks, some of whose rows only meet rows of other parts."""
    monkeypatch.setattr(N, "PART", part)
    monkeypatch.setattr(N, "SMALL", 3)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join([*base[:40], edited(rng, base[40:], rng.randrange(0, 9))])) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in N.without_similar(docs).collect()) == [i for i, _ in stays(rows)]


def test_sketches():
    """Differing bits are never more than differing shingles, for all sizes."""
    rng = np.random.default_rng(1)
    for n in (3, 400, 600, 3000, 9000, 80_000):
        x, y = (np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[len(x) // 10 :], y[: n // 9]]))
        found, row, size = np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)])
        s = N.Sketches(N.sketches(found, row, size))
        assert (n > 3) <= s.differing(np.array([0]), np.array([1]))[0] <= len(np.setxor1d(x, y))


def test_documents(spark, sf, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(r.doc_id for r in N.without_similar(docs).collect()) == sorted(i for i, _ in stays([tuple(r) for r in docs.collect()]))
    assert N.without_similar(none).collect() == []


def test_odd_rows(odd):
    got = N.without_similar(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == sorted(r for r in stays([(r.doc_id, r.text) for r in odd.collect()]) if r[0])


def test_repeated_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "ab"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (None, texts[1]), (1, texts[0])]
    got = N.without_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, texts[0]), (5, texts[1])]


def test_the_stage(spark, sf):
    """No two documents that are alike are left."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = [r.text for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).select("text").collect()]
    assert clusters(left) == list(range(len(left)))
