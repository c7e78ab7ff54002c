import re

import numpy as np
import pyarrow as pa
import xxhash

import evalloom.llm.simhash as S
from evalloom.llm.common import flat
from evalloom.llm.components import connected, labels
from evalloom.llm.simhash import Tree, fingerprint_links, fingerprints, linked, near_copies, without_near_copies


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(x, radius=2):
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    return labels(len(x), *np.nonzero(near))


def planted(n, near, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for k in range(near):
        x[n - 1 - k] = x[rng.integers(0, n - 1 - k)] ^ np.uint64((1 << int(rng.integers(64))) | (1 << int(rng.integers(64))))
    return np.unique(x)


def test_fingerprints(sample, odd):
    texts = [r.text for r in sample.limit(40).collect()] + [r.text for r in odd.where("length(text) < 5000 or text is null").collect()]
    assert fingerprints(*flat(pa.array(texts))).tolist() == [plain(t) for t in texts]


def test_groups_within_and_over_shards():
    for n, near in ((1, 0), (2, 1), (400, 100), (1500, 1400)):
        x = planted(n, near, n)
        want = groups(x)
        assert (linked(x, leaf=16) == want).all()
        tree = Tree(x[::2], 6)
        rows, leaf = tree.dealt(x)
        pairs = [(rows_[a], rows_[b]) for k in range(tree.leaves) for rows_ in [np.sort(rows[leaf == k])] for a, b in enumerate(linked(x[rows_])) if a != b]
        a, b = np.array(pairs, int).reshape(-1, 2).T
        assert (labels(len(x), a, b) == want).all()


def test_dense_ball():
    center = np.uint64(0x0123456789ABCDEF)
    x = np.unique(np.array([center ^ np.uint64((1 << a) | (1 << b)) for a in range(64) for b in range(64)], np.uint64))
    assert (linked(x, leaf=64) == 0).all()


def test_dense_sets_by_changed_bits():
    rng = np.random.default_rng(3)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 10, 300, dtype=np.uint64) << np.uint64(s) for s in (0, 20, 40)]))
    assert (S._dense_links(x, 2) == groups(x)).all() and (S._dense_links(x, 1) == groups(x, 1)).all()


def test_repeated_ids(spark):
    """A row that is nobody's copy stays, though its id is that of a copy."""
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "e f g h"), (5, "e f g h")]
    assert sorted(map(tuple, without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, "a b c d"), (5, "e f g h")]


def test_long_text():
    text = " ".join(f"w{k % 977}" for k in range(5000))
    want = plain(text)
    S_at, S.AT_ONCE = S.AT_ONCE, 700
    try:
        assert fingerprints(*flat(pa.array(["x y", text, "", text + " z"]))).tolist() == [plain("x y"), want, 0, plain(text + " z")]
    finally:
        S.AT_ONCE = S_at


def test_links_on_the_cluster(spark):
    x = planted(900, 300, 5)
    distinct = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in connected(fingerprint_links(distinct, shard=100)).collect()}
    signed, want = x.view(np.int64), groups(x)
    least = {k: min(signed[want == k].tolist()) for k in set(want.tolist())}
    assert all(roots.get(int(v), int(v)) == least[k] for v, k in zip(signed, want.tolist(), strict=True))


def test_components_of_a_path(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected(rows).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert connected(rows.where("a = -1")).collect() == []


def test_rows(odd, none):
    rows = [(r.doc_id, plain(r.text) if len(r.text or "") < 5000 else None) for r in odd.collect()]
    got = near_copies(odd).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got if r.doc_id not in (7, 10)) == sorted((str(i), f"{f:016x}") for i, f in rows if i not in (7, 10))
    of = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {v for (i, f), v in of.items() if f == "0" * 16} == {3} and of[2, f"{plain(odd.where('doc_id = 2').first().text):016x}"] == 1
    stay = without_near_copies(odd)
    ids = [r.doc_id for r in stay.collect()]
    assert stay.columns == odd.columns and set(ids) >= {1, 3, 7, None} and not {2, 4, 5} & set(ids) and len(ids) == len({r.component_id for r in got if r.component_id is not None}) + 1
    assert near_copies(none).collect() == []
