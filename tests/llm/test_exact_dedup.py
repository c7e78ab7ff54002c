import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalloom.llm.exact_dedup import content_sort_dedup, without_copies


def normal(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_against_groups(odd, partitions):
    rows, groups = odd.select("doc_id", "text").collect(), defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    got = content_sort_dedup(odd, partitions=partitions).collect()
    assert len(got) == len(rows)
    keep = {hashlib.sha256(t).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_copies_over_many_partitions(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(600)], "doc_id long, text string")
    got = {r.doc_id: r for r in content_sort_dedup(rows, partitions=16).collect()}
    assert len(got) == 600 and {got[i].keep_id for i in got if i % 3} == {599} and {got[i].group_size for i in got if i % 3} == {400}
    assert sum(r.kept for r in got.values()) == 201


def test_empty(none):
    assert content_sort_dedup(none).collect() == [] and without_copies(none).collect() == []


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_rows_that_stay(odd, partitions):
    got = without_copies(odd, partitions=partitions)
    assert got.columns == odd.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([2, 4, 5, None, 7, 8, 9, 10, 11, 12], key=str)
    for r in got.collect():  # the row of the largest id, whole
        assert r.asDict() in [x.asDict() for x in odd.where(F.col("doc_id").eqNullSafe(r.doc_id)).collect()]


@pytest.mark.parametrize("partitions", [1, 16])
def test_rows_of_copies_over_partitions(spark, partitions):
    rows = [(i, "Hot" if i % 3 else f"t{i % 30}", i, "a", "b", 1, 2, 3, "c", 4) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key long, __n string, edge string, id int, prefix int, sha int, part string, c0 int").repartition(7)
    want = {}
    for i, t, *_ in rows:
        want[t] = max(i, want.get(t, -1))
    got = without_copies(docs, partitions=partitions)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r["__key"]) for r in got.collect()) == sorted((i, t, i) for t, i in want.items())
