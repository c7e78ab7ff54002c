"""Every registered query gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest

from evalloom.plans import all_queries


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return found


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, float):
        return f"{value + 0.0:.8g}".replace("-0", "0") if abs(value) < 1e-9 else f"{value:.8g}"
    return str(list(value)) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, sf, db, name):
    df = all_queries.QUERIES[name](spark, sf)
    got = sorted([plain(r[c]) for c in sorted(df.columns)] for r in df.collect())
    if name not in all_queries.ORACLES:
        assert got
        return
    answer = db.sql(all_queries.ORACLES[name])
    assert sorted(answer.columns) == sorted(df.columns)
    order = [answer.columns.index(c) for c in sorted(df.columns)]
    assert got == sorted([plain(r[i]) for i in order] for r in answer.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
