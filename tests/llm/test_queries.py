"""Each query runs, with a row per document where it says so; those with SQL match it."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from evalloom.llm import queries

TABLES = "documents pages labels".split()


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, db, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = db.sql(queries.ORACLES[name]).df()[list(got.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


COLUMNS = {
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_sentencepiece": "doc_id n_ids ids_crc32 ids_sha256 round_trip",
    "op6_matroska": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_toxicity": "doc_id held_out score predicted",
    "op9_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_katz": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_without_sql(spark, sf, texts, name):
    """The query itself, over the whole table, against plain values where these are short to say."""
    df = queries.QUERIES[name](spark, sf)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name == "op2_packing":
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer, found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
        for r in rows:
            found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        for i, t in texts.items():
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
            at = 0
            for start, n, crc, total in sorted(found[i]):
                assert (start, crc, total) == (at, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
                at += n
            assert at == len(ids)
        return
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        if name == "op6_matroska":
            data += b"\xff" * (-len(data) % 576 or 576 * (not data))
            assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        elif name == "op4_sentencepiece":
            assert r.round_trip
        elif name == "op9_suffix_dedup":
            assert r.n_bytes == len(data) and (r.n_removed > 0) == (r.n_spans > 0) and (r.n_removed > 0 or r.kept_sha256 == hashlib.sha256(data).hexdigest())
        elif name == "op10_katz":
            assert r.n_tokens == len(data.split()) + 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
