import hashlib
import zlib

import pytest

from evalloom.llm import matroska as M


def test_round_trip(odd):
    rows = {(r.doc_id, (r.text or "").encode()) for r in odd.collect()}
    got = M.digested(M.stored(odd)).collect()
    assert len(got) == odd.count()
    want = set()
    for i, t in rows:
        payload = t + b"\xff" * ((-len(t)) % 576 if t else 576)
        want.add((i, len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want


@pytest.mark.parametrize("frames", [1, 2, 8, 9, 256, 257, 700])
def test_packets(frames):
    payload = bytes(range(256)) * (frames * 576 // 256) + bytes(frames * 576 % 256)
    media = M.parse(M.mux(payload))
    assert M.samples(M.mux(payload), media) == payload and len(media.packets) == frames and not media.truncated
    assert [t for _, t, *_ in media.packets] == [72_000_000 * k for k in range(frames)]
    assert media.clusters == len(media.cues) == -(-frames // 256)
    data = M.mux(payload)
    assert all(data[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in media.cues)


def test_all_lacings():
    head = b"\x81\x00\x05"
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]
    xiph = head + b"\x02\x02" + bytes([255, 45, 10]) + b"".join(frames)
    ebml = head + b"\x06\x02" + b"\x41\x2c" + (10 - 300 + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") + b"".join(frames)
    none = head + b"\x80" + b"d" * 5
    body = M.element(M.TIMESTAMP, b"\x0a") + M.element(M.SIMPLE_BLOCK, xiph) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, ebml) + M.element(M.REFERENCE_BLOCK, b"\x01")) + M.element(0xEC, b"void") + M.element(M.SIMPLE_BLOCK, none)
    unknown = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7  # a cluster of unknown size
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + M.element(M.SEGMENT, unknown + body + M.element(M.CLUSTER, body))
    media = M.parse(data)
    got = [(data[a : a + n], t, key) for _, t, key, a, n in media.packets]
    assert got == [(f, 15_000_000, False) for f in frames + frames] + [(b"ddddd", 15_000_000, True)] + [(f, 15_000_000, False) for f in frames + frames] + [(b"ddddd", 15_000_000, True)]
    assert media.clusters == 2 and media.doc_type == "webm"


def test_bad_files(spark):
    whole = M.mux(b"x" * 5760)
    cut = M.parse(whole[:-800])
    assert cut.truncated
    for bad in (b"", b"RIFF1234", whole[:3]):
        with pytest.raises(ValueError):
            M.parse(bad)
    rows = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    got = M.packet_table(rows).collect()
    assert sum(r.doc_id == 1 for r in got) == 10 and [r.error is not None for r in got if r.doc_id == 2] == [True] and not any(r.doc_id == 3 for r in got)


def test_empty(none):
    assert M.digested(M.stored(none)).collect() == []


def test_digests_of_what_is_no_file(spark, odd):
    rows = spark.createDataFrame([(1, 3, bytearray(b"junk")), (1, 3, None), (None, 0, bytearray(M.mux(M.padded(b""))))], "doc_id long, n_bytes long, media binary")
    got = sorted(map(tuple, M.digested(rows).collect()), key=str)
    assert [r[:4] for r in got[:2]] == [(1, 3, None, None)] * 2 and got[2][2] == 576
    assert M.digested(M.stored(odd)).count() == odd.count()
