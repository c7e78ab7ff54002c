"""Matroska media columns: bytes in, packet tables out.

`parse` reads EBML elements of any size length, clusters, simple and grouped blocks with all four kinds of lacing, and
cues, into a packet table: track, timestamp, key flag and byte range of each frame. `mux` writes 8-bit PCM audio as a
file of laced blocks with cues. Files are handled row by row in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import flat, pieces, releasing, table

# Element ids, fixed by the format (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

#: Samples of a frame, samples a second, frames of a block, blocks of a cluster.
FRAME, RATE, LACE, BLOCKS = 576, 8000, 8, 32
FRAME_MS = FRAME * 1000 // RATE
#: Bytes of texts, unless one is longer, made into files at once.
AT_ONCE = 4_000_000


def _id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(MAX_ID_LENGTH, 4) + _uint(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_INFO_AND_TRACKS = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"evalloom") + element(WRITING_APP, b"evalloom")) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f4").tobytes()) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of 8-bit mono PCM; the payload's length is a multiple of FRAME. Equal payloads give equal files."""
    body, cues, at = [_INFO_AND_TRACKS], [], len(_INFO_AND_TRACKS)
    per_block, per_cluster = FRAME * LACE, FRAME * LACE * BLOCKS
    for begin in range(0, len(payload), per_cluster):
        ms = begin // FRAME * FRAME_MS
        parts = [_uint(TIMESTAMP, ms)]
        for start in range(begin, min(begin + per_cluster, len(payload)), per_block):
            frames = payload[start : min(start + per_block, begin + per_cluster)]
            n, relative = len(frames) // FRAME, (start - begin) // FRAME * FRAME_MS
            laced = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"  # key frames; lacing of equal sizes
            parts.append(element(SIMPLE_BLOCK, b"\x81" + relative.to_bytes(2, "big", signed=True) + laced + frames))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, ms) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, key frame, first byte, bytes) of each frame
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    #: (time in ns, track, first byte of the cluster in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    blocks: int = 0
    #: whether the file ends within an element
    truncated: bool = False


def vint(data: bytes, at: int, end: int, marked: bool = False) -> tuple[int, int, bool]:
    """A variable-length integer: its value (with the length marker if marked), the place after it, whether all its bits are 1."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise ValueError(f"an integer at byte {at} ends after byte {end}")
    value, low = int.from_bytes(data[at : at + length], "big"), (1 << 7 * length) - 1
    return (value if marked else value & low), at + length, value & low == low


def elements(data: bytes, at: int, end: int):
    """(id, first byte of the element, of its body, end of its body, whether its size is unknown)."""
    while at < end:
        kind, body, _ = vint(data, at, end, marked=True)
        n, body, unknown = vint(data, body, end)
        stop = end if unknown else body + n
        yield kind, at, body, min(stop, end), unknown, stop > end
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return float(np.frombuffer(data[a:b], ">f4" if b - a == 4 else ">f8")[0]) if b - a in (4, 8) else 0.0


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and where the first begins. kind: the two lacing bits (0 none, 1 Xiph, 2 equal, 3 EBML)."""
    if kind == 0:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError("frames of equal size don't fill their block")
        return [(end - at) // n] * n, at
    sizes = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            before = at
            value, at, _ = vint(data, at, end)
            sizes.append(sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1) if k else value)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced frames are larger than their block")
    return [*sizes, last], at


def _block(media: Media, data: bytes, a: int, b: int, cluster_time: int, key: bool | None) -> None:
    track, at, _ = vint(data, a, b)
    if at + 3 > b:
        raise ValueError("a block without a head")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    sizes, start = lace_sizes(data, at + 3, b, flags >> 1 & 3)
    base, step = (cluster_time + relative) * media.scale, media.tracks.get(track, {}).get("default_duration", 0)
    for k, size in enumerate(sizes):
        media.packets.append((track, base + k * step, bool(flags & 0x80) if key is None else key, start, size))
        start += size
    media.blocks += 1


def _cluster(media: Media, data: bytes, a: int, b: int, unknown: bool) -> int:
    """Where it ends; one of unknown size ends at the next element of the segment's level."""
    time = 0
    media.clusters += 1
    for kind, at, body, stop, _, cut in elements(data, a, b):
        if unknown and kind in TOP_LEVEL:
            return at
        if cut:
            media.truncated = True
            return b
        if kind == TIMESTAMP:
            time = _number(data, body, stop)
        elif kind == SIMPLE_BLOCK:
            _block(media, data, body, stop, time, None)
        elif kind == BLOCK_GROUP:
            inner = [(k, x, y) for k, _, x, y, _, _ in elements(data, body, stop)]
            key = all(k != REFERENCE_BLOCK for k, _, _ in inner)
            for k, x, y in inner:
                if k == BLOCK:
                    _block(media, data, x, y, time, key)
    return b


def _track(media: Media, data: bytes, a: int, b: int) -> None:
    track: dict = {}
    for kind, _, body, stop, _, _ in elements(data, a, b):
        if kind == TRACK_NUMBER:
            track["number"] = _number(data, body, stop)
        elif kind == TRACK_TYPE:
            track["type"] = _number(data, body, stop)
        elif kind == CODEC_ID:
            track["codec"] = data[body:stop].decode("ascii", "replace")
        elif kind == DEFAULT_DURATION:
            track["default_duration"] = _number(data, body, stop)
        elif kind == AUDIO:
            for k, _, x, y, _, _ in elements(data, body, stop):
                if k == SAMPLING_FREQUENCY:
                    track["rate"] = _float(data, x, y)
                elif k in (CHANNELS, BIT_DEPTH):
                    track["channels" if k == CHANNELS else "bits"] = _number(data, x, y)
    media.tracks[track.get("number", 0)] = track


def _cues(media: Media, data: bytes, a: int, b: int, origin: int) -> None:
    for kind, _, body, stop, _, _ in elements(data, a, b):
        if kind != CUE_POINT:
            continue
        time, places = 0, []
        for k, _, x, y, _, _ in elements(data, body, stop):
            if k == CUE_TIME:
                time = _number(data, x, y)
            elif k == CUE_TRACK_POSITIONS:
                inner = {i: _number(data, p, q) for i, _, p, q, _, _ in elements(data, x, y)}
                places.append((inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER_POSITION, 0)))
        media.cues += [(time * media.scale, track, origin + place) for track, place in places]


def parse(data: bytes) -> Media:
    """Reads a whole file. A cut file gives what comes before the cut, and truncated; bytes that are no Matroska raise ValueError."""
    media, segments = Media(), 0
    for kind, _, body, stop, _, cut in elements(data, 0, len(data)):
        if kind == EBML:
            for k, _, x, y, _, _ in elements(data, body, stop):
                if k == DOC_TYPE:
                    media.doc_type = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif kind == SEGMENT:
            segments += 1
            media.truncated |= cut
            at = body
            while at < stop:
                try:
                    k, _, x, y, unknown, inner_cut = next(elements(data, at, stop))
                except ValueError:
                    if not media.truncated:
                        raise
                    break
                media.truncated |= inner_cut
                at = y
                if k == INFO:
                    for i, _, p, q, _, _ in elements(data, x, y):
                        if i == TIMESTAMP_SCALE:
                            media.scale = _number(data, p, q)
                elif k == TRACKS:
                    for i, _, p, q, _, _ in elements(data, x, y):
                        if i == TRACK_ENTRY:
                            _track(media, data, p, q)
                elif k == CLUSTER:
                    at = _cluster(media, data, x, y, unknown)
                elif k == CUES:
                    _cues(media, data, x, y, body)
    if not media.doc_type or not segments:
        raise ValueError("no EBML head and segment")
    return media


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[a : a + n] for t, _, _, a, n in media.packets if t == track)


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (FRAME - len(text) if len(text) < FRAME else -len(text) % FRAME)


def feature(media: Media, payload: bytes) -> str:
    """Of the packets and samples: counts, duration, mean and energy per sample in thousandths, zero crossings and the largest step."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    end = max((t for _, t, _, _, _ in media.packets), default=0) // 1_000_000 + (FRAME_MS if media.packets else 0)
    seek = sum(any(a < p for _, _, _, p, _ in media.packets[:1]) for _, _, a in media.cues[:1])
    crossings, step = int(((x[1:] < 0) != (x[:-1] < 0)).sum()), int(np.abs(np.diff(x)).max(initial=0))
    return f"packets={len(media.packets)};blocks={media.blocks};clusters={media.clusters};cues={len(media.cues)};seekable={seek};ms={end};mean={int(x.sum()) * 1000 // n};energy={int((x * x).sum()) * 1000 // n};crossings={crossings};step={step}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty) as UTF-8, padded with bytes 255 to a positive multiple of FRAME, as a Matroska file.

    Null and repeated ids are kept; a text may have any length that a binary value can have, and is worked on with few
    others. Other columns are not read. An empty table gives an empty result.
    """

    def rows(batches):
        for b in batches:
            data, offsets = flat(b.column(1))
            for at, to in pieces(offsets, AT_ONCE):
                texts = [data[a:z].tobytes() for a, z in zip(offsets[at:to].tolist(), offsets[at + 1 : to + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(releasing(rows), "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: doc_id, track, timestamp_ns, key, start, size, error. Null media has no row; bytes that are no Matroska give one row with the error."""

    def rows(batches):
        for b in batches:
            out = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if data.is_valid:
                    try:
                        out += [(doc, *p, None) for p in parse(data.as_buffer().to_pybytes()).packets]
                    except (ValueError, IndexError) as e:
                        out.append((doc, None, None, None, None, None, str(e)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)

    names = ["doc_id", "track", "timestamp_ns", "key", "start", "size", "error"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()], strict=True)))
    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(rows, "doc_id long, track long, timestamp_ns long, key boolean, start long, size long, error string")


def digested(media: DataFrame, id_col: str = "doc_id", n_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """Reads the stored files back: payload and file digests and the feature, one row per row. Null media, and bytes that are no Matroska, have null digests."""

    def rows(batches):
        for b in batches:
            out = []
            for doc, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    data = data.as_buffer().to_pybytes() if data.is_valid else b""
                    found = parse(data)
                except (ValueError, IndexError):
                    out.append((doc, n, *[None] * 6))
                    continue
                payload = samples(data, found)
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, payload)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return media.select(F.col(id_col).cast("long"), F.col(n_col).cast("long"), F.col(media_col)).mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_matroska(spark, sf_dir):
    return digested(stored(table(spark, sf_dir, "documents")))
