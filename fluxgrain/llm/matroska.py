"""Matroska containers as media columns: EBML parsing to packet tables, and a PCM writer.

``parse`` walks the variable-length EBML elements of a whole file: segment, track entries,
clusters, simple blocks and block groups with every lacing mode, and cues.  Each frame becomes
one packet with its track, timestamp, byte range in the file and cluster.  ``packet_table``
applies it to a binary column.  ``mux_pcm8`` stores bytes losslessly as 8-bit PCM samples.

Defined edge cases: a null or malformed file has no packets and ``ok`` false (packets found
before the damage are dropped, as their file cannot be trusted); elements of unknown size end
at the next element of their own or a higher level; void, CRC and unknown elements are skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, utf8_values

# Element IDs of the public EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE
CLUSTER, CUES, CUE_POINT, CUE_POSITIONS = 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7
BLOCK_GROUP, BLOCK, SIMPLE_BLOCK, TIMESTAMP, REFERENCE = 0xA0, 0xA1, 0xA3, 0xE7, 0xFB
TIMESTAMP_SCALE, DURATION, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0x23E383
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")
_LEVEL1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class Malformed(ValueError):
    """The bytes are not a readable Matroska file."""


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    cluster: int
    lacing: int
    keyframe: bool


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster offset
    clusters: list[int] = field(default_factory=list)


def read_vint(buf, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and the place after it; None for the reserved unknown size."""
    if at >= len(buf) or not buf[at]:
        raise Malformed(f"no variable-length integer at {at}")
    n = 9 - buf[at].bit_length()
    end = at + n
    if end > len(buf):
        raise Malformed(f"integer at {at} runs over the end")
    value = int.from_bytes(buf[at:end], "big")
    if keep_marker:
        return value, end
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), end


def write_vint(value: int, width: int = 0) -> bytes:
    n = width or 1
    while not width and value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_vint(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _children(buf, at: int, end: int, stops: frozenset | set = frozenset()):
    """(id, body start, body end) of each element; of unknown size if the end is None."""
    while at < end:
        ident, p = read_vint(buf, at, keep_marker=True)
        size, p = read_vint(buf, p)
        if ident in stops:
            return
        if size is not None and p + size > end:
            raise Malformed(f"element {ident:#x} at {at} runs over its parent")
        if size is None:
            last = _unknown_end(buf, ident, p, end)
        else:
            last = p + size
        yield ident, p, last
        at = last


def _unknown_end(buf, ident: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: before the next one of its level or above."""
    if ident == SEGMENT:
        return end
    while at < end:
        child, p = read_vint(buf, at, keep_marker=True)
        if child in _LEVEL1 or child in (SEGMENT, EBML):
            return at
        size, p = read_vint(buf, p)
        if size is None or p + size > end:
            raise Malformed(f"element {child:#x} at {at} has no end")
        at = p + size
    return end


def lace_sizes(buf, at: int, end: int, mode: int) -> tuple[list[int], int]:
    """The frame sizes of a block's lace and where its first frame begins."""
    if mode == 0:
        return [end - at], at
    if at >= end:
        raise Malformed("a laced block without a frame count")
    n, at = buf[at] + 1, at + 1
    if mode == 2:
        if (end - at) % n:
            raise Malformed("fixed lacing of unequal frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if mode == 1:
            size = 0
            while True:
                if at >= end:
                    raise Malformed("Xiph lacing runs over its block")
                b, at = buf[at], at + 1
                size += b
                if b != 255:
                    break
        else:
            start = at
            value, at = read_vint(buf, at)
            if value is None:
                raise Malformed("EBML lacing with a reserved size")
            size = value if not k else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("a lace is larger than its block")
    return sizes, at


def _block(media: Media, buf, at: int, end: int, base: int, key: bool | None) -> None:
    track, at = read_vint(buf, at)
    if track is None or at + 3 > end:
        raise Malformed("a block without its head")
    relative, flags = struct.unpack(">hB", buf[at : at + 3])
    mode = flags >> 1 & 3
    sizes, place = lace_sizes(buf, at + 3, end, mode)
    when = (base + relative) * media.scale
    step = media.tracks.get(track, {}).get("default_duration", 0)
    keyframe = bool(flags & 0x80) if key is None else key
    cluster = len(media.clusters) - 1
    for k, size in enumerate(sizes):
        media.packets.append(Packet(track, when + k * step, place, size, cluster, mode, keyframe))
        place += size


def _number(buf, at: int, end: int) -> int:
    return int.from_bytes(buf[at:end], "big")


def _float(buf, at: int, end: int) -> float:
    return {0: lambda b: 0.0, 4: lambda b: struct.unpack(">f", b)[0], 8: lambda b: struct.unpack(">d", b)[0]}[end - at](bytes(buf[at:end]))


def _track(media: Media, buf, at: int, end: int) -> None:
    t: dict = {"default_duration": 0}
    for ident, a, z in _children(buf, at, end):
        if ident == TRACK_NUMBER:
            t["number"] = _number(buf, a, z)
        elif ident == TRACK_TYPE:
            t["type"] = _number(buf, a, z)
        elif ident == CODEC_ID:
            t["codec"] = bytes(buf[a:z]).decode("ascii", "replace")
        elif ident == DEFAULT_DURATION:
            t["default_duration"] = _number(buf, a, z)
        elif ident == AUDIO:
            for sub, b, y in _children(buf, a, z):
                if sub == SAMPLING_FREQUENCY:
                    t["rate"] = _float(buf, b, y)
                elif sub == CHANNELS:
                    t["channels"] = _number(buf, b, y)
                elif sub == BIT_DEPTH:
                    t["bits"] = _number(buf, b, y)
    media.tracks[t.get("number", 0)] = t


def parse(buf: bytes) -> Media:
    """Tracks, packets, clusters and cues of a Matroska file."""
    media, seen = Media(), False
    for top, s, e in _children(buf, 0, len(buf)):
        if top == EBML:
            seen = True
        if top != SEGMENT:
            continue
        for ident, a, z in _children(buf, s, e):
            if ident == INFO:
                for sub, b, y in _children(buf, a, z):
                    if sub == TIMESTAMP_SCALE:
                        media.scale = _number(buf, b, y)
            elif ident == TRACKS:
                for sub, b, y in _children(buf, a, z):
                    if sub == TRACK_ENTRY:
                        _track(media, buf, b, y)
            elif ident == CLUSTER:
                media.clusters.append(a)
                base = 0
                for sub, b, y in _children(buf, a, z):
                    if sub == TIMESTAMP:
                        base = _number(buf, b, y)
                    elif sub == SIMPLE_BLOCK:
                        _block(media, buf, b, y, base, None)
                    elif sub == BLOCK_GROUP:
                        parts = list(_children(buf, b, y))
                        key = all(i != REFERENCE for i, _, _ in parts)
                        for i, c, x in parts:
                            if i == BLOCK:
                                _block(media, buf, c, x, base, key)
            elif ident == CUES:
                for sub, b, y in _children(buf, a, z):
                    if sub == CUE_POINT:
                        _cue(media, buf, b, y, s)
    if not seen:
        raise Malformed("no EBML head")
    return media


def _cue(media: Media, buf, at: int, end: int, segment: int) -> None:
    when = 0
    for ident, a, z in _children(buf, at, end):
        if ident == CUE_TIME:
            when = _number(buf, a, z)
        elif ident == CUE_POSITIONS:
            track = place = 0
            for sub, b, y in _children(buf, a, z):
                if sub == CUE_TRACK:
                    track = _number(buf, b, y)
                elif sub == CUE_CLUSTER:
                    place = segment + _number(buf, b, y)
            media.cues.append((when * media.scale, track, place))


#: Of the writer: samples a second, of a frame, frames of a block, blocks of a cluster.
RATE, FRAME, FRAMES, BLOCKS = 8_000, 512, 8, 8
_HEAD = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_TRACKS = _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT")
        + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def _lace(frames: list[bytes], mode: int) -> bytes:
    sizes = [len(f) for f in frames]
    if mode == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if mode == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif mode == 3:
        head += write_vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            n = 1
            while not -(1 << 7 * n - 1) < b - a < (1 << 7 * n - 1):
                n += 1
            head += write_vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def mux_pcm8(payload: bytes) -> bytes:
    """A Matroska file with one mono track of 8-bit PCM whose frames hold the payload.

    Blocks take the lacing modes in turn; fixed lacing is used where all frames are equal.
    """
    clusters, cues, place = [], [], 0
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    start = len(info) + len(_TRACKS)
    span = FRAME * FRAMES * BLOCKS
    for c in range(0, len(payload), span):
        when = c * 1000 // RATE
        body = [_uint(TIMESTAMP, when)]
        for k, b in enumerate(range(c, min(c + span, len(payload)), FRAME * FRAMES)):
            frames = [payload[p : p + FRAME] for p in range(b, min(b + FRAME * FRAMES, len(payload)), FRAME)]
            mode = 0 if len(frames) == 1 else (1, 2, 3)[k % 3]
            if mode == 2 and len(frames[-1]) != len(frames[0]):
                mode = 3
            body.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - when, 0x80 | mode << 1) + _lace(frames, mode)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, when) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, start + place))))
        clusters.append(_element(CLUSTER, b"".join(body)))
        place += len(clusters[-1])
    return _HEAD + _element(SEGMENT, b"".join([info, _TRACKS, *clusters, _element(CUES, b"".join(cues))]))


def demux(buf: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track, joined."""
    return b"".join([buf[p.offset : p.offset + p.size] for p in media.packets if p.track == track])


def features(media: Media, payload: bytes) -> str:
    """What the packet table and the samples say, as one string of integers."""
    laced = [sum(p.lacing == k for p in media.packets) for k in range(4)]
    samples = np.frombuffer(payload, np.uint8)
    last = media.packets[-1] if media.packets else None
    parts = {
        "tracks": len(media.tracks), "clusters": len(media.clusters), "cues": len(media.cues), "packets": len(media.packets),
        **{LACING[k]: laced[k] for k in range(4)},
        "last_ms": last.timestamp_ns // 1_000_000 if last else 0, "first_byte": media.packets[0].offset if last else 0, "end_byte": last.offset + last.size if last else 0,
        "sum": int(samples.sum(dtype=np.int64)), "peak": int(samples.max(initial=0)), "zeros": int((samples == 0).sum()),
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


PACKETS = "track long, timestamp_ns long, byte_offset long, byte_size long, cluster long, lacing string, keyframe boolean"


def packet_table(files: DataFrame, id_column: str, data_column: str) -> DataFrame:
    """One row per packet of each file of a binary column, with its file's id.

    Null, empty and malformed files have no rows.  Repeated rows give repeated packets.
    """
    prepare(files.sparkSession)
    chosen = files.select(files[id_column].alias("id"), files[data_column].alias("data"))

    def explode(batches):
        for batch in batches:
            rows: list[tuple] = []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = parse(data or b"").packets
                except Malformed:
                    continue
                rows += [(ident, p.track, p.timestamp_ns, p.offset, p.size, p.cluster, LACING[p.lacing], p.keyframe) for p in found]
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.bool_()))], names)

    kind = chosen.schema["id"].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in PACKETS.split(", "))]
    return chosen.mapInArrow(explode, f"id {kind}, {PACKETS}").withColumnRenamed("id", id_column)


ROUND_TRIP = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _round_trip(batches):
    names = [x.split()[0] for x in ROUND_TRIP.split(", ")]
    for batch in batches:
        rows = []
        for ident, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1))):
            stored = mux_pcm8(text + bytes(max(64, -(-len(text) // 64) * 64) - len(text)))
            media = parse(stored)
            back = demux(stored, media)
            rows.append((ident, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, back)))
        columns = list(zip(*rows)) or [[]] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names)


def text_round_trip(docs: DataFrame) -> DataFrame:
    """Store every whole text as the samples of a Matroska file, parse it and digest both.

    Text null counts as empty; its payload is 64 zero bytes.  A row of its own for every row,
    repeated or not; a null doc_id stays null.  Narrow: no shuffle, one text in memory at a time.
    """
    prepare(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_round_trip, ROUND_TRIP)
