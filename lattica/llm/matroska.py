"""Matroska: a muxer for 8-bit samples, and a parser that makes packet tables of any Matroska bytes.

The parser reads variable-length EBML elements (known and unknown sizes),
tracks, clusters, simple blocks and block groups, all three kinds of lacing,
and cues; a packet is a byte range with its track and timestamp.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, utf8
from .worker import task

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469

#: Elements of the segment: one of them ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")
FRAME = 576
RATE = 8000


# Writing


def size_bytes(n: int, width: int = 0) -> bytes:
    """An EBML size; width 0: the shortest."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(key: int, value: float) -> bytes:
    return element(key, struct.pack(">d", value))


def block_body(track: int, relative: int, frames: list[bytes], lacing: str = "fixed", keyframe: bool = True, simple: bool = True) -> bytes:
    """The body of a (simple) block of one or more frames."""
    lacing = "none" if len(frames) == 1 else lacing
    flags = LACINGS.index(lacing) << 1 | (0x80 if simple and keyframe else 0)
    head = size_bytes(track) + struct.pack(">hB", relative, flags)
    if lacing == "none":
        if len(frames) != 1:
            raise ValueError("several frames need lacing")
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs frames of equal size")
    elif lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    else:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE, frames_per_block: int = 16, blocks_per_cluster: int = 16, lacing: str = "fixed") -> bytes:
    """payload as one track of unsigned 8-bit samples; its length must be a multiple of `frame`."""
    if len(payload) % frame:
        raise ValueError("the payload must be whole frames")
    total = len(payload) // frame
    ms = lambda i: i * frame * 1000 // rate
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, total * frame * 1000 / rate) + element(MUXING_APP, b"lattica") + element(WRITING_APP, b"lattica"))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    step = frames_per_block * blocks_per_cluster
    for first in range(0, total, step):
        start, blocks = ms(first), []
        for i in range(first, min(first + step, total), frames_per_block):
            frames = [payload[j * frame : (j + 1) * frame] for j in range(i, min(i + frames_per_block, first + step, total))]
            blocks.append(element(SIMPLE_BLOCK, block_body(1, ms(i) - start, frames, lacing)))
        cluster = element(CLUSTER, uint(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# Reading


@dataclass
class Movie:
    """What parse() finds. packets: (track, timestamp ns, duration ns or -1, keyframe, offset, size, cluster)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, bool, int, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # (position, timestamp in scale units)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (time, track, position of a cluster)


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, position after it, whether all value bits are 1)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the data end inside a number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & ((1 << 7 * width) - 1)
    return value if keep_marker else bare, at + width, bare == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int, unknown_until: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, position, start and end of the body) of the elements in a range.

    An element of unknown size ends where the first of `unknown_until` starts, else with its parent.
    """
    while at < end:
        position = at
        key, at, _ = vint(data, at, True)
        size, at, unknown = vint(data, at)
        if unknown:
            stop = at
            while stop < end:
                k, body, _ = vint(data, stop, True)
                if k in unknown_until:
                    break
                n, body, open_ = vint(data, body)
                stop = end if open_ else body + n
            stop = min(stop, end)
        else:
            stop = at + size
            if stop > end:
                raise ValueError(f"the element at byte {position} ends beyond its parent")
        yield key, position, at, stop
        at = stop


def _uint(data: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(data[lo:hi], "big")


def _real(data: bytes, lo: int, hi: int) -> float:
    return 0.0 if hi == lo else struct.unpack(">f" if hi - lo == 4 else ">d", data[lo:hi])[0]


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, byte ranges of the frames) of a block's body."""
    track, at, _ = vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = LACINGS[flags >> 1 & 3]
    if kind == "none":
        return track, relative, flags, [(at, end)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == "fixed":
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide its block")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if kind == "xiph":
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            else:
                start = at
                n, at, _ = vint(data, at)
                if i:
                    n += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("lacing sizes exceed their block")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return track, relative, flags, out


def parse(data: bytes) -> Movie:
    """Raises ValueError where the bytes aren't well-formed."""
    movie, base = Movie(), 0
    for key, _, lo, hi in elements(data, 0, len(data)):
        if key == EBML:
            movie.doc_type = next((data[a:b].rstrip(b"\0").decode() for k, _, a, b in elements(data, lo, hi) if k == DOC_TYPE), "matroska")
        elif key == SEGMENT:
            base = lo
            for k, position, a, b in elements(data, lo, hi, TOP):
                if k == INFO:
                    for x, _, c, d in elements(data, a, b):
                        if x == TIMESTAMP_SCALE:
                            movie.scale = _uint(data, c, d)
                        elif x == DURATION:
                            movie.duration = _real(data, c, d)
                elif k == TRACKS:
                    for x, _, c, d in elements(data, a, b):
                        if x == TRACK_ENTRY:
                            _track(movie, data, c, d)
                elif k == CLUSTER:
                    _cluster(movie, data, position - base, a, b)
                elif k == CUES:
                    _cues(movie, data, a, b)
    return movie


def _track(movie: Movie, data: bytes, lo: int, hi: int) -> None:
    found = {"number": 0, "type": 0, "codec": "", "default_duration": 0, "rate": 0.0, "channels": 1, "bits": 0}
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}
    for key, _, a, b in elements(data, lo, hi):
        if key in names:
            found[names[key]] = _uint(data, a, b)
        elif key == CODEC_ID:
            found["codec"] = data[a:b].rstrip(b"\0").decode()
        elif key == AUDIO:
            for k, _, c, d in elements(data, a, b):
                if k == SAMPLING_FREQUENCY:
                    found["rate"] = _real(data, c, d)
                elif k in (CHANNELS, BIT_DEPTH):
                    found["channels" if k == CHANNELS else "bits"] = _uint(data, c, d)
    movie.tracks[found["number"]] = found


def _cluster(movie: Movie, data: bytes, position: int, lo: int, hi: int) -> None:
    start, number = 0, len(movie.clusters)
    movie.clusters.append((position, 0))
    for key, _, a, b in elements(data, lo, hi):
        if key == TIMESTAMP:
            start = _uint(data, a, b)
            movie.clusters[number] = (position, start)
        elif key in (SIMPLE_BLOCK, BLOCK_GROUP):
            body, duration, keyframe = (a, b), -1, True
            if key == BLOCK_GROUP:
                for k, _, c, d in elements(data, a, b):
                    if k == BLOCK:
                        body = (c, d)
                    elif k == BLOCK_DURATION:
                        duration = _uint(data, c, d) * movie.scale
                    elif k == REFERENCE_BLOCK:
                        keyframe = False
            track, relative, flags, frames = frames_of(data, *body)
            if key == SIMPLE_BLOCK:
                keyframe = bool(flags & 0x80)
            each = movie.tracks.get(track, {}).get("default_duration", 0)
            if duration >= 0 and frames:
                each = duration // len(frames)
            at = (start + relative) * movie.scale
            movie.packets += [(track, at + i * each, each or duration, keyframe, x, y - x, number) for i, (x, y) in enumerate(frames)]


def _cues(movie: Movie, data: bytes, lo: int, hi: int) -> None:
    for key, _, a, b in elements(data, lo, hi):
        if key != CUE_POINT:
            continue
        time, places = 0, []
        for k, _, c, d in elements(data, a, b):
            if k == CUE_TIME:
                time = _uint(data, c, d)
            elif k == CUE_TRACK_POSITIONS:
                found = {x: _uint(data, e, f) for x, _, e, f in elements(data, c, d)}
                places.append((found.get(CUE_TRACK, 0), found.get(CUE_CLUSTER_POSITION, 0)))
        movie.cues += [(time, track, position) for track, position in places]


# Tables


def padded(text: str | None, frame: int = FRAME) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with 255 appended up to a positive multiple of `frame`)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (frame * max(1, -(-len(raw) // frame)) - len(raw))


def feature(movie: Movie, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    up = x >= 128
    crossings = int(np.count_nonzero(up[1:] != up[:-1]))
    clusters = {(t, p) for p, t in movie.clusters}
    indexed = sum((time, position) in clusters for time, _, position in movie.cues)
    return (
        f"codec={movie.tracks[1]['codec']};packets={len(movie.packets)};clusters={len(movie.clusters)};cues={indexed};"
        f"ms={movie.duration:.0f};last_ns={movie.packets[-1][1]};sum={int(x.sum(dtype=np.int64))};peak={int(x.max())};crossings={crossings}"
    )


def store_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media.

    Every text (null: empty) becomes a Matroska file with one track of 8-bit
    samples; the payload columns are computed from the packets that the parser
    finds in that file. Equal texts give equal values, repeated rows repeated
    results, and an empty table an empty result. Other columns are not read.
    """

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            # Few bytes at a time: the media column is as large as the texts.
            for lo, hi in chunks(offsets):
                rows = []
                for value in batch.column(1).slice(lo, hi - lo).to_pylist():
                    n, payload = padded(value)
                    media = mux(payload)
                    movie = parse(media)
                    back = b"".join([media[p[4] : p[4] + p[5]] for p in movie.packets])
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(movie, back), media))
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", *names])

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    return columns.mapInArrow(task(turn), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")


def packet_table(media: DataFrame, key: str = "doc_id", data: str = "media") -> DataFrame:
    """key, track, packet, timestamp_ns, duration_ns, keyframe, offset, size, cluster: one row per packet of every file.

    A null file has no packets; bytes that aren't well-formed fail the query.
    """

    names = ["track", "packet", "timestamp_ns", "duration_ns", "keyframe", "offset", "size", "cluster"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                raw = batch.column(1)[i].as_py()
                found = parse(raw).packets if raw is not None else []
                if found:
                    track, at, duration, keyframe, offset, size, cluster = zip(*found, strict=True)
                    columns = (track, range(len(found)), at, duration, keyframe, offset, size, cluster)
                    own = batch.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(list(c), k) for c, k in zip(columns, types, strict=True))], [key, *names])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, data).mapInArrow(task(turn), f"`{key}` {kind}, track int, packet int, timestamp_ns long, duration_ns long, keyframe boolean, offset long, size long, cluster int")
