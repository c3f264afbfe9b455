"""Matroska as columns: texts to audio files and files to packet tables."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNIT = 192
FRAME = 5 * UNIT                  # bytes of a packet; one byte is one sample
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 8
RATE = 8000

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK, AUDIO, CUE_POINT, CUE_TRACK_POSITIONS, BLOCK_GROUP = 0xAE, 0xE1, 0xBB, 0xB7, 0xA0
TIMESTAMP_SCALE, DURATION, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x9C
DEFAULT_DURATION, CODEC_ID, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0x86, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA1, 0x9B, 0xFB
CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION = 0xB3, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, MUXING_APP, WRITING_APP = 0x4282, 0x4287, 0x4285, 0x4D80, 0x5741
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

PACKET = "struct<track:bigint,cluster:int,block:int,frame:int,timestamp_ns:bigint,offset:bigint,size:bigint,keyframe:boolean,lacing:int>"
CUE = "struct<timestamp_ns:bigint,track:bigint,cluster_offset:bigint>"
PACKET_ARROW = pa.list_(pa.struct([("track", pa.int64()), ("cluster", pa.int32()), ("block", pa.int32()), ("frame", pa.int32()), ("timestamp_ns", pa.int64()),
                                   ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32())]))
CUE_ARROW = pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int64()), ("cluster_offset", pa.int64())]))


def vint(n: int) -> bytes:
    """A size in the fewest bytes; a row of ones means an unknown size and is never written for a known one."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(key: int, x: float) -> bytes:
    return element(key, struct.pack(">d", x))


def block_of(frames: list[bytes], track: int, relative: int, key: bool = True, lacing: int | None = None) -> bytes:
    """A block's body; without a lacing given, frames of one size take fixed, others EBML lacing."""
    if lacing is None:
        lacing = NO_LACING if len(frames) == 1 else FIXED if len({*map(len, frames)}) == 1 else EBML_LACING
    out = vint(track) + struct.pack(">hB", relative, (0x80 if key else 0) | lacing << 1)
    if lacing == NO_LACING:
        return out + frames[0]
    out += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        out += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < 1 << 7 * width - 1:
                width += 1
            out += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return out + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file with one track of 8-bit samples, clusters of laced blocks, and cues."""
    header = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8)
                     + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / RATE)
                   + element(MUXING_APP, b"columns") + element(WRITING_APP, b"columns"))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1)
                                     + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT")
                                     + element(AUDIO, real(SAMPLING_FREQUENCY, float(RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    step = FRAME * FRAMES_PER_BLOCK
    for lo in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        start = lo * 1000 // RATE
        body = number(CLUSTER_TIMESTAMP, start)
        for b in range(lo, min(lo + step * BLOCKS_PER_CLUSTER, len(payload)), step):
            frames = [payload[i:i + FRAME] for i in range(b, min(b + step, len(payload)), FRAME)]
            body += element(SIMPLE_BLOCK, block_of(frames, 1, b * 1000 // RATE - start))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, body))
        at += len(parts[-1])
    return header + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Parsed:
    """Packets and cues of a file; byte ranges are of the file, cluster offsets of the segment's content."""

    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    scale: int = 1_000_000
    durations: dict[int, int] = field(default_factory=dict)
    clusters: int = 0
    error: str | None = None


def read_vint(b: bytes, at: int, end: int, keep_mark: bool = False) -> tuple[int | None, int]:
    """(value, position after it); None for the row of ones that means an unknown size."""
    if at >= end or not b[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - b[at].bit_length()
    if at + width > end:
        raise ValueError(f"a number is cut off at byte {at}")
    n = int.from_bytes(b[at:at + width], "big")
    if keep_mark:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(b: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, body's begin, body's end, size known) of the elements in a range; ``stop`` ends a body of unknown size."""
    while at < end:
        key, body = read_vint(b, at, end, keep_mark=True)
        if key in stop:
            return
        size, body = read_vint(b, body, end)
        if size is not None and body + size > end:
            raise ValueError(f"element {key:#x} at byte {at} is cut off")
        to = end if size is None else body + size
        sent = yield key, body, to, size is not None
        at = to if sent is None else sent


def frames_of(b: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, byte ranges) of a block."""
    track, at = read_vint(b, at, end)
    if at + 3 > end:
        raise ValueError(f"a block is cut off at byte {at}")
    relative, flags = struct.unpack_from(">hB", b, at)
    at, lacing = at + 3, flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, flags, [(at, end - at)]
    n, at, sizes = b[at] + 1, at + 1, []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError(f"fixed lacing at byte {at} does not divide the block")
        sizes = [(end - at) // n] * n
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + b[at])
            at += 1
    else:
        for i in range(n - 1):
            was = at
            size, at = read_vint(b, at, end)
            sizes.append(size if i == 0 else sizes[-1] + size - (1 << 7 * (at - was) - 1) + 1)
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing sizes at byte {at} exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, flags, out


def _integer(b: bytes, at: int, to: int) -> int:
    return int.from_bytes(b[at:to], "big")


def demux(b: bytes) -> Parsed:
    """Parse a file; what lies before a fault is kept, and the fault is named in ``error``."""
    p = Parsed()
    try:
        top = elements(b, 0, len(b))
        for key, at, to, _ in top:
            if key == SEGMENT:
                _segment(b, at, to, p)
    except (ValueError, IndexError) as e:
        p.error = str(e) or "cut off"
    return p


def _segment(b: bytes, begin: int, end: int, p: Parsed) -> None:
    walk = elements(b, begin, end)
    item = next(walk, None)
    while item:
        key, at, to, known = item
        after = None
        if key == INFO:
            for k, x, y, _ in elements(b, at, to):
                if k == TIMESTAMP_SCALE:
                    p.scale = _integer(b, x, y)
        elif key == TRACKS:
            for k, x, y, _ in elements(b, at, to):
                if k == TRACK:
                    of = {i: _integer(b, u, v) for i, u, v, _ in elements(b, x, y) if i in (TRACK_NUMBER, DEFAULT_DURATION)}
                    p.durations[of.get(TRACK_NUMBER, 1)] = of.get(DEFAULT_DURATION, 0)
        elif key == CLUSTER:
            after = _cluster(b, at, to, known, p)
        elif key == CUES:
            for k, x, y, _ in elements(b, at, to):
                if k == CUE_POINT:
                    _cue(b, x, y, p)
        try:
            item = walk.send(after)
        except StopIteration:
            item = None


def _cluster(b: bytes, begin: int, end: int, known: bool, p: Parsed) -> int:
    """Read a cluster's blocks; returns where it ends, which a cluster of unknown size only tells by the next one."""
    p.clusters += 1
    time, blocks, last = 0, 0, begin
    for key, at, to, _ in elements(b, begin, end, frozenset() if known else frozenset(TOP_LEVEL)):
        last = to
        if key == CLUSTER_TIMESTAMP:
            time = _integer(b, at, to)
        elif key in (SIMPLE_BLOCK, BLOCK_GROUP):
            body, duration, key_frame = (at, to), None, None
            if key == BLOCK_GROUP:
                inner = {k: (x, y) for k, x, y, _ in elements(b, at, to)}
                if BLOCK not in inner:
                    raise ValueError(f"a block group at byte {at} has no block")
                body, key_frame = inner[BLOCK], REFERENCE_BLOCK not in inner
                duration = _integer(b, *inner[BLOCK_DURATION]) * p.scale if BLOCK_DURATION in inner else None
            track, relative, flags, ranges = frames_of(b, *body)
            step = p.durations.get(track, 0) or (duration or 0) // len(ranges)
            for i, (x, size) in enumerate(ranges):
                p.packets.append((track, p.clusters - 1, blocks, i, (time + relative) * p.scale + i * step, x, size,
                                  bool(flags & 0x80) if key_frame is None else key_frame, flags >> 1 & 3))
            blocks += 1
    return end if known else last


def _cue(b: bytes, begin: int, end: int, p: Parsed) -> None:
    time, where = 0, []
    for k, x, y, _ in elements(b, begin, end):
        if k == CUE_TIME:
            time = _integer(b, x, y) * p.scale
        elif k == CUE_TRACK_POSITIONS:
            of = {i: _integer(b, u, v) for i, u, v, _ in elements(b, x, y)}
            where.append((of.get(CUE_TRACK, 1), of.get(CUE_CLUSTER_POSITION, 0)))
    p.cues += [(time, t, at) for t, at in where]


def padded(text: str) -> bytes:
    """UTF-8, filled up with spaces to a positive multiple of UNIT bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a Matroska file. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                                              pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def columns(files: DataFrame) -> DataFrame:
    """Add packets, cues, error and payload (all packets' bytes, in order) to rows with a ``media`` column.

    Null media has no packets, an empty payload and the error "no file"; a damaged file keeps what lies
    before the fault and names it. Columns called packets, cues, error or payload are replaced; repeated
    rows are parsed each; an empty table gives an empty result. A file is held whole by its task.
    """
    base = files.drop("packets", "cues", "error", "payload")
    names = base.columns
    plain, at = [f"c{i}" for i in range(len(names))], names.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = PACKET_ARROW.value_type, CUE_ARROW.value_type
        for b in batches:
            packets, cues, errors, payload = [], [], [], []
            for m in b.column(at).to_pylist():
                p = demux(m) if m is not None else Parsed(error="no file")
                packets.append([dict(zip([f.name for f in keys[0]], x)) for x in p.packets])
                cues.append([dict(zip([f.name for f in keys[1]], x)) for x in p.cues])
                errors.append(p.error)
                payload.append(b"".join([m[x[5]:x[5] + x[6]] for x in p.packets]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packets, PACKET_ARROW), pa.array(cues, CUE_ARROW), pa.array(errors, pa.string()),
                                              pa.array(payload, pa.binary())], [*plain, "packets", "cues", "error", "payload"])

    fields = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, base.schema.fields))
    out = base.toDF(*plain).mapInArrow(run, f"{fields}, packets array<{PACKET}>, cues array<{CUE}>, error string, payload binary")
    return out.toDF(*names, "packets", "cues", "error", "payload")


def packet_table(files: DataFrame) -> DataFrame:
    """One row per packet, beside all columns of the file but its bytes."""
    c = columns(files).drop("payload", "cues")
    return c.select(*[F.col(f"`{x}`") for x in c.columns if x not in ("packets", "media")], F.explode("packets").alias("_p")).select("*", "_p.*").drop("_p")
