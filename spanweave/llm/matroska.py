"""Media columns in Matroska (operator 7).

A payload is stored as 8-bit mono samples at 8 kHz: clusters of simple blocks,
laced where a block has several frames, and a cue for each cluster.  Reading
parses the elements again, whatever wrote them, into a packet table: track,
timestamp, byte range and key flag of every frame.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts
give equal files; a null id stays null; damaged files, numbers too large for
their columns included, give the packets before the damage and an ``error``;
time is linear in the file, whatever its elements; repeated rows get equal
results; an empty table gives an empty result; only the named columns are read,
so others cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

# Element ids of the public format.
EBML = 0x1A45DFA3
EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACES, FRAME_TIME, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK, TAGS, CHAPTERS, FILES = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: What may follow a cluster of unknown size.
TOP = {SEEK, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, FILES}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3
#: What the columns of packets can't hold: a track is an int, a time a long.
INT, LONG = 1 << 31, 1 << 63

#: A tick is one sample at 8 kHz, in nanoseconds.
TICK = 125_000
FRAME = 1024
FRAMES = 8
SPAN = 32 * FRAME  # bytes of a cluster; block times are signed 16-bit


def vint(n: int, width: int = 0) -> bytes:
    """A size: the position of the first set bit gives the length; all ones is kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    """A difference of lace sizes, shifted by the middle of its range."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return vint(n + (1 << 7 * width - 1) - 1, width)


def element(ident: int, body: bytes | int | float) -> bytes:
    if isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def lace(sizes: list[int], kind: int) -> bytes:
    """What stands before the frames of a block with lacing."""
    head = bytes([len(sizes) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == EBML_LACE:
        steps = [b - a for a, b in zip(sizes, sizes[1:-1])]
        return head + vint(sizes[0]) + b"".join(map(signed_vint, steps))
    return head


def write(payload: bytes) -> bytes:
    """A file that holds the payload as PCM."""
    header = element(
        EBML,
        b"".join(
            element(i, v)
            for i, v in (
                (EBML_VERSION, 1), (EBML_READ, 1), (MAX_ID, 4), (MAX_SIZE, 8),
                (DOC_TYPE, b"matroska"), (DOC_VERSION, 4), (DOC_READ, 2),
            )
        ),
    )
    info = element(INFO, element(SCALE, TICK) + element(DURATION, float(len(payload))) + element(MUXER, b"spanweave") + element(WRITER, b"spanweave"))
    audio = element(AUDIO, element(RATE, 8000.0) + element(CHANNELS, 1) + element(DEPTH, 8))
    track = element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(LACES, 1) + element(FRAME_TIME, FRAME * TICK)
    parts = [info, element(TRACKS, element(TRACK, track + element(CODEC, b"A_PCM/INT/LIT") + audio))]
    at, cues = sum(map(len, parts)), []
    for n, start in enumerate(range(0, len(payload), SPAN)):
        blocks = [element(TIME, start)]
        for first in range(start, min(start + SPAN, len(payload)), FRAME * FRAMES):
            body = payload[first : min(first + FRAME * FRAMES, start + SPAN)]
            sizes = [min(FRAME, len(body) - k) for k in range(0, len(body), FRAME)]
            even = sizes[0] == sizes[-1]
            kind = NO_LACE if len(sizes) == 1 else FIXED if even else EBML_LACE if n % 2 else XIPH
            head = vint(1) + struct.pack(">hB", first - start, 0x80 | kind << 1)
            blocks.append(element(SIMPLE, head + (lace(sizes, kind) if kind else b"") + body))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, element(CUE_TIME, start) + element(CUE_AT, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        at += len(cluster)
        parts.append(cluster)
    return header + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


class Damaged(ValueError):
    pass


@dataclass
class Media:
    #: (track, timestamp in ticks, start, length, key) of each frame, in file order.
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    tracks: dict[int, tuple[str, int]] = field(default_factory=dict)  # number: codec, ns of a frame
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, position of the cluster
    clusters: list[int] = field(default_factory=list)  # positions within the segment
    scale: int = 1_000_000
    error: str | None = None


def _number(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """(value, where it ends, all ones) of a variable-length number; ``keep``: with its length marker, as ids have."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return raw if keep else value, at + width, value == (1 << 7 * width) - 1


def _cluster_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next top element or with its parent; read over sizes alone, each once."""
    try:
        while at < end:
            ident, body, _ = _number(data, at, keep=True)
            if ident in TOP:
                return at
            size, body, unknown = _number(data, body)
            at = end if unknown else body + size
    except Damaged:
        # Reading the cluster itself meets the same damage, behind the packets before it.
        pass
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, own start, body start, body end) of the elements in a body; one of unknown size ends where its parent or the next top element does."""
    while at < end:
        own = at
        ident, at, _ = _number(data, at, keep=True)
        size, at, unknown = _number(data, at)
        stop = end if unknown else at + size
        if unknown and ident == CLUSTER:
            stop = _cluster_end(data, at, end)
        if stop > end:
            if ident in (SEGMENT, CLUSTER, GROUP):
                yield ident, own, at, end
            raise Damaged(f"element at {own} is cut off")
        yield ident, own, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges) of a block."""
    track, at, _ = _number(data, at)
    if at + 3 > end:
        raise Damaged(f"block at {at} is cut off")
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACE:
        return track, time, flags, [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACE and count > 1:
        size, at, _ = _number(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            step, at, _ = _number(data, at)
            size += step - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(size)
    elif kind == FIXED:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lace at {at} does not fit")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, time, flags, out


def read(data: bytes) -> Media:
    """Packets, tracks and cues of a file; numbers beyond the columns' types are damage."""
    m = Media()

    def uint(a: int, b: int) -> int:
        value = int.from_bytes(data[a:b], "big") if b - a <= 8 else LONG
        if value >= LONG:
            raise Damaged(f"number at {a} is too large")
        return value

    def block(a: int, b: int, base: int, simple: bool) -> None:
        track, rel, flags, frames = _frames(data, a, b)
        step = m.tracks.get(track, ("", 0))[1] // max(1, m.scale)
        if track >= INT or base + rel + (len(frames) - 1) * step >= LONG:
            raise Damaged(f"track or time of the block at {a} is too large")
        for i, (start, size) in enumerate(frames):
            m.packets.append((track, base + rel + i * step, start, size, bool(flags & 0x80) or not simple))

    def cluster(at: int, end: int) -> None:
        base = 0
        for k, _, a, b in elements(data, at, end):
            if k == TIME:
                base = uint(a, b)
            elif k == SIMPLE:
                block(a, b, base, True)
            elif k == GROUP:
                for j, _, c, d in elements(data, a, b):
                    if j == BLOCK:
                        block(c, d, base, False)

    def segment(at: int, end: int) -> None:
        for k, own, a, b in elements(data, at, end):
            if k == INFO:
                m.scale = next((uint(c, d) for j, _, c, d in elements(data, a, b) if j == SCALE), m.scale)
            elif k == TRACKS:
                for _, _, c, d in elements(data, a, b):
                    parts = {j: (e, f) for j, _, e, f in elements(data, c, d)}
                    if NUMBER in parts:
                        codec = data[slice(*parts[CODEC])].decode("ascii", "replace") if CODEC in parts else ""
                        m.tracks[uint(*parts[NUMBER])] = (codec, uint(*parts[FRAME_TIME]) if FRAME_TIME in parts else 0)
            elif k == CLUSTER:
                m.clusters.append(own - at)
                cluster(a, b)
            elif k == CUES:
                for j, _, c, d in elements(data, a, b):
                    if j == CUE:
                        parts = {i: (e, f) for i, _, e, f in elements(data, c, d)}
                        where = {i: uint(e, f) for i, _, e, f in elements(data, *parts[CUE_AT])} if CUE_AT in parts else {}
                        m.cues.append((uint(*parts[CUE_TIME]) if CUE_TIME in parts else 0, where.get(CUE_TRACK, 0), where.get(CUE_CLUSTER, 0)))

    try:
        for k, _, a, b in elements(data, 0, len(data)):
            if k == SEGMENT:
                segment(a, b)
    except (Damaged, IndexError) as e:
        m.error = str(e)
    return m


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


PACKETS = "array<struct<track:int,timestamp:bigint,start:bigint,length:bigint,key:boolean>>"
SCHEMA = f"doc_id long, n_bytes long, media binary, packets {PACKETS}, cues int, clusters int, payload binary, error string"


def store_texts(docs: DataFrame) -> DataFrame:
    """For every row the stored file, its packet table as read back, and the payload that the packets point to."""
    packet = pa.struct(
        [("track", pa.int32()), ("timestamp", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("key", pa.bool_())]
    )
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(packet), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    names = ["doc_id", "n_bytes", "media", "packets", "cues", "clusters", "payload", "error"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                media = write(padded(raw))
                m = read(media)
                payload = b"".join([media[p[2] : p[2] + p[3]] for p in m.packets])
                packets = [dict(zip(("track", "timestamp", "start", "length", "key"), p, strict=True)) for p in m.packets]
                rows.append((doc, len(raw), media, packets, len(m.cues), len(m.clusters), payload, m.error))
                size += 2 * len(media)
                if size >= 16_000_000:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def packet_table(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """A row for each packet of each file: key, track, timestamp, start, length, key_frame; a damaged file's last row has only ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "track", "timestamp", "start", "length", "key_frame", "error"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for ident, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = read(blob.as_py() or b"")
                rows += [(ident, *p, None) for p in m.packets]
                if m.error:
                    rows.append((ident, None, None, None, None, None, m.error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "id string, track int, timestamp long, start long, length long, key_frame boolean, error string"
    found = media.select(F.col(key).cast("string").alias("id"), F.col(column).cast("binary")).mapInArrow(run, schema)
    return found.withColumn("id", F.col("id").cast(media.schema[key].dataType)).withColumnRenamed("id", key)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents"))
    last = F.element_at("packets", -1)
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ":",
            F.size("packets"),
            "clusters",
            "cues",
            F.size(F.filter("packets", lambda p: p["key"])),
            last["timestamp"],
            last["length"],
            F.lower(F.hex(F.crc32("payload"))),
        ).alias("feature"),
    )
