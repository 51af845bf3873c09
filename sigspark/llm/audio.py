"""Media columns: payloads in MPEG audio streams, and what their frames say.

A stream is an ID3v2 tag, an information frame with the variable-bitrate table,
audio frames (MPEG-1 Layer III, one channel, checksum on) and an ID3v1 tag. The
payload lies in the bytes of the frames that no channel uses; a decoder plays silence.
"""
from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import as_bytes, record

UNIT = 192
# Fixed values of the format: kbit/s by index (MPEG-1 Layer III), sample rates, samples of a frame, bytes of side information.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
SIDE_MONO, SIDE_STEREO = 17, 32
RATE_INDEX = 1
#: Bytes in front of the payload of a frame: header, checksum, side information.
HEAD = 4 + 2 + SIDE_MONO


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _frame_head(bitrate: int) -> bytes:
    """Header with checksum bit, checksum over header end and side information, empty side information."""
    tail = bytes([bitrate << 4 | RATE_INDEX << 2, 0b11000000])
    side = bytes(SIDE_MONO)
    return b"\xff\xfa" + tail + struct.pack(">H", crc16(tail + side)) + side


HEADS = {b: _frame_head(b) for b in range(1, 15)}
ROOM = {b: 144000 * BITRATES[b] // RATES[RATE_INDEX] - HEAD for b in range(1, 15)}
LARGEST = 14


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """Stream that holds the payload. Its length is in a tag, so that the last frame may have room to spare."""
    text = b"\x00payload\x00%d" % len(payload)
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    parts, sizes, at = [], [], 0
    while at < len(payload):
        rest = len(payload) - at
        b = LARGEST if rest >= ROOM[LARGEST] else next(b for b in range(1, 15) if ROOM[b] >= rest)
        parts.append(HEADS[b] + payload[at : at + ROOM[b]].ljust(ROOM[b], b"\x00"))
        sizes.append(len(parts[-1]))
        at += ROOM[b]
    info = 10  # the frame that carries the table
    total = HEAD + ROOM[info] + sum(sizes)
    table, run, k = bytearray(), HEAD + ROOM[info], 0
    for percent in range(100):
        while k < len(sizes) and k * 100 < percent * len(sizes):
            run += sizes[k]
            k += 1
        table.append(min(255, run * 256 // total))
    xing = b"Xing" + struct.pack(">III", 7, len(sizes), total) + bytes(table)
    first = HEADS[info] + xing.ljust(ROOM[info], b"\x00")
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + first + b"".join(parts) + b"TAG" + bytes(125)


class Frame(NamedTuple):
    offset: int
    size: int
    bitrate: int
    rate: int
    data: int  # where the bytes behind the side information begin
    intact: bool | None  # None without a checksum


def _header(stream: bytes, at: int):
    """Size, bitrate, rate, checksum flag and side length of the frame header at a place, or None."""
    if at + 4 > len(stream) or stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xFA:
        return None
    b, r = stream[at + 2] >> 4, stream[at + 2] >> 2 & 3
    if not 0 < b < 15 or r == 3:
        return None
    size = 144000 * BITRATES[b] // RATES[r] + (stream[at + 2] >> 1 & 1)
    return size, BITRATES[b], RATES[r], not stream[at + 1] & 1, SIDE_MONO if stream[at + 3] >> 6 == 3 else SIDE_STEREO


def frames(stream: bytes, start: int, end: int, known: dict | None = None) -> list[Frame]:
    """Frames in order. After damage the next place with a header whose frame is followed by another, or the end, counts."""
    out, at, known = [], start, {} if known is None else known
    locked = False
    while at < end:
        head = _header(stream, at)
        ok = head is not None and at + head[0] <= end
        if ok and not locked:
            follows = at + head[0]
            ok = follows == end or _header(stream, follows) is not None
        if not ok:
            locked = False
            at = stream.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        size, bitrate, rate, guarded, side = head
        intact = None
        if guarded:
            key = stream[at + 2 : at + 6 + side]
            intact = known.get(key)
            if intact is None:
                intact = known[key] = crc16(key[:2] + key[4:]) == key[2] << 8 | key[3]
                if len(known) > 4096:
                    known.clear()
        out.append(Frame(at, size, bitrate, rate, at + 4 + 2 * guarded + side, intact))
        locked, at = True, at + size
    return out


class Media(NamedTuple):
    payload: bytes
    frames: list[Frame]
    declared: int | None  # frames that the table declares
    table: bytes
    damaged: int
    seconds: tuple[int, int]  # samples and their rate: an exact duration


def decode(stream: bytes, known: dict | None = None) -> Media:
    """Tags, table, frames and payload of a stream."""
    start, end, length = 0, len(stream), None
    if stream[:3] == b"ID3":
        size = sum((x & 127) << s for x, s in zip(stream[6:10], (21, 14, 7, 0)))
        at, start = 10, 10 + size
        while at + 10 <= start and stream[at : at + 4].strip(b"\x00"):
            n = struct.unpack(">I", stream[at + 4 : at + 8])[0]
            body = stream[at + 10 : at + 10 + n]
            if stream[at : at + 4] == b"TXXX" and body.startswith(b"\x00payload\x00"):
                length = int(body[9:])
            at += 10 + n
    if end - start >= 128 and stream[end - 128 : end - 125] == b"TAG":
        end -= 128
    found = frames(stream, start, end, known)
    declared, toc = None, b""
    if found and stream[found[0].data : found[0].data + 4] in (b"Xing", b"Info"):
        at = found[0].data + 4
        flags, at = struct.unpack(">I", stream[at : at + 4])[0], at + 4
        if flags & 1:
            declared, at = struct.unpack(">I", stream[at : at + 4])[0], at + 4
        at += 4 * bool(flags & 2)
        toc = stream[at : at + 100] if flags & 4 else b""
        found = found[1:]
    payload = b"".join(stream[f.data : f.offset + f.size] for f in found)
    if length is not None:
        payload = payload[:length]
    damaged = sum(f.intact is False for f in found)
    return Media(payload, found, declared, toc, damaged, (SAMPLES * len(found), found[0].rate if found else RATES[RATE_INDEX]))


def to_media(docs: DataFrame) -> DataFrame:
    """Column ``media``: the padded text of every document as an MPEG audio stream.

    Needs ``doc_id`` and ``text``. Null and empty texts are one unit of blanks.
    Every text is stored whole; equal texts give equal streams.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            padded = (t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b" ") for t in texts)
            yield record(schema, batch.column("doc_id"), [len(t) for t in texts], [encode(p) for p in padded])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("n_frames", pa.int64()), ("declared_frames", pa.int64()), ("damaged_frames", pa.int64()), ("samples", pa.int64()),
    ("sample_rate", pa.int32()), ("mean_bitrate", pa.float64()), ("seek", pa.list_(pa.int64())),
])
SEEK_EVERY = 38  # frames, about a second


def read_media(media: DataFrame) -> DataFrame:
    """Payload, duration, checks and seek offsets (one for about each second) from the ``media`` column.

    A null stream or one without frames has no payload and no frames.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            cols = [[] for _ in FEATURES]
            for doc_id, n, stream in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                stream = stream or b""
                m = decode(stream, known)
                spent = sum(f.size for f in m.frames)
                row = (
                    doc_id, n, m.payload, len(stream), hashlib.sha256(stream).hexdigest(), len(m.frames), m.declared, m.damaged, *m.seconds,
                    spent * 8 * m.seconds[1] / m.seconds[0] if m.seconds[0] else 0.0, [f.offset for f in m.frames[::SEEK_EVERY]],
                )
                for c, x in zip(cols, row):
                    c.append(x)
            yield record(FEATURES, *cols)

    schema = (
        "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames long, declared_frames long, "
        "damaged_frames long, samples long, sample_rate int, mean_bitrate double, seek array<long>"
    )
    return media.mapInArrow(work, schema)


def digests(read: DataFrame) -> DataFrame:
    """Digest columns of what was read back."""
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    told = F.concat_ws(
        ";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("declared="), "declared_frames"), F.concat(F.lit("damaged="), "damaged_frames"),
        F.concat(F.lit("samples="), "samples"), F.concat(F.lit("rate="), "sample_rate"), F.concat(F.lit("seek="), F.size("seek")),
    )
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", told.alias("feature"),
    )


