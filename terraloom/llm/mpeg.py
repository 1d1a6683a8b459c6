"""Operator 8: media columns in the MPEG audio format.

A payload travels as a stream of mono MPEG-1 Layer III frames at 48 kHz: an ID3v2 tag (payload length,
CRC-32, play time), a frame with the variable-bitrate table, silent audio frames whose ancillary bytes are the
payload, and an ID3v1 trailer. All frames take the highest bitrate but the last, which takes the lowest that
holds the rest. Every frame carries the CRC-16 of its header and side information.

Reading works on any MPEG-1/2/2.5 audio stream: it skips junk until two frame headers follow one another (or
the stream ends with the frame), parses ID3v2 (2.2 to 2.4, extended headers, footers, unsynchronised tags and frames),
ID3v1 and Xing/Info/VBRI tables, verifies checksums of layers I and III (those of layer II need its allocation tables
and are not verified), and gives the exact duration (samples over rate, summed over all rates), the duration without
the encoder's delay and padding where the table tells them, and the byte offset of each frame for seeking. Tags may
follow one another or stand between frames; of a frame that is in several, the last counts. Frames of free format have
the distance of the next two headers of their kind as their size. Any bytes can be read: what is cut short counts as
far as it goes. Compressed or encrypted frames of tags are kept as stored.

Documents are independent: one map over the scan, no shuffle.

Cases: a null text counts as empty; an empty text is a payload of 64 zero bytes; repeated rows repeat and
equal texts give equal values; a null doc_id stays null; extra columns are dropped; an empty table gives an
empty result; a stream without any frame has duration 0 and no offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import sha256

# Fixed values of the format: kbit/s by bitrate index, Hz by rate index.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
ENCODERS = (b"LAME", b"Lavc", b"Lavf")
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

BLOCK = 64
SIDE = bytes(17)
OWNER = b"payload\0"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _crc16_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        table.append(c)
    return table


_CRC16 = _crc16_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC16[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    size: int
    samples: int
    rate: int
    kbps: int
    layer: int
    side: int
    protected: bool
    checked: int  # bytes behind the checksum that it covers besides the header's last two; -1: unknown


@lru_cache(maxsize=4096)
def header(b: bytes, free: int = 0) -> Header | None:
    """What four bytes say if they are a frame header; ``free`` is the size of unpadded frames of free format, if known."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or (index == 0 and not free):
        return None
    first = version == 3
    kbps, hz = KBPS[1 if first else 2, layer][index], RATES[version][rate]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    pad = b[2] >> 1 & 1
    if index == 0:
        size, kbps = free + pad * (4 if layer == 1 else 1), round(free * 8 * hz / samples / 1000)
    else:
        size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mono = b[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else 9 if mono else 17
    apart = 32 if b[3] >> 6 != 1 else 4 * ((b[3] >> 4 & 3) + 1)  # subbands that two channels allocate apart (layer I)
    checked = side if layer == 3 else (16 if mono else (32 + apart) // 2) if layer == 1 else -1
    return Header(size, samples, hz, kbps, layer, side, not b[1] & 1, checked)


def _frame_head(index: int) -> bytes:
    """Header, checksum and side information of a frame that we write."""
    h = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return h + struct.pack(">H", crc16(h[2:] + SIDE)) + SIDE


_HEADS = {i: _frame_head(i) for i in range(1, 15)}
_SIZES = {i: 3 * KBPS[1, 3][i] for i in range(1, 15)}
_ROOM = {i: _SIZES[i] - len(_HEADS[i]) for i in range(1, 15)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag_frame(name: bytes, data: bytes) -> bytes:
    return name + _syncsafe(len(data)) + b"\0\0" + data


def write_stream(payload: bytes) -> bytes:
    room = _ROOM[14]
    frames = [_HEADS[14] + payload[i : i + room] for i in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(frames) * room :]:
        index = next(i for i in range(1, 15) if _ROOM[i] >= len(rest))
        frames.append(_HEADS[index] + rest + bytes(_ROOM[index] - len(rest)))
    body = b"".join(frames)
    table_at = next(i for i in range(1, 15) if _ROOM[i] >= 120)
    total = _SIZES[table_at] + len(body)
    full = [_SIZES[14]] * (len(frames) - 1)
    starts = [_SIZES[table_at] + i * _SIZES[14] for i in range(len(full) + 1)]
    seek = bytes(min(255, starts[min(len(frames) - 1, p * len(frames) // 100)] * 256 // total) if frames else 0 for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + seek
    first = _HEADS[table_at] + xing
    first += bytes(_SIZES[table_at] - len(first))
    length_ms = b"\0" + str(len(frames) * 1152 * 1000 // 48000).encode()
    tags = _tag_frame(b"TLEN", length_ms) + _tag_frame(b"PRIV", OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload)))
    return b"ID3\x04\0\0" + _syncsafe(len(tags)) + tags + first + body + b"TAG" + bytes(124) + b"\xff"


@dataclass
class Stream:
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    kbps: dict[int, int] = field(default_factory=dict)
    samples: int = 0
    rate: int = 0
    skipped: int = 0
    bad_checksums: int = 0
    duration: Fraction = Fraction(0)
    heard: Fraction = Fraction(0)  # the duration without the encoder's delay and padding
    ancillary: bytes = b""


def _free_size(data: bytes, at: int, end: int) -> int:
    """The size of unpadded frames of free format, if two headers of one kind follow that at ``at``; 0 otherwise.

    A frame is no longer than one of the highest bitrate of its layer.
    """
    highest = header(bytes((*data[at : at + 2], data[at + 2] | 0xE0, data[at + 3]))) if data[at + 2] >> 4 == 0 else None
    if highest is None:
        return 0
    slot = 4 if highest.layer == 1 else 1
    same = lambda p: data[p : p + 2] == data[at : at + 2] and p + 4 <= end and not (data[p + 2] ^ data[at + 2]) & 0xFC
    to = at
    while (to := data.find(data[at : at + 2], to + 4 if to == at else to + 1, min(end, at + highest.size + 4))) > 0:
        size = to - at - (data[at + 2] >> 1 & 1) * slot
        if same(to) and size > 4 + highest.side:
            after = to + size + (data[to + 2] >> 1 & 1) * slot
            if after == end or same(after):
                return size
    return 0


def _synchronised(b: bytes) -> bytes:
    return b.replace(b"\xff\0", b"\xff")


def _read_id3(data: bytes, tags: dict[str, bytes], start: int = 0) -> int:
    """Frames of an ID3v2 tag at ``start``; the offset behind it and its footer, ``start`` if there is no tag.

    Up to version 2.3 a tag is unsynchronised as a whole and frames have their sizes before that; in version 2.4 each
    frame is by itself and has its size after that.
    """
    lead = data[start : start + 10]
    if lead[:3] != b"ID3" or len(lead) < 10 or 0xFF in lead[3:5] or max(lead[6:10]) > 127:
        return start
    version, flags = lead[3], lead[5]
    unsafe = lambda b: int.from_bytes(b, "big") if version < 4 else sum((x & 127) << 7 * k for k, x in enumerate(reversed(b)))
    size = sum(x << 7 * k for k, x in enumerate(reversed(lead[6:10])))
    body = data[start + 10 : start + 10 + size]
    if flags & 0x80 and version < 4:
        body = _synchronised(body)
    at = 0
    if version >= 3 and flags & 0x40:  # extended header; version 2.3 does not count its own size
        at = unsafe(body[:4]) + (4 if version == 3 else 0)
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at] != 0:
        n = unsafe(body[at + name : at + name + 4]) if name == 4 else int.from_bytes(body[at + 3 : at + 6], "big")
        value = body[at + head : at + head + n]
        if version >= 4:
            form = body[at + 9]
            if not form & 0x0C:  # neither compressed nor encrypted: without group and length, and synchronised
                value = value[bool(form & 0x40) + 4 * (form & 1) :]
                value = _synchronised(value) if form & 2 else value
        tags[body[at : at + name].decode("latin-1")] = value
        at += head + n
    return start + 10 + size + (10 if version >= 4 and flags & 0x10 else 0)


def _read_table(frame: bytes, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table of a frame, if it is one and whole."""
    at = 4 + 2 * h.protected + h.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["seek"], at = frame[at : at + 100], at + 100
        if at > len(frame):
            return {}
        at += 4 * (flags >> 3 & 1)
        if frame[at : at + 4] in ENCODERS and len(frame) >= at + 24:
            trim = int.from_bytes(frame[at + 21 : at + 24], "big")
            out |= {"encoder": frame[at : at + 9].rstrip(b"\0 ").decode("latin-1"), "delay": trim >> 12, "padding": trim & 0xFFF}
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n_bytes, n_frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        if 62 + width * entries > len(frame):
            return {}
        seek = [scale * int.from_bytes(frame[62 + width * i : 62 + width * (i + 1)], "big") for i in range(entries)]
        return {"kind": "VBRI", "frames": n_frames, "bytes": n_bytes, "seek": seek}
    return {}


def read_stream(data: bytes) -> Stream:
    s = Stream()
    at, end, parts, first = _read_id3(data, s.tags), len(data), [], True
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        s.tags["ID3v1"] = data[end : end + 128]
    synced, samples, free = False, {}, {}
    kind = lambda b: b[:2] + bytes((b[2] & 0xFC,))
    while at + 4 <= end:
        b = data[at : at + 4]
        h = header(b)
        if h is None and b[:3] == b"ID3" and (behind := _read_id3(data, s.tags, at)) > at:
            at = behind
            continue
        if h is None and b[0] == 0xFF and b[1] >= 0xE0 and b[2] < 16:
            free[kind(b)] = (free.get(kind(b)) if synced else None) or _free_size(data, at, end)
            h = header(b, free[kind(b)])
        after = at + h.size if h else 0
        if h is None or after > end or not (synced or after == end or b[2] < 16 or header(data[after : after + 4]) or data[after : after + 3] == b"ID3"):
            synced, to = False, data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            s.skipped, at = s.skipped + to - at, to
            continue
        synced = True
        body = at + 4 + 2 * h.protected + h.side
        if h.protected and h.checked >= 0:
            s.bad_checksums += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.checked]) != data[at + 4] << 8 | data[at + 5]
        if first and (found := _read_table(data[at:after], h)):
            s.table = found
        else:
            s.offsets.append(at)
            s.rate = s.rate or h.rate
            samples[h.rate] = samples.get(h.rate, 0) + h.samples
            s.kbps[h.kbps] = s.kbps.get(h.kbps, 0) + 1
            parts.append(data[body:after])
        first, at = False, after
    s.skipped += max(0, end - at)
    s.samples = sum(samples.values())
    s.duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    trim = s.table.get("delay", 0) + s.table.get("padding", 0)
    s.heard = max(Fraction(0), s.duration - Fraction(trim, s.rate)) if s.rate else s.duration
    s.ancillary = b"".join(parts)
    return s


def payload_of(s: Stream) -> bytes:
    """The payload that a stream written here carries; raises if its length or checksum is wrong."""
    n, crc = struct.unpack(">QI", s.tags["PRIV"].removeprefix(OWNER))
    payload = s.ancillary[:n]
    if len(payload) != n or zlib.crc32(payload) != crc or s.bad_checksums:
        raise ValueError("the stream is damaged")
    return payload


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK)), len(data)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, the stream that holds each text's padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write_stream(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """What streams contain: durations in seconds, rate, frames, seek offsets, checks and ancillary bytes."""
    schema = "doc_id long, duration double, heard double, rate int, samples long, table_kind string, table_frames long, offsets array<long>, skipped long, bad_checksums long, ancillary binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for i, m in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    s = read_stream(m.as_py() or b"")
                    rows.append((i, float(s.duration), float(s.heard), s.rate, s.samples, s.table.get("kind"), s.table.get("frames"), s.offsets, s.skipped, s.bad_checksums, s.ancillary))
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, schema)


def feature(s: Stream) -> str:
    seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}q", *s.offsets))
    rates = ",".join(f"{k}x{n}" for k, n in sorted(s.kbps.items()))
    return f"duration={s.duration.numerator}/{s.duration.denominator};frames={len(s.offsets)};table={s.table.get('frames')};kbps={rates};seek_crc32={seek}"


def digests(docs: DataFrame) -> DataFrame:
    """Per document the figures of its stored stream and of the payload read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2):
                media = m.as_py()
                s = read_stream(media)
                back = payload_of(s)
                rows.append((len(back), sha256(back), zlib.crc32(back[-BLOCK:]), len(media), sha256(media), feature(s)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return store(docs).mapInArrow(run, SCHEMA)
