"""MPEG audio: byte payloads as valid streams, and a parser with exact durations and seek offsets.

``wrap`` stores bytes losslessly in the ancillary data of silent, checksummed Layer III frames of one
size (192 payload bytes each), after an ID3 tag with the payload's length and a frame with
the variable-bitrate table. ``parse`` reads any MPEG-1, 2 or 2.5 stream of Layers I to III: it skips and reads tags, finds
frame headers again after foreign bytes, reads Xing, Info and VBRI tables, verifies frame checksums,
and returns the exact duration and every frame's offset, which are stored beside the stream. Damaged and cut tags, tables and frames are skipped; of a stream without frames the feature says so.

Nulls, ties, repeats: a null text is an empty one and an empty payload is 192 spaces; equal texts give
equal streams. An empty table gives an empty result. Streams are processed one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import Scratch, sliced
from pellucid.llm.encoding import chunks

UNIT = 192
#: Fixed values of the format: kbit/s by (MPEG-1 or not, layer), Hz by version bits, samples of a frame.
RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    kbps: int
    hz: int
    samples: int
    size: int
    mono: bool
    crc: bool

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """A frame header, or None if the bytes aren't one with a known frame size."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, hz = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or four[3] & 3 == 2:
        return None
    key, pad = (version == 3, layer), four[2] >> 1 & 1
    kbps, hertz = RATES[key][rate - 1], HZ[version][hz]
    size = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else SAMPLES[key] // 8 * kbps * 1000 // hertz + pad
    return Header(version, layer, kbps, hertz, SAMPLES[key], size, four[3] >> 6 == 3, not four[1] & 1)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, first value 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    headers: Counter = field(default_factory=Counter)
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0
    skipped: int = 0
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)

    @property
    def duration(self) -> Fraction:
        """Exact seconds."""
        return sum((Fraction(h.samples * n, h.hz) for h, n in self.headers.items()), Fraction(0))

    @property
    def samples(self) -> int:
        return sum(h.samples * n for h, n in self.headers.items())


def _syncsafe(b: bytes) -> int:
    """Seven bits of each of four bytes; missing ones count as zero."""
    b = b.ljust(4, b"\0")
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _big(data: bytes, at: int, n: int = 4) -> int:
    return int.from_bytes(data[at : at + n].ljust(n, b"\0"), "big")


def _text(b: bytes) -> str:
    return b[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0], "latin-1"), "replace") if b else ""


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Reads a tag's text frames; returns where it ends."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end, p = min(len(data), at + 10 + size), at + 10
    if flags & 0x40:
        p += _syncsafe(data[p : p + 4]) if major == 4 else _big(data, p) + 4
    head = 6 if major == 2 else 10
    while p + head <= end and data[p]:
        name = data[p : p + (3 if major == 2 else 4)].decode("latin-1")
        length = _big(data, p + 3, 3) if major == 2 else _syncsafe(data[p + 4 : p + 8]) if major == 4 else _big(data, p + 4)
        body = data[p + head : min(end, p + head + length)]
        if name.startswith("T"):
            value = _text(body)
            key, _, rest = value.partition("\0")
            tags[f"{name}:{key}" if name in ("TXXX", "TXX") else name] = (rest if name in ("TXXX", "TXX") else value).rstrip("\0")
        p += head + max(0, length)
    return end + (10 if flags & 0x10 else 0)


def _id3v1(tail: bytes, tags: dict) -> None:
    for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
        tags[name] = tail[lo:hi].split(b"\0")[0].decode("latin-1").strip()


def _vbr_table(data: bytes, at: int, h: Header) -> dict:
    """The variable-bitrate table in a frame, if it has one."""
    for p in {at + 4 + h.side, at + 4 + h.side + 2 * h.crc}:
        if data[p : p + 4] in (b"Xing", b"Info"):
            out, flags, q = {"kind": data[p : p + 4].decode()}, _big(data, p + 4), p + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], q = _big(data, q), q + 4
            if flags & 4:
                out["toc"] = list(data[q : q + 100])
            return out
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        size, frames, n, scale, width, per = struct.unpack(">IIHHHH", data[p + 10 : p + 26].ljust(16, b"\0"))
        points = [_big(data, p + 26 + i * width, width) * scale for i in range(n) if p + 26 + (i + 1) * width <= len(data)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "points": points, "frames_per_point": per}
    return {}


def _next_sync(data: bytes, at: int, end: int) -> int:
    """The next header that another compatible header or the end follows."""
    while (at := data.find(b"\xff", at, end)) >= 0:
        h = header(data[at : at + 4])
        if h and at + h.size <= end:
            after = at + h.size
            g = header(data[after : after + 4])
            if after == end or g and (g.version, g.layer, g.hz) == (h.version, h.layer, h.hz):
                return at
        at += 1
    return end


def _runs(data: bytes, at: int, end: int) -> bool:
    """Whether whole frames run from here to the very end."""
    while at < end and (h := header(data[at : at + 4])):
        at += h.size
    return at == end


def parse(data: bytes) -> Stream:
    out, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(data, at, out.tags)
    if tagged := end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128  # unless the bytes turn out to be a frame's
    first, lost = True, False
    while at < end:
        h = header(data[at : at + 4])
        if tagged and h and at + h.size > end and _runs(data, at, end + 128):
            end, tagged = end + 128, False
        if h is None or at + h.size > end or first and not lost and _next_sync(data, at, end) != at:
            found = _next_sync(data, at + (h is not None), end)
            if tagged and found == end and (other := _next_sync(data, at + (h is not None), end + 128)) < end and _runs(data, other, end + 128):
                found, end, tagged = other, end + 128, False
            out.skipped += found - at
            out.resyncs += found < end
            at, lost = found, True
            continue
        if first and h.layer == 3:
            out.table = _vbr_table(data, at, h)
        if not (first and out.table):
            out.offsets.append(at)
            out.headers[h] += 1
            if h.crc and h.layer == 3:
                out.checked += 1
                out.damaged += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        first = False
        at += h.size
    if tagged:
        _id3v1(data[end:], out.tags)
    return out


#: The frames written here: MPEG-1 Layer III, 80 kbit/s, 48,000 Hz, mono, 240 bytes; with and without checksum.
PROTECTED, PLAIN = bytes((0xFF, 0xFA, 0x64, 0xC0)), bytes((0xFF, 0xFB, 0x64, 0xC0))
SIZE, SIDE = 240, bytes(17)
HEAD = PROTECTED + crc16(PROTECTED[2:] + SIDE).to_bytes(2, "big") + SIDE
FILL = bytes(SIZE - len(HEAD) - UNIT)


def wrap(payload: bytes, length: int | None = None) -> bytes:
    """A stream that carries a payload of a multiple of 192 bytes; length: of the payload without padding."""
    n = len(payload) // UNIT
    body = b"\x00payload\x00" + str(len(payload) if length is None else length).encode()
    tag = b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body
    tag = b"ID3\x03\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag
    toc = bytes(min(255, (SIZE + i * n // 100 * SIZE) * 256 // (SIZE * (n + 1))) for i in range(100))
    info = (PLAIN + SIDE + b"Info" + struct.pack(">III", 7, n, SIZE * (n + 1)) + toc).ljust(SIZE, b"\0")
    join = FILL + HEAD
    return tag + info + HEAD + join.join([payload[i : i + UNIT] for i in range(0, len(payload), UNIT)]) + FILL


def unwrap(data: bytes, stream: Stream) -> bytes:
    """The payload that the stream's frames carry."""
    begin = len(HEAD)
    return b"".join([data[o + begin : o + begin + UNIT] for o in stream.offsets])


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def feature(s: Stream) -> str:
    """What the stream says; of one without frames, that there are none."""
    d, n = s.duration, len(s.offsets)
    if not n:
        return f"frames=0;samples=0;seconds=0/1;table={s.table.get('kind', '')}:{s.table.get('frames', '')};resyncs={s.resyncs}"
    seek = zlib.crc32(struct.pack(f"<{n}Q", *s.offsets))
    h = next(iter(s.headers))
    return f"layer={h.layer};hz={h.hz};frames={n};samples={s.samples};seconds={d.numerator}/{d.denominator};table={s.table.get('kind', '')}:{s.table.get('frames', '')};crc_ok={s.checked - s.damaged};resyncs={s.resyncs};seek={s.offsets[0]},{s.offsets[n // 2]},{s.offsets[-1]};seek_crc32={seek}"


#: A stream, its exact duration (samples / hz seconds) and where its frames begin.
STORED = "doc_id long, media binary, samples long, hz int, seek_offsets array<long>"


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for lo, hi in chunks(texts, 4_000_000):
            raw = [t.encode() for t in texts[lo:hi]]
            media = [wrap(padded(r), len(r)) for r in raw]
            parsed = [parse(m) for m in media]
            cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(media, pa.binary()), pa.array([s.samples for s in parsed], pa.int64()), pa.array([next(iter(s.headers)).hz for s in parsed], pa.int32()), pa.array([s.offsets for s in parsed], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in STORED.split(", ")])


def store(docs: DataFrame) -> DataFrame:
    """Each text as the payload of an MPEG audio stream, with the stream's duration and every frame's offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_store, STORED)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, samples long, frames long, seek_offsets array<long>"


def _load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, data, samples, offsets in zip(batch.column("doc_id").to_pylist(), batch.column("media"), batch.column("samples").to_pylist(), batch.column("seek_offsets")):
            data = data.as_py()
            s = parse(data)
            payload = unwrap(data, s)
            length = int(s.tags["TXXX:payload"])
            if len(payload) != max(1, -(-length // UNIT)) * UNIT or samples != s.samples or offsets.as_py() != s.offsets:
                raise ValueError(f"the stream of document {doc_id} holds {len(payload)} bytes of a payload of {length}, or isn't as its index says")
            rows.append((doc_id, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), float(s.duration), s.samples, len(s.offsets), s.offsets))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in READ.split(", ")])


def load(media: DataFrame) -> DataFrame:
    """What the stored streams say and carry; they are parsed again and held against the stored durations and offsets."""
    return media.mapInArrow(_load, READ)


def media_table(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Stores each text as audio in a shared table and reads the table back."""
    return load(scratch.save(store(docs)))
