"""Media columns: MPEG audio in a binary column, read frame by frame without decoding sound.

`read` parses ID3v1 and ID3v2 tags, resynchronises on frame headers (a header counts when another one
of the same stream, a tag or the end follows where its frame ends), reads the Xing/Info and VBRI
tables, verifies the CRC-16 of protected frames, and keeps the exact duration in samples and the byte
offset of every frame. `probe` applies it to a DataFrame in one pass; each row is read alone.

`pack` stores a payload losslessly: each block of 576 bytes is the ancillary data of one MPEG-2 Layer III
frame of 576 samples (16 kHz, mono, 144 kbit/s, CRC on) whose sound is silence, behind an Info frame with the
frame count, the byte count and the seek table. `unpack` reads the payload back from the frames found.

Null bytes, empty bytes and bytes without a frame give a stream of no frames and duration 0. Junk before,
between and after frames is skipped and counted. An ID3v1 tag is one only where the last frame does not span it. Repeated rows give equal results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Samples, and payload bytes, of a frame that `pack` writes.
BLOCK = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer) and header index, Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int  # bytes of the frame, header included
    samples: int
    side: int  # bytes of side information (Layer III)


@dataclass
class Stream:
    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    bad_crc: int = 0
    checked: int = 0
    skipped: int = 0
    kbps: set[int] = field(default_factory=set)
    table: dict = field(default_factory=dict)  # of the Xing, Info or VBRI frame
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return self.samples / self.header.rate if self.header else 0.0


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format streams (bit-rate index 0) are not read."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    b, r = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or b in (0, 15) or r == 3:
        return None
    kbps, rate, pad, mono = BITRATES[version == "1", layer][b], RATES[version][r], four[2] >> 1 & 1, four[3] >> 6 == 3
    slot = 4 if layer == 1 else 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == "1" else 576
    size = (samples * kbps * 1000 // (8 * slot) // rate + pad) * slot
    side = 0 if layer < 3 else (17 if mono else 32) if version == "1" else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, kbps, rate, 1 if mono else 2, size, samples, side)


@lru_cache(1 << 14)
def crc16(covered: bytes) -> int:
    """The CRC of ISO/IEC 11172-3: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for byte in covered:
        c ^= byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads the text frames of a leading ID3v2 tag; the bytes that it takes."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    end = min(len(data), 10 + _syncsafe(data[6:10]))
    at = 10
    while data[3] >= 3 and at + 10 <= end and data[at : at + 4].isalnum():
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + size)]
        if data[at : at + 1] == b"T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[data[at : at + 4].decode("ascii")] = body[1:].decode(coding, "replace").rstrip("\0")
        at += 10 + size
    return end + 10 * (data[5] >> 4 & 1)


def _id3v1(data: bytes, tags: dict[str, str]) -> int:
    """Reads a trailing ID3v1 tag; where it starts, or the end of the data."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data)
    for name, (a, b) in {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}.items():
        if text := data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip():
            tags.setdefault(name, text)
    return len(data) - 128


def _vbr_table(frame: bytes, h: Header) -> dict:
    """The Xing, Info or VBRI table of a stream's first frame; empty if it has none."""
    for at in (4 + h.side, 6 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            out: dict = {"kind": frame[at : at + 4].decode()}
            flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
            for bit, name, width in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100), (8, "quality", 4)):
                if flags & bit:
                    part, at = frame[at : at + width], at + width
                    out[name] = list(part) if name == "seek" else int.from_bytes(part)
            return out
    if frame[36:40] == b"VBRI":
        entries, scale, width = (int.from_bytes(frame[a : a + 2]) for a in (54, 56, 58))
        steps = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width]) * scale for k in range(entries)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50]), "frames": int.from_bytes(frame[50:54]), "seek": steps}
    return {}


def read(data: bytes | None) -> Stream:
    out = Stream()
    data = data or b""
    trailing: dict[str, str] = {}
    at, end = _id3v2(data, out.tags), _id3v1(data, trailing)
    synced = False
    while at + 4 <= end:
        h, first = header(data[at : at + 4]), out.header
        whole = h is not None and at + h.size == len(data)  # then TAG near the end is a part of this frame
        fits = h is not None and (whole or at + h.size <= end) and (first is None or (h.version, h.layer, h.rate) == (first.version, first.layer, first.rate))
        if fits and not synced:
            after = header(data[at + h.size : at + h.size + 4])
            fits = whole or at + h.size == end or after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        if not fits:
            synced = False
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        synced = True
        if whole:
            end, trailing = len(data), {}
        if h.protected and h.layer == 3:
            out.checked += 1
            out.bad_crc += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6])
        if first is None:
            out.header = h
            if table := _vbr_table(data[at : at + h.size], h):
                out.table = table | {"offset": at}
                at += h.size
                continue
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.samples += h.samples
        out.kbps.add(h.kbps)
        at += h.size
    out.skipped += max(0, end - at)
    for name, text in trailing.items():
        out.tags.setdefault(name, text)
    return out


#: The header that `pack` writes, and what a frame holds before its payload.
_HEAD = bytes((0xFF, 0xF2, 0xD8, 0xC0))
_FRAME = header(_HEAD)
_LEAD = _HEAD + crc16(_HEAD[2:] + bytes(_FRAME.side)).to_bytes(2) + bytes(_FRAME.side)


def pack(payload: bytes) -> bytes:
    """The payload, a multiple of 576 bytes, as a stream of frames behind an Info frame."""
    n = len(payload) // BLOCK
    frames = np.zeros((n + 1, _FRAME.size), dtype=np.uint8)
    frames[:, : len(_LEAD)] = np.frombuffer(_LEAD, np.uint8)
    frames[1:, len(_LEAD) : len(_LEAD) + BLOCK] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    seek = bytes(256 * (1 + n * k // 100) // (n + 1) for k in range(100))
    info = b"Info" + (15).to_bytes(4) + n.to_bytes(4) + frames.size.to_bytes(4) + seek + bytes(4)
    frames[0, len(_LEAD) : len(_LEAD) + len(info)] = np.frombuffer(info, np.uint8)
    return frames.tobytes()


def unpack(data: bytes, stream: Stream) -> bytes:
    return b"".join([data[a + len(_LEAD) : a + len(_LEAD) + BLOCK] for a in stream.offsets])


def feature(s: Stream) -> str:
    """What a stream is, in one line; seek: the digest of all frame offsets."""
    if not s.header:
        return f"no frames; {s.skipped} bytes skipped"
    h, seek = s.header, hashlib.sha256(np.array(s.offsets, "<u8").tobytes()).hexdigest()[:16]
    rates = "-".join(map(str, sorted({min(s.kbps, default=h.kbps), max(s.kbps, default=h.kbps)})))
    return (
        f"MPEG-{h.version} Layer {h.layer}, {h.rate} Hz, {h.channels} ch, {rates} kbit/s; frames {len(s.offsets)}, samples {s.samples}, "
        f"seconds {s.seconds:.6f}; crc {s.checked - s.bad_crc}/{s.checked}; skipped {s.skipped}; table {s.table.get('kind', 'none')}; seek {seek}"
    )


def probe(media: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """A row for each row of a table with media bytes: key, version, layer, rate, channels, frames, seconds, checksums, tags and every frame's offset."""
    schema = (
        f"{key} {media.schema[key].dataType.simpleString()}, version string, layer int, rate int, channels int, frames long, samples long, seconds double, "
        "crc_checked long, crc_bad long, skipped long, vbr_table string, tags map<string,string>, offsets array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                s = read(value.as_py())
                h = s.header
                rows.append([h and h.version, h and h.layer, h and h.rate, h and h.channels, len(s.offsets), s.samples, s.seconds, s.checked, s.bad_crc, s.skipped, s.table.get("kind"), list(s.tags.items()), s.offsets])
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = [c.split()[0] for c in schema.split(", ")]
    types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields]
    return media.select(key, data).mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """Every text as a media stream: the digests of the payload as read back and of the stored bytes, and the stream's feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column("text"):
                raw = value.as_py() or b""
                stored = pack(raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK))
                stream = read(stored)
                payload = unpack(stored, stream)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stream)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(run, out)
