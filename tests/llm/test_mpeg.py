import hashlib
import os
import zlib

import numpy as np
import pytest

from fieldwarden.llm import mpeg
from fieldwarden.llm import mpeg as M


def frames(n, head=bytes((0xFF, 0xFB, 0x90, 0x00))):
    size = mpeg.header(head).size
    return [head + bytes(size - 4) for _ in range(n)]


def test_round_trip_of_payloads():
    for n in (0, 1, 575, 576, 577, 5000):
        raw = os.urandom(n)
        payload = raw + b"\xff" * (-n % 576 if n else 576)
        stored = mpeg.pack(payload)
        s = mpeg.read(stored)
        assert mpeg.unpack(stored, s) == payload
        assert (s.table["frames"], s.table["bytes"]) == (len(payload) // 576, len(stored))
        assert (s.bad_crc, s.checked, s.skipped) == (0, len(payload) // 576 + 1, 0)
        assert s.samples == len(payload) and s.seconds == len(payload) / 16000


def test_payload_of_sync_bytes():
    payload = b"\xff" * 5760
    stored = mpeg.pack(payload)
    assert mpeg.unpack(stored, mpeg.read(stored)) == payload


def test_known_header():
    h = mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h.version, h.layer, h.kbps, h.rate, h.channels, h.size, h.samples) == ("1", 3, 128, 44100, 2, 417, 1152)


def test_resync_tags_and_junk():
    id3 = b"ID3\x03\x00\x00" + bytes((0, 0, 0, 17)) + b"TIT2" + (7).to_bytes(4) + b"\0\0" + b"\0Song x"
    a, b = frames(3), frames(4)
    v1 = b"TAG" + b"Other".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + bytes(65)
    junk = b"\xff\xfbnoise"
    data = id3 + b"".join(a) + junk + b"".join(b) + v1
    s = mpeg.read(data)
    assert len(s.offsets) == 7 and s.skipped == len(junk)
    assert s.offsets[0] == len(id3) and s.offsets[3] == len(id3) + 3 * 417 + len(junk)
    assert s.tags["TIT2"] == "Song x" and s.tags["artist"] == "Who"
    assert s.samples == 7 * 1152


def test_broken_checksum_is_counted():
    stored = bytearray(mpeg.pack(b"x" * 1152))
    stored[648 + 7] ^= 1
    assert mpeg.read(bytes(stored)).bad_crc == 1


def test_no_frames():
    for data in (None, b"", b"\xff", b"plain text" * 50):
        s = mpeg.read(data)
        assert (s.offsets, s.samples, s.header) == ([], 0, None)


def test_vbri_and_xing():
    head = bytes((0xFF, 0xFB, 0x90, 0x00))
    f = bytearray(frames(1)[0])
    f[36:40] = b"VBRI"
    f[46:50], f[50:54] = (9000).to_bytes(4), (12).to_bytes(4)
    f[54:56], f[56:58], f[58:60] = (2).to_bytes(2), (1).to_bytes(2), (2).to_bytes(2)
    f[62:66] = (5).to_bytes(2) + (6).to_bytes(2)
    s = mpeg.read(bytes(f) + b"".join(frames(2, head)))
    assert s.table["kind"] == "VBRI" and s.table["frames"] == 12 and s.table["seek"] == [5, 6] and len(s.offsets) == 2


def test_store_and_probe(spark):
    docs = spark.createDataFrame([(1, "abc", 5), (2, None, 6), (3, "", 7), (3, "", 7), (4, "é" * 1000, 8)], "doc_id long, text string, feature int")
    rows = {r.doc_id: r for r in mpeg.store(docs).collect()}
    assert rows[1].n_bytes == 3 and rows[1].payload_bytes == 576
    assert rows[2].payload_sha256 == rows[3].payload_sha256 and rows[2].payload_bytes == 576
    assert rows[4].n_bytes == 2000 and rows[4].payload_bytes == 2304
    assert mpeg.store(docs.limit(0)).count() == 0
    media = spark.createDataFrame([(1, bytearray(mpeg.pack(b"y" * 576))), (2, None)], "doc_id long, data binary")
    seen = {r.doc_id: r for r in mpeg.probe(media).collect()}
    assert seen[1].offsets == [648] and seen[1].seconds == 0.036 and seen[2].frames == 0


def test_payload_that_looks_like_a_tag():
    for n in (1, 2, 5):
        payload = bytearray(b"x" * (576 * n))
        payload[-71:-68] = b"TAG"
        stored = mpeg.pack(bytes(payload))
        assert stored[-128:-125] == b"TAG"
        s = mpeg.read(stored)
        assert mpeg.unpack(stored, s) == payload and s.tags == {} and s.skipped == 0
        tagged = mpeg.read(stored + b"TAG" + b"Song".ljust(125, b"\0"))
        assert mpeg.unpack(stored, tagged) == payload and tagged.tags == {"title": "Song"} and tagged.skipped == 0


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_tags_planted_in_the_payload(blocks):
    rng = np.random.default_rng(blocks)
    for at in range(0, 570):
        raw = bytearray(rng.integers(0, 256, blocks * M.BLOCK).astype(np.uint8).tobytes())
        mark = (b"TAG", b"ID3", M._HEAD)[at % 3]
        raw[(blocks - 1) * M.BLOCK + at : (blocks - 1) * M.BLOCK + at + len(mark)] = mark
        payload = bytes(raw[: blocks * M.BLOCK])
        stored = M.pack(payload)
        assert M.unpack(stored, M.read(stored)) == payload, at


def test_random_texts_as_hashed_directly(spark):
    """The query's digests by hashlib and zlib alone, whatever the texts hold."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(32, 127, int(n)).astype(np.uint8)).decode() for n in rng.integers(0, 3000, 60)]
    texts += ["x" * 505 + "TAG" + "y" * 68, "z" * 576 + "x" * 505 + "TAG" + "y" * 68, "ID3" + "\x00" * 600, "é" * 1000, "w" * 3_000_000, "", None]
    big = 9007199254740993
    docs = spark.createDataFrame([(big + k, t, 1.0) for k, t in enumerate(texts)] + [(None, "no id", 1.0)], "doc_id long, text string, feature double")
    got = {r.doc_id: r for r in M.store(docs).collect()}
    for k, t in [*enumerate(texts), (None, "no id")]:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[None if k is None else big + k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
