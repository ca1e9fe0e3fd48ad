"""Document fingerprints: quartile bucket digests of byte triplets.

Each window of four bytes counts three triplets - bytes (1,2,3), (1,2,4) and (1,3,4) - in buckets chosen by a hash.
Every bucket is written as two bits: how many of the three quartiles of all counts it exceeds. The digest is the
length on a logarithmic scale (one byte) and the buckets, in hexadecimal. `likeness` compares two digests: the
differences of the bucket codes and of the length codes, as a share of the greatest possible, taken from 1.

`compare_edited` needs each row's successor by doc_id. Rows are dealt by ranges of doc_id and sorted inside them; a task
streams over its rows with one text held, so its memory does not grow with the range, and a doc_id that many rows share
is only a longer stream. The one row that meets the next range is answered by a small join of the ranges' first and last texts.

Null counts as empty text. A text of fewer than three bytes has no triplet: all its buckets are 0. Equal texts have
equal digests. A null doc_id comes first. Rows with the same doc_id follow one another by a hash of the text and the text.
A single row is its own successor. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldwarden.session import parts_of, with_checkpoint_dir

#: Buckets of a digest.
BUCKETS = 256
#: Weight of one step of the length code against one step of a bucket code.
LENGTH_STEP = 4
#: Length codes that differ by more count as this.
LENGTH_MOST = 24


def codes(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket codes, 0 to 3, of a text's bytes."""
    counts = np.zeros(buckets, np.int64)
    for start in range(0, max(0, len(raw) - 2), 1 << 18):  # in parts, so that long texts take no more memory
        part = np.frombuffer(raw, np.uint8, min(len(raw) - start, (1 << 18) + 3), start).astype(np.uint32)
        own = max(0, len(part) - 2) if start + len(part) >= len(raw) else 1 << 18
        a, b, c, d = part[:own], part[1 : own + 1], part[2 : own + 2], part[3 : own + 3]
        for x, y, z, salt in ((a, b, c, 0x9E3779B1), (a, b, d, 0x85EBCA77), (a, c, d, 0xC2B2AE3D)):
            n = min(len(x), len(y), len(z))
            h = (x[:n] << np.uint32(16) | y[:n] << np.uint32(8) | z[:n]) * np.uint32(salt)
            h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)
            counts += np.bincount((h >> np.uint32(16)) % np.uint32(buckets), minlength=buckets)
    edges = np.sort(counts)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    return (counts[:, None] > edges).sum(1).astype(np.uint8)


def length_code(n: int) -> int:
    return min(255, round(math.log(n + 1, 1.2)))


def digest(raw: bytes, buckets: int = BUCKETS) -> str:
    q = codes(raw, buckets).reshape(-1, 4)
    packed = q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]
    return f"{length_code(len(raw)):02x}" + packed.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the greatest difference."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    two = lambda v: np.stack([v >> s & 3 for s in (6, 4, 2, 0)]).astype(np.int8)
    off = int(np.abs(two(x[1:]) - two(y[1:])).sum())
    off += LENGTH_STEP * min(LENGTH_MOST, abs(int(x[0]) - int(y[0])))
    return 1.0 - off / (3 * 4 * (len(x) - 1) + LENGTH_STEP * LENGTH_MOST)


def fingerprints(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, fingerprint of every row of docs, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest((t.as_py() or "").encode(), buckets) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compared(text: str, mark: str, following: str, next_mark: str, buckets: int) -> tuple:
    changed = edited(text, following).encode()
    of_changed = digest(changed, buckets)
    return len(text), hashlib.sha256(changed).hexdigest(), mark, of_changed, likeness(mark, of_changed), likeness(mark, next_mark)


def _streamed(id_type: pa.DataType, buckets: int):
    """mapInArrow function over sorted ranges: every row's result but the last one's, and the range's first and last text."""
    names = ["doc_id", *_NAMES, "place", "first", "last"]
    kinds = (id_type, *_KINDS, pa.int32(), pa.string(), pa.string())

    def rows(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Scalar, str, str] | None = None  # the row that waits for its successor: doc_id, text, digest
        first = ""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            marks = [digest(t.encode(), buckets) for t in texts]
            out = [_compared(texts[k], marks[k], texts[k + 1], marks[k + 1], buckets) for k in range(len(texts) - 1)]
            done = ids.slice(0, len(texts) - 1)
            if held:
                out.insert(0, _compared(held[1], held[2], texts[0], marks[0], buckets))
                done = pa.concat_arrays([pa.array([held[0]], id_type), done])
            else:
                first = texts[0]
            n = len(out)
            if n:
                yield rows([done, *(list(c) for c in zip(*out, strict=True)), [None] * n, [None] * n, [None] * n])
            held = ids[len(texts) - 1].as_py(), texts[-1], marks[-1]
        if held:
            yield rows([[held[0]], *[[None]] * len(_NAMES), [TaskContext.get().partitionId()], [first], [held[1]]])

    return run


def compare_edited(docs: DataFrame, buckets: int = BUCKETS, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next row's."""
    with_checkpoint_dir(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash, as the driver samples the keys to find the ranges
    sorted_rows = rows.repartitionByRange(ranges or parts_of(rows), *keys).sortWithinPartitions(*keys, "text")
    # written once, so that ranges and results are of one run; the texts of the ranges' ends are all that it holds of the texts
    found = sorted_rows.mapInArrow(_streamed(id_type, buckets), f"doc_id {kind}, {RESULT}, place int, first string, last string").checkpoint()
    ends = found.where("place is not null")
    places = sorted(r.place for r in ends.select("place").collect())  # a number for each range that has rows
    follows = docs.sparkSession.createDataFrame(list(zip(places, [*places[1:], *places[:1]], strict=True)), "place int, after int")
    heads = ends.select(F.col("place").alias("after"), F.col("first").alias("following"))
    last = ends.select("doc_id", "last", "place").join(follows, "place").join(heads, "after").select("doc_id", "last", "following")

    def at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("last").to_pylist(), batch.column("following").to_pylist(), strict=True)
            out = [_compared(t, digest(t.encode(), buckets), f, digest(f.encode(), buckets), buckets) for t, f in texts]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_NAMES])

    rest = last.mapInArrow(at_ends, f"doc_id {kind}, {RESULT}")
    return found.where("place is null").select("doc_id", *_NAMES).unionByName(rest)
