"""SimHash near-dedup by the similarity of shingle sets: by default five words and a Jaccard similarity of 0.8 or more.

The 64-bit contract of simhash.py links fingerprints 4 bits apart, which a similarity of 0.8 rarely reaches. Here a text's
fingerprint has 256 bits, and one text in 64-bit terms 10 bits away is about 39 of 256 bits away, with a spread of 6; a radius
of 56 bits misses about two such pairs in a thousand. In small sets the majority moves more bits (48 of 256 from four
shingles to the same and one more), so that sets of few shingles have a wider radius. Fingerprints meet in groups by bands of minima over their shingle
hashes: 16 bands of 4 minima miss two pairs in ten thousand at a similarity of 0.8, and fewer above. Inside a group they
are compared tile by tile with exclusive-or and bit counts as in simhash.py, hot groups cut into pairs of parts.

A unit returns a spanning forest of its links that takes the closest pairs first, so that the links it leaves out are
those between texts that closer links join already. Every link of a forest is then held against the two texts' whole
shingle sets, and only those of the wanted similarity count: nothing is removed on a fingerprint's word alone. Where that
leaves the texts of a unit in several components, all its pairs across them are held against the whole sets in the unit, which
gets the sets of just these texts. So a pair is left out only if its bands or its distance miss it.

Texts of equal shingle sets are one vertex (a 64-bit hash of the sorted set). Null and empty texts, and texts of white
space, have the empty set and are copies of each other; a text of fewer words has one shingle, all of it. Rows of a null
doc_id, repeated rows and extra columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm import hashing, simhash
from fieldwarden.session import with_checkpoint_dir

WORDS, SIMILARITY = 5, 0.8
LANES, RADIUS = 4, 56
BANDS, ROWS = 16, 4
#: Sets of so many shingles at most, and their radius: by binomial calculation it misses fewer than one pair in 100,000 at a similarity of 0.8.
SHORT = ((64, 72), (4, 80))
#: Members of a group that one part has: a unit holds two parts, at most 8.4 million pairs.
TILE, MOST = 512, 2048

_seeded = np.random.default_rng(simhash.SEED)
_LANE = _seeded.integers(1, 1 << 63, LANES, dtype=np.uint64)
_FACTOR = _seeded.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _seeded.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(text, words)]))


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint as LANES unsigned longs, and the hashes of the bands, of a shingle set."""
    total, low = np.zeros(64 * LANES, np.int64), np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 1 << 12):
        part = own[at : at + (1 << 12), None]
        bits = hashing.mix(part + _LANE).astype(">u8").view(np.uint8).reshape(-1, 8 * LANES)
        total += np.unpackbits(bits, axis=1).sum(0, dtype=np.int32)
        np.minimum(low, (part * _FACTOR + _PLUS).min(0), out=low)
    lanes = np.frombuffer(np.packbits(2 * total > len(own)).tobytes(), ">u8").astype(np.uint64)
    return lanes, np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_row, the vertex v, the size of its shingle set, the fingerprint's lanes f0, f1 ... and the bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            v = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64)
            made = [signature(s) for s in sets]
            lanes = np.array([m[0] for m in made], np.uint64).reshape(-1, LANES).view(np.int64)
            bands = np.array([m[1] for m in made], np.uint64).reshape(-1).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands))
            columns = [batch.column("_row"), pa.array(v.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(lanes[:, k])) for k in range(LANES)], listed]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "v", "size", *_lanes(), "bands"])

    keyed = docs.select(simhash.row_key().alias("_row"), "text")
    kinds = ", ".join(f"{c} long" for c in ["v", "size", *_lanes()])
    return keyed.mapInArrow(run, f"_row {keyed.schema['_row'].dataType.simpleString()}, {kinds}, bands array<long>")


def _lanes() -> list[str]:
    return [f"f{k}" for k in range(LANES)]


def reach(size: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The radius of sets by their number of shingles; a pair takes the wider one."""
    out = np.full(len(size), radius, np.uint16)
    for most, wider in SHORT:
        out[size <= most] = max(radius, wider)
    return out


def pairs(fps: np.ndarray, radius: int | np.ndarray = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and distances of all pairs of fingerprints within the radius (one for all or of each); the rows of fps are sorted by bit count."""
    own = np.broadcast_to(np.asarray(radius, np.uint16), len(fps))
    widest = int(own.max(initial=0))
    count = np.bitwise_count(fps).sum(1, dtype=np.int64)
    left, right, apart = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.uint16)]
    for i in range(0, len(fps), tile):
        a, most = fps[i : i + tile], int(count[min(i + tile, len(fps)) - 1])
        for j in range(i, len(fps), tile):
            if int(count[j]) - most > widest:
                break  # and so are all later tiles
            b = fps[j : j + tile]
            d = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.uint16) for k in range(fps.shape[1]))
            x, y = np.nonzero(d <= np.maximum(own[i : i + tile, None], own[None, j : j + tile]))
            keep = x + i < y + j
            x, y = x[keep], y[keep]
            left.append((x + i).astype(np.int32))
            right.append((y + j).astype(np.int32))
            apart.append(d[x, y])
    return np.concatenate(left), np.concatenate(right), np.concatenate(apart)


def closest_forest(n: int, left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the pairs of a spanning forest of 0 .. n-1 that takes the closest pairs first."""
    order = np.argsort(apart, kind="stable")
    cuts = np.flatnonzero(np.diff(apart[order], prepend=-1, append=1 << 16))
    label, taken = np.arange(n), [np.empty(0, np.int64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        level = order[a:b]
        while True:
            x, y = label[left[level]], label[right[level]]
            level, x, y = level[x != y], x[x != y], y[x != y]
            if not len(level):
                break
            high, at = np.unique(np.maximum(x, y), return_index=True)
            taken.append(level[at])
            root = np.arange(n)
            root[high] = np.minimum(x, y)[at]  # below it, so there is no ring
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
    return np.concatenate(taken)


def _by_unit(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Unit, fingerprints by bit count and the named columns, of each unit of two or more members."""
    held = [[b.column(c).to_numpy() for c in ("unit", "v", *names, *_lanes())] for b in batches]
    if not held:
        return
    unit, v, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
    columns, fps = [v, *rest[: len(names)]], np.stack(rest[len(names) :], axis=1).view(np.uint64)
    order = np.lexsort((v, np.bitwise_count(fps).sum(1, dtype=np.int64), unit))
    unit, fps, columns = unit[order], fps[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    ends = np.append(starts[1:], len(unit))
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        yield int(unit[a]), fps[a:b], [c[a:b] for c in columns]


def _unit_edges(radius: int, tile: int):
    """mapInArrow function over whole partitions of units: the forest edges of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fps, (v, size) in _by_unit(batches, ["size"]):
            left, right, apart = pairs(fps, reach(size, radius), tile)
            if len(left):
                at = closest_forest(len(v), left, right, apart)
                yield pa.RecordBatch.from_arrays([pa.array(v[left[at]]), pa.array(v[right[at]])], ["a", "b"])

    return run


def across(size: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs are of two components and of sizes that allow the similarity."""
    less, more = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    return (label[left] != label[right]) & (less >= similarity * more * (1 - 1e-9))


def _open_members(radius: int, tile: int, similarity: float):
    """mapInArrow function over whole partitions of units: the members with a pair across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, fps, (v, size, label) in _by_unit(batches, ["size", "label"]):
            if (label == label[0]).all():
                continue
            left, right, _ = pairs(fps, reach(size, radius), tile)
            cross = across(size, label, left, right, similarity)
            at = np.unique(np.concatenate([left[cross], right[cross]]))
            if len(at):
                columns = [np.full(len(at), unit), v[at], size[at], label[at], *fps[at].view(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["unit", "v", "size", "label", *_lanes()])

    return run


def joined_across(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Labels a, b that links of the similarity join, each pair of sets held until its labels are joined."""
    names, root = np.unique(label, return_inverse=True)
    name, out = root.copy(), []
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    codes, own = np.split(code, ends[:-1]), np.zeros(len(values), bool)
    order = np.argsort(left, kind="stable")
    first, at = np.unique(left[order], return_index=True)
    for i, others in zip(first.tolist(), np.split(right[order], at[1:]), strict=True):
        own[codes[i]] = True
        for cut in range(0, len(others), 256):
            js = others[cut : cut + 256]
            js = js[root[js] != root[i]]
            if not len(js):
                continue
            sizes = np.array([len(codes[j]) for j in js])
            shared = np.add.reduceat(own[np.concatenate([codes[j] for j in js])], np.cumsum(sizes) - sizes, dtype=np.int64)
            for j in js[shared / (len(codes[i]) + sizes - shared) >= similarity].tolist():
                if root[j] != root[i]:
                    out.append((int(names[name[i]]), int(names[name[j]])))
                    root[root == root[j]] = root[i]
        own[codes[i]] = False
    return out


def _unit_links(radius: int, tile: int, similarity: float):
    """applyInArrow function over a unit whose members come with their shingle sets."""

    def run(table: pa.Table) -> pa.Table:
        batches = table.combine_chunks().to_batches()
        found = {v: s for v, s in zip(table.column("v").to_pylist(), table.column("own").to_pylist(), strict=True)}
        edges: list[tuple[int, int]] = []
        for _, fps, (v, size, label) in _by_unit(iter(batches), ["size", "label"]):
            left, right, _ = pairs(fps, reach(size, radius), tile)
            cross = across(size, label, left, right, similarity)
            if cross.any():
                edges += joined_across([np.frombuffer(found[k], np.uint64) for k in v.tolist()], label, left[cross], right[cross], similarity)
        return pa.table([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def confirmed(edges: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The edges a, b whose texts (columns v, text) have shingle sets of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = zip(batch.column("text_a"), batch.column("text_b"), strict=True)
            keep = [likeness(shingle_set(x.as_py(), words), shingle_set(y.as_py(), words)) >= similarity for x, y in two]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
    return edges.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """v and own, the shingle set as bytes, of texts (columns v, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("v"), sets], ["v", "own"])

    return texts.select("v", "text").mapInArrow(run, "v long, own binary")


def left_apart(rows: DataFrame, joined: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int, most: int, tile: int) -> DataFrame:
    """Edges between the components (joined: v, root) that candidate pairs outside the forests join; rows: the group members with links."""
    named = rows.join(joined, "v", "left").select(*rows.columns, F.coalesce("root", "v").alias("label"))
    kinds = ", ".join(f"{c} long" for c in ["unit", "v", "size", "label", *_lanes()])
    # parts are smaller here, as a member brings its whole set
    members = simhash.units(named, "v", max(1, most // 4)).mapInArrow(_open_members(radius, tile, similarity), kinds).checkpoint()
    own = shingle_sets(texts.join(members.select("v").distinct(), "v", "left_semi"), words)
    return members.join(own, "v").groupBy("unit").applyInArrow(_unit_links(radius, tile, similarity), "a long, b long")


def roots(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, most: int = MOST, tile: int = TILE) -> DataFrame:
    """v, least (the least row_key of its copies) and root of every distinct shingle set of docs; near copies share a root."""
    with_checkpoint_dir(docs.sparkSession)
    some = [F.min(c).alias(c) for c in ["size", *_lanes(), "bands"]]  # the same in all rows of a vertex
    vertices = signatures(docs, words).groupBy("v").agg(F.min("_row").alias("least"), *some).checkpoint()
    banded = lambda own: own.select("v", "size", *_lanes(), F.posexplode("bands").alias("band", "low")).select("v", "size", *_lanes(), F.xxhash64("band", "low").alias("group"))
    found = simhash.units(banded(vertices), "v", most, 2 * BANDS * vertices.count()).mapInArrow(_unit_edges(radius, tile), "a long, b long")
    edges = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    linked = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    wanted = vertices.join(linked, "v", "left_semi")
    texts = docs.select(simhash.row_key().alias("least"), "text").join(wanted.select("v", "least"), "least").groupBy("v").agg(F.min("text").alias("text"))
    joined = simhash.components(confirmed(edges, texts, words, similarity)).checkpoint()
    more = left_apart(banded(wanted), joined, texts, words, similarity, radius, most, tile).distinct().checkpoint()
    if not more.isEmpty():
        stars = joined.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))
        joined = simhash.components(stars.union(more)).checkpoint()
    return vertices.select("v", "least").join(joined, "v", "left").select("v", "least", F.coalesce("root", "v").alias("root"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, with all its columns, of each group of near copies: that with the least doc_id (null last)."""
    kept = roots(docs, words, similarity).groupBy("root").agg(F.min("least").alias("_row"))
    return simhash.rows_of(docs, kept)
