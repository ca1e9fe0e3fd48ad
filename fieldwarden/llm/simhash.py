"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

A fingerprint's bit is set if over half of the text's shingle hashes (XXH64, seed 42) have it. Texts link when their
fingerprints differ in at most `radius` bits; a component is what links reach.

Equal fingerprints are one vertex. Two fingerprints within radius r agree in at least k of r + k blocks of their bits, so
each fingerprint goes to one group for every choice of k blocks, and every linked pair meets in some group: nothing is
lost. In a group the fingerprints, sorted by population count, are compared tile by tile with exclusive-or and bit
counts; tile pairs whose population counts differ by more than the radius are skipped. A group larger than `most` is cut
into parts, and each pair of parts is a unit of its own, so no task gets a whole hot group. A unit returns a spanning
forest of its links and not all pairs; each tile is folded into it at once, so that a dense unit takes no more memory. Components
come from alternating large-star and small-star steps on these edges. Vertices are ordered by their least doc_id, so that a
component's root is its answer and nothing is gathered by component.

Null and empty texts, and texts of white space, have fingerprint 0 and link like any other. Rows with a null doc_id take
part; a component with no doc_id has a null id. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwarden.session import shuffle_partitions, with_checkpoint_dir

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints compared at once, and those of a group that one task takes.
TILE, MOST = 1024, 16_384
#: Members of a group, on average, from which a finer choice of blocks is taken.
GROUP = 2_000


def shingle_hashes(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, repeats included, at most 32,768 at once."""
    parts = (text or "").encode().lower().split()  # of bytes: only A-Z become lower case, and only the ASCII white space splits
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[len(parts) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n).tobytes())


def row_key() -> Column:
    """A key of rows by which those of null or equal doc_ids can be told apart: doc_id (null last) and a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of blocks, for n fingerprints."""
    for kept in range(1, 65 - radius):
        blocks = radius + kept
        edges = [64 * k // blocks for k in range(blocks + 1)]
        own = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
        if n / 2 ** min(sum(x.bit_count() for x in sorted(own)[:kept]), 64 * kept // blocks) <= GROUP or kept == 4:
            return [sum(own[k] for k in choice) for choice in combinations(range(blocks), kept)]
    return [(1 << 64) - 1]


def tiles(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of fingerprints within the radius, of one pair of tiles at a time; fps (uint64) are sorted by population count."""
    count = np.bitwise_count(fps)
    for i in range(0, len(fps), tile):
        a, most = fps[i : i + tile], int(count[min(i + tile, len(fps)) - 1])
        for j in range(i, len(fps), tile):
            if int(count[j]) - most > radius:
                break  # and so are all later tiles
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fps[None, j : j + tile]) <= radius)
            keep = x + i < y + j
            yield x[keep] + i, y[keep] + j


def pairs(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tiles() together."""
    found = list(tiles(fps, radius, tile))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *(x for x, _ in found)]), np.concatenate([empty, *(y for _, y in found)])


def merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the components of pairs; label leads from each index to the least one of its component."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def forest(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """The least index that each fingerprint is linked to, over steps; tile by tile, so that the pairs are never held together."""
    label = np.arange(len(fps))
    for left, right in tiles(fps, radius, tile):
        merge(label, left, right)
    return label


def _unit_edges(radius: int, tile: int):
    """mapInArrow function over whole partitions of (unit, v): the forest edges of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        unit, v = table.column("unit").to_numpy(), table.column("v").combine_chunks()
        fp = v.field("fp").to_numpy().view(np.uint64)
        order = np.lexsort((fp, np.bitwise_count(fp), unit))
        unit, fp = unit[order], fp[order]
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)], strict=True):
            if b - a < 2:
                continue
            root = forest(fp[a:b], radius, tile)
            moved = np.flatnonzero(root != np.arange(b - a))
            if len(moved):
                yield pa.RecordBatch.from_arrays([v.take(pa.array(order[a + moved])), v.take(pa.array(order[a + root[moved]]))], ["a", "b"])

    return run


def links(vertices: DataFrame, n: int, radius: int = RADIUS, most: int = MOST, tile: int = TILE) -> DataFrame:
    """Edges a, b that join all linked ones of n vertices (column v, a struct with fp in it)."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    own = masks(n, radius)
    keys = [F.struct(F.lit(k).alias("c"), F.col("v.fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for k, m in enumerate(own)]
    rows = vertices.select("v", F.explode(F.array(*keys)).alias("key")).select("v", F.xxhash64("key.c", "key.bits").alias("group"))
    kind = vertices.schema["v"].dataType.simpleString()
    return units(rows, "v", most, n * len(own)).mapInArrow(_unit_edges(radius, tile), f"a {kind}, b {kind}")


def units(rows: DataFrame, member: str, most: int, size: int = 0) -> DataFrame:
    """Rows of groups, dealt by column unit: a group of more than `most` members is cut, and each pair of its parts is a unit.

    size: about how many rows there are, so that a partition has a million of them at most on average.
    """
    large = rows.groupBy("group").count().where(F.col("count") > most).select("group", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    cut = rows.join(large, "group", "left").withColumn("own", F.pmod(F.xxhash64(member, F.lit(1)), F.coalesce("parts", F.lit(1))))
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    cut = cut.withColumn("other", F.explode(others))
    unit = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    members = [c for c in rows.columns if c != "group"]
    return cut.select(unit.alias("unit"), *members).repartition(max(4 * shuffle_partitions(rows.sparkSession), size // 1_000_000), "unit")


def components(edges: DataFrame) -> DataFrame:
    """Rows v, root: the least vertex that each vertex with an edge reaches. Vertices without edges have no row."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        near = both(e)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = edges.where("a <> b").distinct().checkpoint()
    seen = mark(edges)
    while True:
        edges = small_star(large_star(edges)).checkpoint()
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def classes(marked: DataFrame, radius: int = RADIUS, most: int = MOST, tile: int = TILE) -> DataFrame:
    """fp and component_id of each distinct fingerprint of rows doc_id, fp."""
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    vertices = least.select("fp", "least", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("v")).checkpoint()
    roots = components(links(vertices, vertices.count(), radius, most, tile)).select(F.col("v.fp").alias("fp"), "root")
    own = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("root.least"))
    return vertices.join(roots, "fp", "left").select("fp", own.alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, most: int = MOST, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs."""
    with_checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs, words).checkpoint()
    found = marked.join(classes(marked, radius, most, tile), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of docs, with all its columns, for each component: that with the least doc_id (null last); of several the least text hash.

    The texts are dealt by doc_id once, for the join with the rows that stay.
    """
    with_checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs.select(row_key().alias("doc_id"), "text"), words).checkpoint()
    return rows_of(docs, classes(marked, radius).select(F.col("component_id").alias("_row")).distinct())


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose row_key is in column _row of kept, each once; columns of any name are kept."""
    rows = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(kept.select(F.col("_row").alias("key")), "key", "left_semi")
    rest = [F.col("row").getField(c).cast("string") for c in docs.columns if c != "text"]
    turn = F.row_number().over(Window.partitionBy("key").orderBy(*rest))  # rows of one doc_id and text
    return rows.withColumn("turn", turn).where("turn = 1").select("row.*")
