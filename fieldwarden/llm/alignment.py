"""Alignment of two tokenizers over a corpus: which tokens overlap, and how often each pair of ids does.

Both tokenizers encode space + text: side A is a byte-level BPE of the tokenizers library, side B a BPE of sentencepiece, which adds the space itself. The byte
offsets where tokens of both end cut them into groups; every stretch between two ends of either side is a link of one token of A and one of B.

The documents of a task are taken in chunks. A chunk sends its links by stripes of side B's ids: for each stripe one row of the chunk's distinct id pairs, with
their sums, and of the documents that have them. All links are written once, to the folder of checkpoints. Then the sums, already added a chunk, go to a task for each stripe
and run of `COUNTED` chunks, which adds them into a dense block of the stripe's ids by all ids of A; blocks of one stripe are added likewise, and the greatest of each row is
its id's best count. The counts come back to the links: a task has a run of stripes and `SCORED` chunks, and their counts as far as these stripes go. So no id is hot: no task
has more than its chunks' links of it, however many there are in the corpus, and what is sent back is 16 rows a chunk. Nothing but ids' tables is broadcast.

Distinct pieces of side A's pattern and distinct words of side B (no piece of its vocabulary goes on past a space or over a line's end) are encoded once in a worker's
bounded cache. Texts that are null or empty, or whose tokens don't give back the bytes, have no tokens: zeros and an empty hash. Ids may be of any type, null or repeated; extra
columns are ignored. An empty table gives no rows. Memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from fieldwarden.llm.bpe import CACHE, splitter
from fieldwarden.llm.hashing import chunks
from fieldwarden.llm.wordbpe import byte_letters, kind, plain_splitter
from fieldwarden.session import shuffle_partitions, with_checkpoint_dir

#: Characters of a chunk at least and documents at most, and characters that are aligned at a time.
CHARACTERS, DOCS, PART = 1 << 22, 1 << 16, 1 << 20
#: Bytes of a dense block of counts at most.
BLOCK = 64 << 20
#: Chunks whose sums one task adds, and whose links one task scores; the runs of stripes that are dealt apart.
COUNTED, SCORED, RUNS = 256, 64, 16
SPACE = "▁"
STATS = ("n_a", "n_b", "n_groups", "n_links")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0, each in as few bytes as its greatest needs, compressed."""
    out = []
    for x in columns:
        most = int(x.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - (w == 8))
        out.append(width.to_bytes(1, "little") + len(x).to_bytes(8, "little") + x.astype(f"<u{width}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(data):
        width, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        out.append(np.frombuffer(data, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + n * width
    return out


@dataclass(frozen=True)
class Vocabularies:
    """What is broadcast: the file of side A, the model of side B and the pattern that cuts texts before the merges of A."""

    a: str
    b: bytes
    pattern: str


def load(a: str, b: str, pattern: str) -> Vocabularies:
    with open(a, encoding="utf-8") as file, open(b, "rb") as model:
        return Vocabularies(file.read(), model.read(), pattern)


@dataclass(frozen=True)
class Aligned:
    stats: np.ndarray  # a row of STATS for each text
    groups: list[str]
    pairs: np.ndarray  # b * n_a_ids + a of each link
    owner: np.ndarray  # the text of each link


class Coder:
    def __init__(self, v: Vocabularies, limit: int = 2 * CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(v.a)
        cutter = spec["pre_tokenizer"]
        if spec["normalizer"] or cutter["type"] != "ByteLevel" or not cutter["use_regex"] or cutter["add_prefix_space"]:
            raise ValueError("side A is not a plain byte-level vocabulary")
        self.a, self.b = Tokenizer.from_str(v.a), SentencePieceProcessor(model_proto=v.b)
        self.a.encode_special_tokens = True
        self.split, self.words, self.limit = [plain_splitter(v.pattern), splitter(v.pattern)], re.compile(" +[^ \n]*|\n[^ \n]*").findall, limit
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            self.a_bytes[number] = bytes(map(byte_of.__getitem__, token))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) or SPACE not in pieces:
            raise ValueError("side B has pieces that go on past a space or over a line's end")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.alone = self.b.piece_to_id(SPACE)
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.digits = np.array([list(str(k).rjust(len(str(most)), "\0").encode()) for k in range(most)], np.uint8)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.odd: tuple[set[str], set[str]] = (set(), set())  # known pieces that don't give back their bytes

    def pieces(self, text: str) -> list[str]:
        if (of := kind(text)) == 2:
            return [text[x:y] for _, (x, y) in self.a.pre_tokenizer.pre_tokenize_str(text)]
        return self.split[of](text)

    def _learn(self, side: int, cut: list[list[str]]) -> None:
        new = set().union(*cut).difference(self.known[side])
        if len(self.known[side]) + len(new) > self.limit:
            self.known[side].clear()
            self.odd[side].clear()
            new = set().union(*cut)
        todo = list(new)
        if side == 0:
            found = [x.ids for x in self.a.encode_batch(todo, add_special_tokens=False)] if todo else []
        else:
            found = self.b.encode([w.removeprefix(" ") for w in todo], num_threads=1) if todo else []
        table = (self.a_bytes, self.b_bytes)[side]
        for piece, ids in zip(todo, found, strict=True):
            if side and piece[0] == "\n":
                ids = ids[1:]  # without the space that the model puts first
            elif side and piece == " ":
                ids = [self.alone]
            self.known[side][piece] = array("i", ids).tobytes()
            if b"".join([table[i] for i in ids]) != piece.encode():
                self.odd[side].add(piece)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of both sides of each text, as 32-bit integers; of texts without tokens, none."""
        spaced = [" " + t if t else "" for t in texts]
        sides = []
        for side, cutter in enumerate((self.pieces, self.words)):
            cut = [cutter(t) for t in spaced]
            self._learn(side, cut)
            known, odd = self.known[side], self.odd[side]
            bad = [bool(odd) and not odd.isdisjoint(c) for c in cut]
            sides.append([b"" if x else b"".join(map(known.__getitem__, c)) for c, x in zip(cut, bad, strict=True)])
        kept = [bool(a) and bool(b) for a, b in zip(*sides, strict=True)]
        return tuple([x if k else b"" for x, k in zip(s, kept, strict=True)] for s in sides)

    def align(self, texts: list[str]) -> Aligned:
        sides = self.encode(texts)
        n_a, n_b = (np.fromiter((len(x) >> 2 for x in s), np.int64, len(texts)) for s in sides)
        a, b = (np.frombuffer(b"".join(s), "<i4") for s in sides)
        # all texts lie one after another, so that every text's end is one of both sides
        ends_a, ends_b = np.cumsum(self.a_size[a]) - 1, np.cumsum(self.b_size[b]) - 1
        at = np.zeros(int(ends_a[-1]) + 1 if len(a) else 0, np.uint8)
        at[ends_a] = 1
        at[ends_b] += 2
        at = at[at > 0]  # one for each link: which sides end with it
        of_a, of_b, both = at & 1, at >> 1, at == 3
        link_a, link_b = np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b
        owner = np.repeat(np.arange(len(texts)), n_a)[link_a]
        count = lambda x: np.bincount(x, minlength=len(texts))
        stats = np.stack([n_a, n_b, count(owner[both]), count(owner)], axis=1)
        return Aligned(stats, self._groups(a, b, n_a + n_b, at, both), b[link_b].astype(np.int64) * len(self.a_bytes) + a[link_a], owner)

    def _groups(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, at: np.ndarray, both: np.ndarray) -> list[str]:
        """The hash of each text's groups, `a1,a2|b1;a3|b2,b3`; an empty one of texts without tokens."""
        group = np.cumsum(both, dtype=np.int64) - both
        group_a, group_b = group[(at & 1) > 0], group[at > 1]
        before_b = np.append(0, np.cumsum(np.bincount(group_b)))
        through_a = np.cumsum(np.bincount(group_a))
        width = self.digits.shape[1]
        rows = np.zeros((len(a) + len(b), width + 1), np.uint8)
        for ids, own, mark, place in ((a, group_a, b"|", before_b), (b, group_b, b";", through_a)):
            if len(ids):
                to = np.arange(len(ids)) + place[own]
                last = np.append(own[1:] != own[:-1], True)
                rows[to, :width] = self.digits[ids]
                rows[to, width] = np.where(last, mark[0], ord(","))
        ends = np.cumsum(sizes).tolist()
        texts = (rows[x:y].tobytes().translate(None, b"\0")[:-1] for x, y in zip([0, *ends], ends))  # noqa: B905
        return [hashlib.sha256(t).hexdigest() if t else "" for t in texts]


_coders: dict[str, Coder] = {}


def coder(v: Vocabularies) -> Coder:
    """One coder for each pair of vocabularies in a Python worker, reused by its later tasks."""
    key = hashlib.sha256(v.a.encode() + v.b + v.pattern.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(v)
    return _coders[key]


@dataclass(frozen=True)
class Links:
    """rows: chunk; of a chunk's documents ids, told (STATS) and groups; of its links in a stripe pairs (id pairs from the stripe's first, sums) and docs (documents a pair, documents, counts)."""

    rows: DataFrame
    chunks: int
    n_a: int  # ids of side A
    stripe: int  # ids of side B in a stripe
    stripes: int


def link(docs: DataFrame, v: Vocabularies) -> Links:
    """Encodes all documents once; their links are written to the folder of checkpoints."""
    spark = with_checkpoint_dir(docs.sparkSession)
    sent, own = spark.sparkContext.broadcast(v), Coder(v)
    n_a, n_b = len(own.a_bytes), len(own.b_bytes)
    stripe = max(1, BLOCK // (8 * n_a))
    wide = stripe * n_a
    id_kind = pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))
    names, kinds = ["chunk", "stripe", "ids", "groups", "told", "pairs", "docs"], [pa.int64(), pa.int32(), id_kind, pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task, number = coder(sent.value), TaskContext.get().partitionId(), 0
        ids, held, size, characters = [], [], 0, 0

        def rows() -> pa.RecordBatch:
            nonlocal number, ids, held, size, characters
            chunk, number = task << 32 | number, number + 1
            listed = pa.concat_arrays(ids)
            codes = [x.pairs << 16 | x.owner + at for at, x in held]
            code, n = _runs(np.sort(np.concatenate(codes)))
            pairs, start = np.unique(code >> 16, return_index=True)
            sums, many = np.add.reduceat(n, start) if len(n) else n, np.diff(np.append(start, len(n)))
            doc = code & 0xFFFF
            doc = doc - np.where(np.append(True, code[1:] >> 16 != code[:-1] >> 16)[: len(doc)], 0, np.append(0, doc[:-1])[: len(doc)])  # from the pair's document before
            stats = np.concatenate([x.stats for _, x in held])
            out = [[chunk, None, None, [g for _, x in held for g in x.groups], pack(*stats.T), None, None]]
            cuts = np.searchsorted(pairs, np.arange(-(-n_b // stripe) + 1) * wide).tolist()
            bounds = np.append(start, len(n)).tolist()
            for k, (x, y) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                if x < y:
                    p, q = bounds[x], bounds[y]
                    out.append([chunk, k, None, None, None, pack(pairs[x:y] - k * wide, sums[x:y]), pack(many[x:y], doc[p:q], n[p:q])])
            ids, held, size, characters = [], [], 0, 0
            whole = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed).cast(id_kind), pa.nulls(len(out) - 1, id_kind)])
            return pa.RecordBatch.from_arrays([whole if x == "ids" else pa.array([r[k] for r in out], kinds[k]) for k, x in enumerate(names)], names)

        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist(), PART):
                if held and size + len(texts) > DOCS:
                    yield rows()
                held.append((size, c.align(texts)))
                ids.append(batch.column("doc_id").slice(at, len(texts)))
                at, size, characters = at + len(texts), size + len(texts), characters + sum(map(len, texts))
                if characters >= CHARACTERS:
                    yield rows()
        if held:
            yield rows()

    schema = f"chunk long, stripe int, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, groups array<string>, told binary, pairs binary, docs binary"
    rows = docs.select("doc_id", "text").mapInArrow(send, schema).checkpoint()
    return Links(rows, rows.where("ids is not null").count(), n_a, stripe, -(-n_b // stripe))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often each is there."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def count(links: Links, counted: int = COUNTED) -> DataFrame:
    """stripe, pairs: packed id pairs from the stripe's first, their counts in the whole corpus and whether each is its B id's best."""
    wide, ids_a = links.stripe * links.n_a, links.n_a
    parts = max(1, -(-links.chunks // counted))
    spark = links.rows.sparkSession

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, here, place = np.zeros(wide, np.int64), None, None

            def out() -> pa.RecordBatch:
                pairs = np.flatnonzero(block)
                columns = [pairs, block[pairs]]
                if last:
                    best = block.reshape(-1, ids_a).max(axis=1)  # of each id of side B
                    columns.append(columns[1] == best[pairs // ids_a])
                block[pairs] = 0
                return pa.RecordBatch.from_arrays([pa.array([here[0]], pa.int32()), pa.array([here[1]], pa.int64()), pa.array([pack(*columns)], pa.binary())], ["stripe", "part", "pairs"])

            for batch in batches:
                for stripe, part, raw in zip(*(batch.column(x).to_pylist() for x in ("stripe", "part", "pairs")), strict=True):
                    if here and place != (stripe, part):
                        yield out()
                    here = place = (stripe, part)
                    pairs, sums = unpack(raw)[:2]
                    np.add.at(block, pairs, sums)
            if here:
                yield out()

        return run

    def added(rows: DataFrame, last: bool) -> DataFrame:
        dealt = rows.repartition(max(shuffle_partitions(spark), min(links.stripes * parts, 4 * parts)), "stripe", "part").sortWithinPartitions("stripe", "part")
        return dealt.mapInArrow(add(last), "stripe int, part long, pairs binary")

    rows = links.rows.where("stripe is not null").select("stripe", F.pmod(F.hash("chunk"), F.lit(parts)).cast("long").alias("part"), "pairs")
    if parts > 1:
        rows = added(rows, False)
    return added(rows.withColumn("part", F.lit(0).cast("long")), True).select("stripe", "pairs")


def pair_counts(docs: DataFrame, v: Vocabularies) -> DataFrame:
    """b_id, a_id, links, best: how many links of the corpus have both ids linked, and whether none of b_id's pairs has more."""
    links = link(docs, v)
    ids_a, wide = links.n_a, links.stripe * links.n_a

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, raw in zip(*(batch.column(x).to_pylist() for x in ("stripe", "pairs")), strict=True):
                pairs, n, best = unpack(raw)
                pairs = pairs + stripe * wide
                yield pa.RecordBatch.from_arrays([pa.array(pairs // ids_a, pa.int32()), pa.array(pairs % ids_a, pa.int32()), pa.array(n), pa.array(best > 0)], ["b_id", "a_id", "links", "best"])

    return count(links).mapInArrow(rows, "b_id int, a_id int, links long, best boolean")


def align(docs: DataFrame, v: Vocabularies, counted: int = COUNTED, scored: int = SCORED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    links = link(docs, v)
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    splits = max(1, -(-links.chunks // scored))
    each = -(-links.stripes // RUNS)
    known = count(links, counted).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    sent = links.rows.where("stripe is not null").select("stripe", "pairs", F.pmod(F.hash("chunk"), F.lit(splits)).alias("split"), "chunk", "docs")
    together = sent.unionByName(known, allowMissingColumns=True).withColumn("run", F.floor(F.col("stripe") / each).cast("int"))
    dealt = together.repartition(max(shuffle_partitions(spark), 4 * splits), "run", "split").sortWithinPartitions("run", "split", "stripe", F.col("chunk").asc_nulls_first())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums = None, {}
        pairs = counts = best = np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([pack(*x) for x in sums.values()], pa.binary())], ["chunk", "told"])

        for batch in batches:
            for run, split, chunk, raw, docs in zip(*(batch.column(x).to_pylist() for x in ("run", "split", "chunk", "pairs", "docs")), strict=True):
                if place != (run, split):
                    if sums:
                        yield out()
                    place, sums = (run, split), {}
                if chunk is None:
                    pairs, counts, best = unpack(raw)
                    continue
                at = np.searchsorted(pairs, unpack(raw)[0])
                many, doc, n = unpack(docs)
                whole = np.cumsum(doc)
                first = np.cumsum(many) - many
                doc = whole - np.repeat(whole[first] - doc[first], many)
                at = np.repeat(at, many)
                size = int(doc.max()) + 1
                have = sums.get(chunk, np.zeros((2, 0), np.int64))
                if have.shape[1] < size:
                    have = np.pad(have, ((0, 0), (0, size - have.shape[1])))
                np.add.at(have[0], doc, n * best[at])
                np.add.at(have[1], doc, n * counts[at])
                sums[chunk] = have
        if sums:
            yield out()

    answered = dealt.select("run", "split", "chunk", "pairs", "docs").mapInArrow(score, "chunk long, told binary")
    own = links.rows.where("ids is not null").select("chunk", "told", "ids", "groups")

    def whole(table: pa.Table) -> pa.Table:
        mine = table.filter(pa.compute.is_valid(table["ids"]))
        columns = dict(zip(STATS, unpack(mine["told"][0].as_py()), strict=True))
        total = np.zeros((2, len(columns["n_a"])), np.int64)
        for ids, raw in zip(table["ids"].is_null().to_pylist(), table["told"].to_pylist(), strict=True):
            if ids:
                part = np.stack(unpack(raw))
                total[:, : part.shape[1]] += part
        columns |= {"n_best": total[0], "count_sum": total[1]}
        return pa.table({"doc_id": mine["ids"].combine_chunks().flatten(), **{k: pa.array(x, pa.int64()) for k, x in columns.items()}, "groups_sha256": mine["groups"].combine_chunks().flatten()})

    schema = f"doc_id {id_type}, {', '.join(f'{x} long' for x in (*STATS, 'n_best', 'count_sum'))}, groups_sha256 string"
    return own.unionByName(answered, allowMissingColumns=True).groupBy("chunk").applyInArrow(whole, schema)
