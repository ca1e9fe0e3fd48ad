"""LM scoring: cross-entropy difference of two matched word bigram models.

Tokens are words and single marks, as they are written, and a boundary that ends each text and is the context of its first token. The
background model is counted over all documents, the target over those given as good examples; both are estimated alike, over one
vocabulary: all words as common as one token in `VOCABULARY`, and one class for the other words, whose share is divided evenly among
them. In each model

    P(w) = (c(w) + FLOOR) / (N + FLOOR * classes)        P(w | h) = (c(h w) + PRIOR * P(w)) / (c(h) + PRIOR)

where the counts c(h w) and c(h) are of the words themselves, also of those outside the vocabulary. A token's loss is -log P(w | h).
A document's score is the mean over its tokens, boundary included, of background loss less target loss: the greater it is, the more
the target model prefers the text. All counts leave out the scored document itself.

Three passes over the texts: words (summed, with partial sums) and candidates for common pairs; exact counts of the common pairs;
and the rest. There a chunk of texts sends each bucket one packed row of its documents' pairs. Pairs of a word outside the vocabulary
go by that word, so that a bucket holds its count too; pairs of a vocabulary word, whose count is broadcast, go by the pair; pairs as
common as one in `HOT` are counted beforehand, broadcast and never sent. So no bucket is hot, and their number grows with the corpus: a
bucket has `BUCKET` tokens on average. It answers each chunk with sums of its documents, as whole numbers of 2**-20, so that scores
do not depend on how the work is dealt. Words and pairs are told apart by 62 bits or more. What is broadcast is at most
`VOCABULARY` + `HOT` entries of 24 bytes. Everything else that is gathered grows with the input and stays on executors.

Null and empty texts have no tokens and score 0. Repeated rows are scored alike, each as a document of its own. The target is
all documents of the given ids, of which no more than `SENT_IDS` are broadcast; with none, every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldwarden.llm.hashing import BASE, INVERSE, IS_WORD, mix, powers
from fieldwarden.session import shuffle_partitions, with_checkpoint_dir

VOCABULARY, HOT = 1 << 17, 1 << 16
PRIOR, FLOOR = 8.0, 0.5
#: Tokens of a bucket on average.
BUCKET = 1_000_000
#: Documents and characters of a chunk at most (a longer text is a chunk of its own).
DOCS, CHARACTERS = 1 << 14, 1 << 20
#: Target ids that are broadcast at most; beyond that the texts are dealt by doc_id once, and written with their mark.
SENT_IDS = 2_000_000
SPACE = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)
BOUNDARY = np.uint64(0x5851F42D4C957F2D)
UNIT = float(1 << 20)
#: Marks a word outside the vocabulary in the 32 bits of a pair that are its.
OTHER = np.uint64(1 << 31)


def _hashed(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the tokens of a buffer that ends between two of them."""
    word, blank = IS_WORD[buffer], SPACE[buffer]
    n = len(buffer)
    starts = np.flatnonzero(~blank & ~(word & np.append(False, word[:-1])))
    ends = starts + 1
    last = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    ends[word[starts]] = last  # a mark is a token alone, a word goes on
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n)[starts]), starts


def tokens(texts: list[str], part: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, each text's boundary last, the text of each, and how many tokens but the boundary each text has."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    raw = b"\n".join([*coded, b""])
    found, places, a = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while a < len(raw):  # in parts that end with white space, so that a long text takes no more memory a character
        b = max(raw.rfind(b" ", a, a + part), raw.rfind(b"\n", a, a + part)) + 1
        if b <= a:
            b = min(x for x in (raw.find(b" ", a), raw.find(b"\n", a)) if x >= 0) + 1
        h, starts = _hashed(np.frombuffer(raw, np.uint8, b - a, a))
        found.append(h)
        places.append(starts + a)
        a = b
    h, starts = np.concatenate(found), np.concatenate(places)
    doc = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), starts, side="right")
    size = np.bincount(doc, minlength=len(texts))
    some = np.flatnonzero(size)
    at = np.cumsum(size[some]) + np.arange(len(some))  # where the boundaries come
    out, owner = np.full(len(h) + len(some), BOUNDARY), np.empty(len(h) + len(some), np.int64)
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[inside], owner[inside], owner[at] = h, doc, some
    return out, owner, size


def before(words: np.ndarray) -> np.ndarray:
    """The context of each token."""
    return np.append(BOUNDARY, words[:-1]) if len(words) else words


def pair_hash(words: np.ndarray) -> np.ndarray:
    return mix(before(words) * np.uint64(0xD6E8FEB86659FD93) + words)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """doc_id, text and whether it is of the target, of the rows of each chunk."""
    for batch in batches:
        ids, texts, good = batch.column("doc_id"), batch.column("text").to_pylist(), np.array(batch.column("target").to_pylist(), bool)
        a, held = 0, 0
        for b, t in enumerate(texts):
            size = len(t or "")
            if b > a and (held + size > CHARACTERS or b - a >= DOCS):
                yield ids.slice(a, b - a), [x or "" for x in texts[a:b]], good[a:b]
                a, held = b, 0
            held += size
        if a < len(texts):
            yield ids.slice(a), [x or "" for x in texts[a:]], good[a:]


@dataclass(frozen=True)
class Counts:
    """Sorted hashes of the vocabulary and of the common pairs, with their counts in all documents and in the target."""

    words: np.ndarray
    word_n: np.ndarray
    word_good: np.ndarray
    pairs: np.ndarray
    pair_n: np.ndarray
    pair_good: np.ndarray
    total: tuple[int, int]  # tokens of all documents and of the target
    other: tuple[int, int]  # of those, outside the vocabulary
    other_types: int

    def place(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or its length."""
        return _place(self.words, words)


def _place(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return np.where(known[at] == keys, at, len(known)) if len(known) else np.zeros(len(keys), np.int64)


def count(told: DataFrame, vocabulary: int, hot: int) -> Counts:
    """The counts that are broadcast; told: doc_id, text, target."""
    schema = "pair boolean, key long, n long, good long"

    def rows(pair: bool, keys: np.ndarray, doc: np.ndarray, good: np.ndarray, least: float = 0.0) -> pa.RecordBatch:
        distinct, at = np.unique(keys, return_inverse=True)
        n, of_good = np.bincount(at, minlength=len(distinct)), np.bincount(at, good[doc], len(distinct)).astype(np.int64)
        keep = n >= least
        columns = [pa.array(np.full(int(keep.sum()), pair)), pa.array(distinct[keep].view(np.int64)), pa.array(n[keep]), pa.array(of_good[keep])]
        return pa.RecordBatch.from_arrays(columns, ["pair", "key", "n", "good"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, good in _chunks(batches):
            words, doc, _ = tokens(texts)
            yield rows(False, words, doc, good)
            yield rows(True, pair_hash(words), doc, good, len(words) / hot)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, good in _chunks(batches):
            words, doc, _ = tokens(texts)
            keys = pair_hash(words)
            own = _place(found, keys) < len(found)
            yield rows(True, keys[own], doc[own], good)

    add = lambda f: told.mapInArrow(f, schema).groupBy("pair", "key").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    counted = add(first).checkpoint()
    every = counted.where("not pair").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("types")).first()
    total = (every.n or 0, every.good or 0)
    # no more than `vocabulary` words, and no more than `hot` pairs, can be as common as this
    words = sorted((r.key & (1 << 64) - 1, r.n, r.good) for r in counted.where((~F.col("pair")) & ((F.col("n") * vocabulary >= total[0]) | (F.col("key") == int(BOUNDARY)))).collect())
    found = np.sort(np.array([r.key for r in counted.where(F.col("pair") & (F.col("n") * hot >= total[0])).select("key").collect()], np.int64).view(np.uint64))
    pairs = sorted((r.key & (1 << 64) - 1, r.n, r.good) for r in add(exact).collect()) if len(found) else []
    columns = lambda rows: (np.array([r[0] for r in rows], np.uint64), *(np.array([r[k] for r in rows], np.int64) for k in (1, 2)))
    own = columns(words)
    other = (total[0] - int(own[1].sum()), total[1] - int(own[2].sum()))
    return Counts(*own, *columns(pairs), total, other, max(1, every.types - len(words)))


def gain(c: Counts, place: np.ndarray, tf: np.ndarray, both: tuple, context: tuple, dw: np.ndarray, dh: np.ndarray, size: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Background loss less target loss of tokens at a vocabulary place, all alike in a document, as whole numbers of 1 / UNIT.

    tf: how often the document has the pair; both, context: counts of the pair and its first word in all documents and in the
    target; dw, dh: how often the document has the token (or its class) and the context; size: its tokens.
    """
    log = []
    for k, (word_n, own) in enumerate(((c.word_n, np.ones(len(tf), np.int64)), (c.word_good, good))):
        known = np.append(word_n, c.other[k])[place] - dw * own
        alone = (known + FLOOR) / (c.total[k] - size * own + FLOOR * (len(c.words) + 1)) / np.where(place < len(c.words), 1, c.other_types)
        log.append(np.log((both[k] - tf * own + PRIOR * alone) / (context[k] - dh * own + PRIOR)))
    return np.rint(tf * (log[1] - log[0]) * UNIT)


def _thin(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


COUNTS = ("tf", "dw", "dh", "size")


def score(docs: DataFrame, good: DataFrame, vocabulary: int = VOCABULARY, hot: int = HOT, bucket: int = BUCKET, sent_ids: int = SENT_IDS) -> DataFrame:
    """doc_id, n_tokens, score of every row of docs (doc_id, text); good: the doc_ids of the target."""
    spark = with_checkpoint_dir(docs.sparkSession)
    chosen = good.where("doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True)).checkpoint()
    few = chosen.count() <= sent_ids
    told = docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    told = told if few else told.checkpoint()
    counts = count(told, vocabulary, min(hot, vocabulary))
    sent = spark.sparkContext.broadcast(counts)
    parts = -(-counts.total[0] // bucket) or 1
    id_type, id_kind = docs.schema["doc_id"].dataType.simpleString(), pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))
    names = ["bucket", "chunk", "ids", "docs", "keys", *COUNTS, "sums"]
    kinds = [pa.int32(), pa.int64(), id_kind, *[pa.binary()] * 7]
    any_good = counts.total[1] > 0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        task = TaskContext.get().partitionId()
        for k, (ids, texts, is_good) in enumerate(_chunks(batches)):
            words, doc, size = tokens(texts)
            place = c.place(words)
            # each document's count of each of its words, and of its words outside the vocabulary
            part = np.where(place < len(c.words), place.astype(np.uint64), OTHER | words >> np.uint64(33))
            own, at, n = np.unique(doc.astype(np.uint64) << np.uint64(32) | part, return_inverse=True, return_counts=True)
            others = np.bincount(doc, place == len(c.words), len(texts)).astype(np.int64)
            at_before = np.append(-1, at[:-1])
            opens = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
            at_before[: len(doc)][opens] = len(own)  # the boundary, which a document has once
            keys = pair_hash(words)
            first, tf = np.unique(at_before[: len(doc)] * (len(own) + 1) + at, return_index=True, return_counts=True)[1:]
            d, w = doc[first], place[first]
            dw, dh = np.where(w < len(c.words), n[at[first]], others[d]), np.append(n, 1)[at_before[first]]
            head = np.append(np.uint64(0), part[:-1])[first]
            head[opens[first]] = np.uint64(c.place(np.array([BOUNDARY]))[0])
            hot_at = _place(c.pairs, keys[first])
            common, mine, m = hot_at < len(c.pairs), is_good[d].astype(np.int64), size[d] + 1
            # a common pair's words are in the vocabulary, as each is no rarer than the pair
            x, h = hot_at[common], np.minimum(head[common].astype(np.int64), len(c.words) - 1)
            sums = np.zeros(len(texts))
            if len(x):
                value = gain(c, w[common], tf[common], (c.pair_n[x], c.pair_good[x]), (c.word_n[h], c.word_good[h]), dw[common], dh[common], m[common], mine[common])
                sums = np.bincount(d[common], value, len(texts))
            rest = np.flatnonzero(~common)
            head, tail = head[rest], part[first][rest]
            by = np.where(head < OTHER, keys[first][rest], mix(before(words)[first][rest]))
            to = ((by >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((d[rest], to))
            to, rest, key = to[order], rest[order], (head << np.uint64(32) | tail)[order]
            told_docs = (d[rest] | mine[rest] << 15).astype("<u2")
            columns = dict(zip(COUNTS, (tf[rest], dw[rest], dh[rest], m[rest]), strict=True))
            chunk = task << 32 | k
            rows: list[list] = [[chunk % parts, chunk, ids, None, None, None, None, None, size.astype("<i8").tobytes(), sums.astype("<i8").tobytes()]]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)]).tolist()
            for a, b in zip(cuts, [*cuts, len(to)][1:], strict=True):
                rows.append([int(to[a]), chunk, None, told_docs[a:b].tobytes(), key[a:b].astype("<u8").tobytes(), *(_thin(columns[x][a:b]) for x in COUNTS), None])
            listed = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(id_kind), pa.nulls(len(rows) - 1, id_kind)])
            yield pa.RecordBatch.from_arrays([listed if x == "ids" else pa.array([r[j] for r in rows], kinds[j]) for j, x in enumerate(names)], names)

    def answer(table: pa.Table) -> pa.Table:
        passed = ["chunk", "ids", "docs", "size", "sums"]
        own = table.filter(pc.is_valid(table["ids"])).select(passed)  # what the chunks' own documents begin with is only passed on
        table = table.filter(pc.is_null(table["ids"]))
        if not table.num_rows:
            return own
        c = sent.value
        raw = table.column("docs").to_pylist()
        n = [len(x) // 2 for x in raw]
        docs = np.frombuffer(b"".join(raw), "<u2").astype(np.int64)
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u8")
        tf, dw, dh, size = (np.concatenate([_wide(x, m) for x, m in zip(table.column(name).to_pylist(), n, strict=True)]) for name in COUNTS)
        mine, row = docs >> 15, np.repeat(np.arange(len(n)), n)
        summed = lambda at: (np.bincount(at, tf).astype(np.int64)[at], np.bincount(at, tf * mine).astype(np.int64)[at])
        both = summed(np.unique(key, return_inverse=True)[1])
        head, tail = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
        context = summed(np.unique(head, return_inverse=True)[1])  # right for words outside the vocabulary, which have all their pairs here
        known = head < OTHER
        h = np.where(known, head, np.uint64(0)).astype(np.int64)
        context = tuple(np.where(known, all_n[h], here) for all_n, here in zip((c.word_n, c.word_good), context, strict=True))
        place = np.minimum(tail, np.uint64(len(c.words))).astype(np.int64)
        value = gain(c, place, tf, both, context, dw, dh, size, mine)
        code, at = np.unique(row << 15 | docs & 0x7FFF, return_inverse=True)
        sums, cuts = np.bincount(at, value).astype("<i8"), np.searchsorted(code >> 15, np.arange(len(n) + 1)).tolist()
        told = (code & 0x7FFF).astype("<u2")
        binary = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        nothing = pa.nulls(len(n), pa.binary())
        return pa.concat_tables([own, pa.table([table.column("chunk"), pa.nulls(len(n), id_kind), binary(told), nothing, binary(sums)], passed).cast(own.schema)])

    def add(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table["ids"]))
        size = np.frombuffer(own["size"][0].as_py(), "<i8")
        total = np.frombuffer(own["sums"][0].as_py(), "<i8").astype(np.float64)
        for at, sums in zip(table["docs"].to_pylist(), table["sums"].to_pylist(), strict=True):
            if at is not None:
                total[np.frombuffer(at, "<u2")] += np.frombuffer(sums, "<i8")
        result = np.where((size > 0) & any_good, total / UNIT / (size + 1), 0.0)
        return pa.table([own["ids"].combine_chunks().flatten(), pa.array(size), pa.array(result)], ["doc_id", "n_tokens", "score"])

    schema = f"bucket int, chunk long, ids array<{id_type}>, docs binary, keys binary, tf binary, dw binary, dh binary, size binary, sums binary"
    # sorted, so that a task that is run again makes the same chunks
    dealt = told.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(send, schema).repartition(max(shuffle_partitions(spark), parts // 8), "bucket")
    answered = dealt.groupBy("bucket").applyInArrow(answer, f"chunk long, ids array<{id_type}>, docs binary, size binary, sums binary")
    return answered.groupBy("chunk").applyInArrow(add, f"doc_id {id_type}, n_tokens long, score double")
