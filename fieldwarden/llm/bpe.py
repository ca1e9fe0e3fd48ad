"""Byte-level BPE encoding and decoding by merge replay over a corpus.

The texts of a task are cut into pieces by the tokenizer's pattern; each distinct piece is encoded once. The
pieces that are no token themselves lie in one array of byte tokens. An inverted index leads from each token pair
that has a rank to the positions where it stands; the ranks are replayed in rising order (a heap holds the pending
ones), each merge joins the positions of its pair from left to right and touches only the two neighbours of each.
A merge can give a pair of a lower rank; that rank is then next, and the rest of the present one waits, as a
word-by-word encoder would have it. A bounded cache carries pieces from batch to batch of a worker.

Null and empty texts have no tokens. Equal texts have equal tokens. Extra columns of the input are ignored. Special
tokens are ordinary text. The ranks are read on the driver from a path that is a parameter, and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldwarden.llm.hashing import chunks

#: Pieces that a worker keeps encoded; the cache starts anew beyond that, results stay the same.
CACHE = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def splitter(pattern: str):
    """findall of the pattern. Texts of ASCII only take a plain pattern, whose classes list the ASCII characters of the properties."""
    every = "".join(map(chr, range(128)))
    plain = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        ranges = "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"{name}+", every))
        plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, ranges), plain).replace(name, f"[{ranges}]")  # noqa: B023
    full, ascii_only = regex.compile(pattern).findall, re.compile(plain).findall
    return lambda text: ascii_only(text) if text.isascii() else full(text)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = []  # (left id, right id, id of the two together)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank))
        left, right, rank = np.array(pairs, np.int32).reshape(-1, 3).T
        self.by_left = self._side(left, right, rank, len(self.tokens))
        self.by_right = self._side(right, left, rank, len(self.tokens))
        self.first = np.full((256, 256), -1, np.int32)  # of the pairs of bytes
        byte_of = {int(i): b for b, i in enumerate(self.single)}
        for x, y, r in pairs:
            if x in byte_of and y in byte_of:
                self.first[byte_of[x], byte_of[y]] = r
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.limit = cache

    @staticmethod
    def _side(fixed: np.ndarray, other: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs with one token given: where its partners begin, the partners in order, and the merged ids."""
        order = np.lexsort((other, fixed))
        return np.searchsorted(fixed[order], np.arange(n + 1)), other[order], rank[order]

    @staticmethod
    def _merged(side: tuple[np.ndarray, np.ndarray, np.ndarray], token: int, partners: np.ndarray) -> np.ndarray:
        """What the token gives with each partner, -1 for nothing."""
        lo, hi = side[0][token], side[0][token + 1]
        if lo == hi:
            return np.full(len(partners), -1, np.int32)
        at = np.minimum(np.searchsorted(side[1][lo:hi], partners), hi - lo - 1) + lo
        return np.where(side[1][at] == partners, side[2][at], -1)

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes the pieces that are not known yet; known: piece -> ids as little-endian 32-bit integers."""
        todo, words = [], []
        for piece in pieces:
            raw = piece.encode("utf-8")
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            else:
                todo.append(piece)
                words.append(raw)
        if not words:
            return
        ids, counts = self.replay(words)
        flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update((p, flat[a:b]) for p, a, b in zip(todo, [0, *ends], ends))  # noqa: B905

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words one after another, and how many each word has."""
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        lengths = np.array([len(w) + 1 for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        ids = self.single[raw]
        ids[np.cumsum(lengths) - 1] = -1  # ends each word
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        due = np.full(n, -1, np.int32)  # rank of the pair that starts here, -1 for none
        inner = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        due[inner] = self.first[raw[inner], raw[inner + 1]]
        index: dict[int, list[np.ndarray]] = {}  # rank -> positions of pairs that have it
        pending: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            places, ranks = places[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):  # noqa: B905
                if a < b:
                    rank = int(ranks[a])
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(pending, rank)
                    index[rank].append(places[a:b])

        add(np.arange(n, dtype=np.int32), due)
        while pending:
            rank = heapq.heappop(pending)
            places = index.pop(rank)
            at = np.unique(np.concatenate(places))
            at = at[due[at] == rank]  # else a neighbour has changed since
            if not len(at):
                continue
            if (word[at[1:]] == word[at[:-1]]).any():
                at, rest = self._at_once(rank, at, word, ids, after, before)
                if len(rest):
                    index[rank] = [rest]
                    heapq.heappush(pending, rank)
            gone = after[at]
            beyond = after[gone]
            ids[at] = rank
            ids[gone], due[gone] = -2, -1
            after[at], before[beyond] = beyond, at
            due[at] = right = self._merged(self.by_left, rank, ids[beyond])
            prior = before[at]
            prior = prior[(prior >= 0) & (ids[prior] >= 0)]
            due[prior] = left = self._merged(self.by_right, rank, ids[prior])
            add(np.concatenate([at, prior]), np.concatenate([right, left]))
        kept = ids >= 0
        return ids[kept], np.bincount(word[kept], minlength=len(words))

    def _at_once(self, rank: int, at: np.ndarray, word: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pair's positions may be merged together, and those that wait.

        Of positions that overlap, every other one from the left. Where a merge could give a pair of a lower rank,
        only the leftmost position of the word; that pair comes before the others.
        """
        place = np.arange(len(at))
        tied = np.append(False, after[at[:-1]] == at[1:])
        apart = at[(place - np.maximum.accumulate(np.where(tied, 0, place))) % 2 == 0]
        prior = before[apart]
        new = [self._merged(self.by_left, rank, ids[after[after[apart]]]), self._merged(self.by_left, rank, np.full(1, rank))]
        new.append(np.where((prior >= 0) & (ids[prior] >= 0), self._merged(self.by_right, rank, ids[prior]), -1))
        lower = np.any([(x >= 0) & (x < rank) for x in np.broadcast_arrays(*new)], axis=0)
        strict = np.isin(word[apart], word[apart][lower])
        first = np.append(True, word[apart][1:] != word[apart][:-1])
        wait = strict & ~first
        return apart[~wait], at[np.isin(word[at], word[apart][wait])] if wait.any() else at[:0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [self.split(t) for t in texts]
        new = set().union(*cut).difference(self.known) if cut else set()
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = set().union(*cut)
        if new:
            self.learn(new)
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_encoders: dict[tuple, Encoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker, reused by its later tasks."""
    key = (len(ranks), hashlib.sha256(b"".join(ranks)).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with_ids the ids themselves."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent.value, pattern)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist(), 1 << 22):
                ids = coder.encode(texts)
                columns = [
                    batch.column("doc_id").slice(at, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
