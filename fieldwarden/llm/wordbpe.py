"""BPE of words with an end mark by batched numpy merge rounds.

A text is cut at the vocabulary's special tokens, which are found in the raw text; what lies between is normalized (NFC, lower case of each character)
and cut into words by the vocabulary's pattern; white space is dropped. Each distinct word of a batch is encoded once: the symbols of all such
words, one a UTF-8 byte and the last of a word marked as its end, lie in one flat array. A round finds the least rank of a pair in each word, by
binary search over the sorted keys of all mergeable pairs, and merges all places of the pair in its word from left to right; only pairs beside a merged symbol
are looked up again, and finished words leave the array. That gives what a word-by-word encoder gives, which takes the least rank and of that the leftmost place first, as long as no
merge makes a pair of a lower rank; a vocabulary that has such merges is merged one place a word and round. A bounded cache carries words from batch to batch of a worker.

Characters newer than the Unicode tables of Python are normalized and cut by the tokenizers library, whose tables are newer, and merged as all others.

Null and empty texts have no tokens. Equal texts have equal tokens. Extra columns of the input are ignored. The vocabulary is read on the driver
from a path that is a parameter, and broadcast. Memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from fieldwarden.llm.bpe import CACHE, splitter
from fieldwarden.llm.hashing import chunks

NEVER = np.int32(2**31 - 1)


def load(path: str) -> str:
    """The vocabulary's file, if it is of the kind that this module encodes: words of bytes, an end mark, merges by rank and nothing between the tokens decoded but a space."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    model, steps = spec["model"], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
    plain = all(not model[x] for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    forms = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if not (plain and model["type"] == "BPE" and model["end_of_word_suffix"] and forms == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"] and spec["decoder"] is None):
        raise ValueError(f"{path} is no vocabulary of words with an end mark")
    return text


@cache
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in vocabularies of bytes: printable ones of Latin-1 for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 if it is in the first plane, 1 if it is beyond, 2 if Python's Unicode tables don't have it."""
    out = np.where(np.arange(sys.maxunicode + 1) < 1 << 16, 0, 1).astype(np.uint8)
    out[[c for c in range(len(out)) if unicodedata.category(chr(c)) == "Cn"]] = 2
    return out


def kind(text: str) -> int:
    """The greatest of its characters' kinds."""
    return 0 if text.isascii() else int(_kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].max())


@cache
def plain_splitter(pattern: str):
    """findall of the pattern for texts of kind 0, with classes in place of the Unicode properties: several times as fast."""
    every = "".join(chr(c) for c in np.flatnonzero(_kinds() == 0).tolist() if not 0xD800 <= c < 0xE000)
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        ranges = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _ranges([ord(m[0]) for m in regex.finditer(name, every)]))
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, ranges), pattern).replace(name, f"[{ranges}]")  # noqa: B023
    return re.compile(pattern).findall


def _ranges(codes: list[int]) -> list[tuple[int, int]]:
    cuts = [k for k in range(1, len(codes)) if codes[k] != codes[k - 1] + 1]
    return [(codes[a], codes[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]


class Encoder:
    def __init__(self, text: str, limit: int = CACHE):
        spec = json.loads(text)
        model = spec["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        self.library = Tokenizer.from_str(text)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")").split if self.special else lambda t: [t]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = [plain_splitter(pattern), splitter(pattern)]
        letters = byte_letters()
        self.inner, self.final = (np.array([vocab[letters[b] + x] for b in range(256)], np.int32) for x in ("", mark))
        self.names = [""] * (max(*vocab.values(), *self.special.values()) + 1)
        for name, number in [*vocab.items(), *self.special.items()]:
            self.names[number] = name
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), pairs[:, 2].astype(np.int32)
        self.one_by_one = self._goes_back(pairs)
        self.bytes_of = {c: b for b, c in letters.items()}
        self.ids: dict[str | int, str] = {}  # of each known word, its ids in decimal and its tokens, both joined by spaces
        self.tokens: dict[str | int, str] = {}
        self.limit = limit

    @staticmethod
    def _goes_back(pairs: np.ndarray) -> bool:
        """Whether a merge makes a symbol that a merge of a lower rank takes."""
        latest = {int(made): rank for rank, made in enumerate(pairs[:, 2])}
        return any(max(latest.get(int(a), -1), latest.get(int(b), -1)) > rank for rank, (a, b, _) in enumerate(pairs))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for none."""
        if not len(self.keys):
            return np.full(len(left), NEVER)
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, none of them empty, one after another, and how many each word has."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        symbols, ends = self.inner[raw], np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        ranks = np.full(len(raw), NEVER)  # of the pair that starts here
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        out_owner, out_symbols = [], []
        while len(owner):
            opens = np.append(True, owner[1:] != owner[:-1])
            starts = np.flatnonzero(opens)
            least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(owner))))
            ended = least == NEVER
            if ended.any():
                out_owner.append(owner[ended])
                out_symbols.append(symbols[ended])
                going = ~ended
                owner, symbols, ranks, least = owner[going], symbols[going], ranks[going], least[going]
                if not len(owner):
                    break
            at = np.flatnonzero(ranks == least)
            if self.one_by_one:
                at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            else:  # of places that overlap, as in a run of one letter, every other one
                n = np.arange(len(at))
                tied = np.append(False, at[1:] == at[:-1] + 1)
                at = at[(n - np.maximum.accumulate(np.where(tied, 0, n))) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            kept = np.ones(len(owner), bool)
            kept[at + 1] = False
            moved = np.cumsum(kept) - 1
            owner, symbols, ranks = owner[kept], symbols[kept], ranks[kept]
            at = moved[at]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            ranks[changed] = NEVER
            changed = changed[changed < len(owner) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            ranks[changed] = self.rank(symbols[changed], symbols[changed + 1])
        owners, flat = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_owner, out_symbols))
        return flat[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def words(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of its special tokens between them."""
        out: list[str | int] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(self.special[part])
            elif part.isascii():
                out += self.split[0](part.lower())
            elif (of := kind(part)) == 2:
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in cut]
            else:  # a capital sigma has one small form, wherever it stands
                out += self.split[of](unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def learn(self, new: set[str | int]) -> None:
        """Encodes words, so that their ids and tokens are known."""
        words = [w for w in new if isinstance(w, str)]
        if words:
            ids, counts = self.rounds([w.encode() for w in words])
            numbers, names, at = list(map(str, ids.tolist())), [self.names[i] for i in ids.tolist()], 0
            for w, n in zip(words, counts.tolist(), strict=True):
                self.ids[w], self.tokens[w] = " ".join(numbers[at : at + n]), " ".join(names[at : at + n])
                at += n
        for i in new.difference(words):
            self.ids[i], self.tokens[i] = str(i), self.names[i]

    def encode(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """The ids of each text in decimal, joined by spaces, and its tokens likewise, which is the decoded text."""
        cut = [self.words(t) for t in texts]
        new = set().union(*cut).difference(self.ids)
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            self.tokens.clear()
            new = set().union(*cut)
        self.learn(new)
        return tuple([" ".join(map(known.__getitem__, words)) for words in cut] for known in (self.ids, self.tokens))


_encoders: dict[str, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """One encoder a vocabulary in a Python worker, reused by its later tasks."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text)
    return _encoders[key]


def tokens(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by spaces) and decoded_sha256 of every row, and with_ids the ids and the decoded text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent.value)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist(), 1 << 21):
                ids, decoded = coder.encode(texts)
                digest = lambda rows: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in rows], pa.string())
                counts = pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())
                columns = [batch.column("doc_id").slice(at, len(texts)), counts, digest(ids), digest(decoded)]
                if with_ids:
                    columns += [pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
