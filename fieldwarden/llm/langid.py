"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word is a run of letters. Its score in a language is the log-likelihood of its letter trigrams (with the word's edges)
in the counts of that language's training texts; languages that hardly ever use the word's script are ruled out. The
labels of a text's words are the sequence with the greatest sum of scores less `switch` for each change of language, so
mixed texts fall into spans. A very long text is cut into blocks whose best ways from label to label are found side by side. The text's language is the one whose spans have most letters, the score their share.

The classifier is fitted on the `LANGUAGES` most frequent values of lang (of equally frequent ones the first by code point) and on about `per_language` texts of
each, drawn by a hash of doc_id and text, so that equal rows are drawn together. The counts are added on executors; only the finished table goes to the driver
and is broadcast, with 512 KB for each language: 100 MB at most, however many values lang has.

Null texts, empty ones and those without a letter are `und` with score 0; so is every text if nothing could be learned.
Of languages with equal shares the first by code point counts. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.hashing import chunks, mix

PER_LANGUAGE = 3_000
#: Values of lang that are learned at most.
LANGUAGES = 200
#: Trigram buckets of a language's table, by their logarithm, and the rows that a table is sent in.
BITS, SLICES = 17, 16
#: Cost of a change of language between two words, and of a word in a script its language hardly uses.
SWITCH, FOREIGN = 12.0, 40.0
#: Texts of more words are labelled in blocks of so many.
LONG, BLOCK = 4096, 512

# First and last code points of the main blocks of each script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}

_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case, its script's number (the last for all others)."""
    global _tables
    if _tables is None:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in (*range(0xD800), *range(0xE000, 0x33480)):
            if chr(c).isalpha():
                letter[c] = True
                if len(low := chr(c).lower()) == 1:
                    lower[c] = ord(low)
        script = np.full(0x110000, len(SCRIPTS), np.uint8)
        for k, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                script[a : b + 1] = k
        _tables = letter, lower, script
    return _tables


@dataclass
class Words:
    doc: np.ndarray  # index of the text of each word
    start: np.ndarray  # in code points of all texts, with one between each two
    end: np.ndarray
    script: np.ndarray
    gram: np.ndarray  # trigram bucket of every letter
    first: np.ndarray  # index in gram of each word's first letter
    base: np.ndarray  # where each text starts


def read_words(texts: list[str]) -> Words:
    letter, lower, script = _characters()
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letter[codes]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edges[0::2], edges[1::2]
    low = np.where(inside, lower[codes], 0).astype(np.uint64)
    at = np.flatnonzero(inside)
    padded = np.concatenate([[np.uint64(0)], low, [np.uint64(0)]])
    h = mix(padded[at] << np.uint64(42) | low[at] << np.uint64(21) | padded[at + 2])
    lengths = np.array([len(t) + 1 for t in texts])
    base = np.cumsum(lengths) - lengths
    first = np.cumsum(end - start) - (end - start)
    doc = np.searchsorted(base, start, side="right") - 1
    return Words(doc, start, end, script[codes[start]], (h >> np.uint64(64 - BITS)).astype(np.int64), first, base)


@dataclass
class Model:
    names: list[str]
    grams: np.ndarray  # log-likelihood by bucket and language
    scripts: np.ndarray  # what a word of a script costs a language


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text) to slices of each language's trigram counts, with its script counts in the first."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            w = read_words([text or ""])
            grams.setdefault(lang, np.zeros(1 << BITS, np.int64))
            scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 1, np.int64))
            np.add.at(grams[lang], w.gram, 1)
            scripts[lang] += np.bincount(w.script, w.end - w.start, len(SCRIPTS) + 1).astype(np.int64)
    for lang, table in grams.items():
        for k, part in enumerate(table.reshape(SLICES, -1)):
            counts = [scripts[lang].tobytes() if k == 0 else b"", part.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int32()), *(pa.array([c], pa.binary()) for c in counts)], ["lang", "slice", "scripts", "grams"])


def _add(groups):
    total = lambda column: sum(np.frombuffer(b, np.int64) for b in column).tobytes() if len(column[0]) else b""
    out = groups.iloc[:1].copy()
    out["scripts"], out["grams"] = [total(groups.scripts.tolist())], [total(groups.grams.tolist())]
    return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learns from the texts of docs (doc_id, text, lang) with one of the most frequent languages."""
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.join(F.broadcast(sizes), "lang").where(share * F.col("n") < per_language).select("lang", "text")
    schema = "lang string, slice int, scripts binary, grams binary"
    rows = drawn.mapInArrow(_count, schema).groupBy("lang", "slice").applyInPandas(_add, schema).collect()
    names = sorted({r.lang for r in rows})
    if not names:
        return Model([], np.zeros((1, 0)), np.zeros((1, 0)))
    number, size = {name: k for k, name in enumerate(names)}, (1 << BITS) // SLICES
    grams, scripts, total = np.zeros((1 << BITS, len(names)), np.float32), np.zeros((len(SCRIPTS) + 1, len(names))), np.zeros(len(names))
    for r in rows:
        k, counts = number[r.lang], np.frombuffer(r.grams, np.int64)
        grams[r.slice * size : (r.slice + 1) * size, k] = counts
        total[k] += counts.sum()
        if r.slice == 0:
            scripts[:, k] = np.frombuffer(r.scripts, np.int64)
    smooth = 0.05
    table = grams
    table += np.float32(smooth)
    np.log(table, out=table)
    table -= np.log(total + smooth * len(table)).astype(np.float32)
    used = scripts >= 0.01 * np.maximum(1, scripts.sum(0))
    cost = np.where(used | ~used.any(1, keepdims=True), 0.0, -FOREIGN)
    return Model(names, table, cost)


def _run(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float, before: np.ndarray | None = None, last: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """The best value of each sequence of words for every label of its last word; all sequences advance word by word together.

    before: the values of the labels of the word ahead of each sequence. With label given, the best labels are written there; last
    fixes those of the last words.
    """
    (n, m), k = scores.shape, len(starts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # sequences with a word of each number
    best = scores[starts].astype(np.float64)
    if before is not None:
        best += np.maximum(before[order], before[order].max(1, keepdims=True) - switch)
    values = np.empty((k, m))
    if label is not None:
        stay = np.ones((n, m), bool)  # whether a word's best way into a label comes from the same label
        come = np.zeros(n, np.int16)  # else the label that it comes from
    for step in range(1, int(lengths[0])):
        k = active[step]
        if k < len(best):
            values[k : len(best)] = best[k:]
            best = best[:k]
        at = starts[:k] + step
        top = best.argmax(1)
        moved = (best[np.arange(k), top] - switch)[:, None]
        if label is not None:
            stay[at] = best >= moved
            come[at] = top
        best = np.maximum(best, moved) + scores[at]
    values[: len(best)] = best
    if label is not None:
        label[starts + lengths - 1] = values.argmax(1) if last is None else last[order]
        for step in range(int(lengths[0]) - 1, 0, -1):
            at = starts[: active[step]] + step
            own = label[at]
            label[at - 1] = np.where(stay[at, own], own, come[at])
    out = np.empty_like(values)
    out[order] = values
    return out


def _in_blocks(scores: np.ndarray, label: np.ndarray, switch: float, block: int) -> None:
    """Labels one long text: every block's best values from each label to each label at once, then the way through the blocks, then the blocks' labels at once."""
    n, m = scores.shape
    starts = np.arange(0, n, block)
    lengths = np.minimum(block, n - starts)
    alone = np.where(np.eye(m, dtype=bool), 0.0, -np.inf)
    to = _run(scores, np.repeat(starts[1:], m), np.repeat(lengths[1:], m), switch, np.tile(alone, (len(starts) - 1, 1))).reshape(-1, m, m)
    value, came = _run(scores, starts[:1], lengths[:1], switch)[0], np.zeros((len(starts), m), np.int64)
    for k, step in enumerate(to, 1):
        ways = value[:, None] + step
        came[k], value = ways.argmax(0), ways.max(0)
    last = np.zeros(len(starts), np.int64)
    last[-1] = value.argmax()
    for k in range(len(starts) - 1, 0, -1):
        last[k - 1] = came[k, last[k]]
    _run(scores, starts[:1], lengths[:1], switch, None, last[:1], label)
    _run(scores, starts[1:], lengths[1:], switch, alone[last[:-1]], last[1:], label)


def viterbi(scores: np.ndarray, doc: np.ndarray, switch: float = SWITCH, long: int = LONG, block: int = BLOCK) -> np.ndarray:
    """The best label of each word; rows of a text (doc) stand together."""
    n, m = scores.shape
    label = np.zeros(n, np.int16)
    if not n or m == 1:
        return label
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    lengths = np.diff(np.append(starts, n))
    short = lengths <= long
    if short.any():
        _run(scores, starts[short], lengths[short], switch, label=label)
    for a, size in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True):
        _in_blocks(scores[a : a + size], label[a : a + size], switch, block)
    return label


def labeller(model: Model, switch: float = SWITCH):
    """A function of texts that gives language, score and spans (language, start, end) of each."""
    names, m = model.names, len(model.names)

    def label(texts: list[str], with_spans: bool) -> list[tuple[str, float, list]]:
        out: list[tuple[str, float, list]] = [("und", 0.0, [])] * len(texts)
        w = read_words(texts)
        if not len(w.doc) or not m:
            return out
        scores = np.add.reduceat(model.grams[w.gram], w.first, axis=0) + model.scripts[w.script]
        found = viterbi(scores, w.doc, switch)
        size = w.end - w.start
        letters = np.bincount(w.doc * m + found, size, len(texts) * m).reshape(-1, m)
        top, total = letters.argmax(1), letters.sum(1)
        spans: dict[int, list] = {}
        if with_spans:
            cut = np.flatnonzero(np.append(True, (w.doc[1:] != w.doc[:-1]) | (found[1:] != found[:-1])))
            for a, b in zip(cut.tolist(), [*(cut[1:] - 1).tolist(), len(found) - 1], strict=True):
                d = int(w.doc[a])
                spans.setdefault(d, []).append((names[found[a]], int(w.start[a] - w.base[d]), int(w.end[b] - w.base[d])))
        for d in np.flatnonzero(total).tolist():
            out[d] = (names[top[d]], float(letters[d, top[d]] / total[d]), spans.get(d, []))
        return out

    return label


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row, and with_spans the labelled spans in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = max(1 << 16, (1 << 23) // max(2, len(model.names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeller(sent.value)
        spans = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text").to_pylist(), size):
                rows = label(texts, with_spans)
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
                if with_spans:
                    columns.append(pa.array([[dict(zip(("lang", "start", "end"), s, strict=True)) for s in r[2]] for r in rows], spans))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<lang string, start int, end int>>" * with_spans)
