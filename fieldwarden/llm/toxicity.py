"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of the words, the pairs of neighbours and the pairs with one word between
them of the lower-cased text; a feature counts once in a text. The model is fitted on the driver on a
bounded sample of the labelled rows (`max_rows`, drawn by a hash of doc_id), with the features that executors count in enough of
the sample's texts with label 1. Of these the driver first drops those that stand with label 1 no more than by chance (`evidence`),
which is most of the selection; the L1 term and the per-coordinate rates choose among the rest. A few thousand weights at most
are left, which are broadcast. Scoring is one pass without a shuffle.

Null and empty texts get the score of the bias alone, the share of label 1 in the sample, at most a half. Repeated rows are scored alike. Labels with a
null doc_id or a null label are not used; of several labels of one doc_id the greatest counts. With no
usable label every score is 0.5. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwarden.llm.hashing import chunks, mix, word_hashes

#: Rows that the model is fitted on at most.
MAX_ROWS = 20_000
#: Of those, the rows with label 1 that give the vocabulary.
MAX_POSITIVE = 2_000
#: Score from which a text is called toxic.
THRESHOLD = 0.7
_FLAG_BITS = 22


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float


#: What is learned from no labels, or from one kind of them.
NOTHING = Model(np.empty(0, np.uint64), np.empty(0, np.float32), 0.0)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram and skip-gram hashes of the texts, and the index of the text of each."""
    h, doc = word_hashes(texts)
    found, owner = [h], [doc]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = doc[:-gap] == doc[gap:]
        found.append(mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
        owner.append(doc[:-gap][same])
    return np.concatenate(found), np.concatenate(owner)


def _feature_rows(vocabulary: np.ndarray):
    """mapInArrow function from (label, text) to (label, distinct features of the sorted vocabulary, as places of 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                own = np.unique(features([text or ""])[0])
                at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
                found.append(at[vocabulary[at] == own].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "features"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (label, text) to the distinct features of each text."""
    for batch in batches:
        for text in batch.column("text"):
            own = np.unique(features([text.as_py() or ""])[0])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["key"])


def _telling(keys: np.ndarray, rows: list[tuple[int, np.ndarray]], evidence: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Keeps the features that stand with label 1 more often than chance has it: a log-likelihood ratio of `evidence`."""
    size, ones = len(rows), sum(y for y, _ in rows)
    both = np.bincount(np.concatenate([x for _, x in rows]).astype(np.int64), minlength=len(keys))
    with_one = np.bincount(np.concatenate([x for y, x in rows if y]).astype(np.int64), minlength=len(keys))
    log = lambda k, share: k * np.log(np.maximum(k, 1) / np.maximum(both * share, 1e-9))
    ratio = 2 * (log(with_one, ones / size) + log(both - with_one, 1 - ones / size))
    kept = (ratio >= evidence) & (with_one * size > both * ones)
    place = np.cumsum(kept) - 1
    return keys[kept], [(y, place[x[kept[x]]]) for y, x in rows]


def fit_ftrl(
    rows: list[tuple[int, np.ndarray]], keys: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 20.0, l2: float = 0.1, epochs: int = 8, up: float = 20.0, evidence: float = 14.0
) -> Model:
    """Per-coordinate FTRL-proximal over rows of (label, places of the row's features in keys).

    A row with label 1 weighs `up` rows with label 0. The bias is not fitted: it is the share of label 1, or a half if that is more, which is thus the
    score of a text without known features. `l1` is for 14,000 rows or more and `evidence` for 2,200 or more; fewer rows have smaller
    gradient sums and ratios, so both shrink with them.
    """
    if len({y for y, _ in rows}) < 2:
        return NOTHING
    keys, rows = _telling(keys, rows, min(evidence, 4 + 1.3 * np.log(len(rows))))
    ones = sum(y for y, _ in rows)
    bias = min(0.0, float(np.log(ones / (len(rows) - ones))))
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    shrink = min(l1, 1 + l1 * len(rows) / 14_000)

    def weights(zx: np.ndarray, nx: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zx) <= shrink, 0.0, -(zx - np.sign(zx) * shrink) / ((beta + np.sqrt(nx)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, x = rows[k]
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            g = (1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y) * (up if y else 1.0)
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return Model(keys[kept], w[kept].astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_positive: int = MAX_POSITIVE, least: int = 3) -> Model:
    """Fits on at most `max_rows` labelled documents. labels: doc_id, label (0 or 1).

    The vocabulary is what at least `least` of the first `max_positive` documents with label 1 hold, so that
    the driver gets a few hundred features of each row and not all of them.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
        .orderBy(*order).limit(max_rows)
    )
    toxic = chosen.where("label = 1").orderBy(*order).limit(max_positive)
    of = lambda ids: docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text")
    enough = min(least, 1 + of(toxic).count() // 10)
    keys = of(toxic).mapInArrow(_keys, "key long").groupBy("key").count().where(F.col("count") >= enough)
    vocabulary = np.sort(np.array([r.key for r in keys.select("key").collect()], np.int64).view(np.uint64))
    if not len(vocabulary):
        return NOTHING
    return fit_ftrl(_ordered(of(chosen).mapInArrow(_feature_rows(vocabulary), "label int, features binary").collect()), vocabulary)


def _ordered(rows: list) -> list[tuple[int, np.ndarray]]:
    """The same order in every run, whatever task came first."""
    return [(int(r.label), np.frombuffer(r.features, np.uint32)) for r in sorted(rows, key=lambda r: (r.label, bytes(r.features)))]


def scorer(model: Model):
    """A function of a list of texts that gives their scores."""
    flag = np.zeros(1 << _FLAG_BITS, dtype=bool)
    flag[model.keys >> np.uint64(64 - _FLAG_BITS)] = True

    def score(texts: list[str]) -> np.ndarray:
        h, doc = features(texts)
        near = flag[h >> np.uint64(64 - _FLAG_BITS)]
        h, doc = h[near], doc[near]
        total = np.full(len(texts), model.bias)
        if len(model.keys) and len(h):
            at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
            hit = model.keys[at] == h
            pair = np.unique(doc[hit].astype(np.int64) << 32 | at[hit])
            np.add.at(total, pair >> 32, model.weights[pair & 0xFFFFFFFF])
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))

    return score


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = scorer(sent.value)
        for batch in batches:
            found = [apply(x) for x in chunks(batch.column("text").to_pylist())]
            s = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = scorer(sent.value)
        for t in texts:
            yield pd.Series(np.concatenate([np.empty(0), *(apply(x) for x in chunks(t))]))

    return docs.where(scored("text") < threshold)
