import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwarden.llm import hashing, queries, toxicity as T


def test_word_hashes_depend_on_words_only():
    h, doc = hashing.word_hashes(["One two, ONE", "", "x two-one é", "one"])
    assert doc.tolist() == [0, 0, 0, 2, 2, 2, 2, 3]
    assert h[0] == h[2] == h[5] == h[7] and h[1] == h[4] and len(set(h.tolist())) == 4


def test_features_are_words_pairs_and_skip_pairs():
    h, doc = T.features(["a b c", "b c"])
    assert np.bincount(doc).tolist() == [6, 3]
    assert len(set(h[doc == 0].tolist()) & set(h[doc == 1].tolist())) == 3  # b, c and "b c"


def test_scores_do_not_depend_on_neighbours():
    model = T.Model(np.sort(T.features(["bad"])[0]), np.array([3.0], np.float32), -2.0)
    score = T.scorer(model)
    texts = ["bad", "good", "", "bad bad bad", "so bad"]
    assert score(texts).tolist() == [float(score([t])[0]) for t in texts]
    assert score(["bad"])[0] == score(["bad bad bad"])[0] == pytest.approx(1 / (1 + np.exp(-1)))


def test_learns_and_defines_edge_cases(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, 30)) + (" nasty" if k % 4 == 0 else "") for k in range(800)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)] + [(900, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(None, 1), (5, None), (900, 0), (901, 0), (4, 0)], "doc_id long, label int")
    model = T.train(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(600, 800))
    assert got[900].score == got[901].score < 0.7
    assert T.score(docs.limit(0), model).count() == 0
    none = T.train(docs, labels.limit(0))
    assert {r.score for r in T.score(docs, none).collect()} == {0.5}


@pytest.mark.parametrize("every", [2, 8])
def test_few_labels_leave_texts_without_known_words_alone(spark, every):
    draw = np.random.default_rng(every)
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(k, " ".join(draw.choice(words, 40)) + " nasty" * (k % every == 0)) for k in range(150)] + [(900, ""), (901, None)], "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame([(k, int(k % every == 0)) for k in range(50)], "doc_id long, label int"))
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert got[900].score == got[901].score == pytest.approx(np.ceil(50 / every) / 50)
    assert sum(got[k].predicted for k in range(50, 150) if k % every) <= 5
    assert sum(got[k].predicted for k in range(50, 150) if k % every == 0) >= 0.8 * 100 / every


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_predicted_share_is_near_the_label_share(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    got = queries.op3_toxicity(spark, f"/root/testdata/{sf}").join(labels, "doc_id").agg(F.avg("predicted").alias("said"), F.avg("toxic").alias("told")).first()
    assert 0 < got.said and abs(got.said - got.told) < 0.08


def test_a_very_long_text_and_large_ids(spark):
    model = T.Model(np.sort(T.features(["bad"])[0]), np.array([9.0], np.float32), -4.0)
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "word " * 400_000 + "bad"), (None, "good"), (big + 2, "word " * 400_000)], "doc_id long, text string")
    assert {(r.doc_id, r.predicted) for r in T.score(docs, model).collect()} == {(big, 1), (None, 0), (big + 2, 0)}
    assert [r.doc_id for r in T.keep(docs, model).collect()] == [None, big + 2]


def brute_score(model, text):
    """The logistic score by plain loops over the words."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    grams = {(w,) for w in words} | {(a, b) for a, b in zip(words, words[1:])} | {(a, None, b) for a, b in zip(words, words[2:])}
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    hashes = {}
    for g in grams:
        h, _ = T.features([" ".join(w or "zzz" for w in g)])
        hashes[g] = int(h[0]) if len(g) == 1 else int(h[2]) if len(g) == 2 else int(h[-1])
    total = model.bias + sum(weight.get(hashes[g], 0.0) for g in grams)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_scores_as_by_loops(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.train(docs, labels.where(queries.fold(3) != 1).selectExpr("doc_id", "toxic as label"))
    texts = [r.text or "" for r in docs.limit(60).collect()]
    assert len(model.keys) and np.allclose(T.scorer(model)(texts), [brute_score(model, t) for t in texts], atol=1e-6)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op3_toxicity(spark, sf).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("count")).collect()}
    assert n.get((0, 1), 0) <= 0.005 * n[0, 0] and n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)), n
