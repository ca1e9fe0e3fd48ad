import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwarden.llm import lmscore as L
from fieldwarden.llm import queries


def tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]", text or "", re.ASCII)


def brute(docs, good, vocabulary=L.VOCABULARY):
    """The scores by plain counting. docs: (doc_id, text)."""

    def counted(text):
        t = tokens(text)
        t = [*t, None] if t else []
        return Counter(t), Counter(zip([None, *t], t, strict=False))

    every = [counted(t) for _, t in docs]
    whole = [(Counter(), Counter()) for _ in range(2)]
    for (doc_id, _), own in zip(docs, every, strict=True):
        for k in range(2 if doc_id in good else 1):
            for have, add in zip(whole[k], own, strict=True):
                have.update(add)
    total = [sum(words.values()) for words, _ in whole]
    common = {w for w, n in whole[0][0].items() if n * vocabulary >= total[0] or w is None}
    types = max(1, len(whole[0][0]) - len(common))
    out = []
    for (doc_id, _), (words, pairs) in zip(docs, every, strict=True):
        score, size = 0.0, sum(words.values())
        for (h, w), tf in pairs.items():
            log = []
            for k in range(2):
                own = 1 if k == 0 or doc_id in good else 0
                n = lambda word: whole[k][0][word] - own * words[word]  # noqa: B023, E731
                c = n(w) if w in common else sum(n(x) for x in whole[0][0] if x not in common)
                alone = (c + L.FLOOR) / (total[k] - own * size + L.FLOOR * (len(common) + 1)) / (1 if w in common else types)
                log.append(math.log((whole[k][1][h, w] - own * tf + L.PRIOR * alone) / (n(h) + L.PRIOR)))
            score += tf * (log[1] - log[0])
        out.append((doc_id, max(0, size - 1), score / size if size and total[1] else 0.0))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=3e-6)


def test_tokens_of_texts():
    words, doc, size = L.tokens(["a b, a b", "", "é!! x", "a b, a b"])
    assert size.tolist() == [5, 0, 4, 5] and len(words) == 17 and doc.tolist() == [0] * 6 + [2] * 5 + [3] * 6
    assert words[:6].tolist() == words[11:].tolist() and (words == L.BOUNDARY).sum() == 3
    assert len(set(words[:5].tolist())) == 3 and len(set(L.pair_hash(words)[:6].tolist())) == 5


@pytest.mark.parametrize(("vocabulary", "hot", "bucket"), [(L.VOCABULARY, L.HOT, L.BUCKET), (60, 30, 500), (1, 1, 100), (200, L.HOT, 1000)])
def test_as_by_counting(spark, vocabulary, hot, bucket):
    rng = np.random.default_rng(4)
    words = ["the", "a", "of"] * 30 + [f"w{i}" for i in range(150)] + ["é", "x.", "(y)"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " \n "), (7, "repeated row of seven"), (7, "repeated row of seven"), (None, "no id here")]
    good = {int(i) for i in range(0, 300, 3)} | {7, 402}
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, target string").repartition(5)
    ids = spark.createDataFrame([(g,) for g in good] + [(3,), (None,), (99_999,)], "doc_id long")
    same(L.score(frame, ids, vocabulary, hot, bucket).collect(), brute(docs, good, vocabulary))


def test_few_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    same(L.score(docs, none).collect(), [(1, 2, 0.0), (2, 0, 0.0)])
    assert L.score(docs.limit(0), none).count() == 0


def test_separates_poor_texts(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op9_lm_cross_entropy(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("mean")).collect()
    mean = {r.quality: r["mean"] for r in rows}
    assert mean[1] > mean[0]


def test_target_of_more_than_20_000_documents(spark):
    docs = spark.range(24_000).selectExpr("id as doc_id", "concat('a w', id % 50) as text")
    rows = L.score(docs, docs.select("doc_id")).collect()
    assert len(rows) == 24_000 and max(abs(r.score) for r in rows) < 1e-5  # all of the corpus is the target, so the models are equal


def test_scores_do_not_depend_on_the_dealing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    good = docs.where("doc_id % 3 = 0").select("doc_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts, bucket in (("4", L.BUCKET), ("211", 1000)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted(map(tuple, L.score(docs.repartition(int(parts) // 4), good, bucket=bucket, sent_ids=L.SENT_IDS if parts == "4" else 0).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_large_ids_beside_null_and_a_very_long_text(spark):
    big = 9007199254740993
    docs = [(big, "a b"), (None, "a c"), (big + 2, " ".join(f"w{k % 977}" for k in range(250_000)))]
    rows = L.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(big,)], "doc_id long")).collect()
    assert {(r.doc_id, r.n_tokens) for r in rows} == {(big, 2), (None, 2), (big + 2, 250_000)}


def test_tokens_in_parts():
    text = "one two, three\tfour\n" * 50 + "x" * 300 + " é! " * 20
    whole = L.tokens([text, "", "a b"])
    for part in (1, 7, 100, 10_000):
        assert all((x == y).all() for x, y in zip(whole, L.tokens([text, "", "a b"], part), strict=True))
