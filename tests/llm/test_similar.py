import collections
import math
import random

import numpy as np
import pytest
import xxhash

from fieldwarden.llm import similar as S
from fieldwarden.llm import simhash

SCHEMA = "doc_id long, text string, v string"


def brute_set(text, words=5):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def brute_roots(texts, similarity=0.8):
    sets = [brute_set(t) for t in texts]
    label = list(range(len(texts)))
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= similarity * len(a | b)] for a in sets]
    while (new := [min(label[j] for j in js) for js in near]) != label:
        label = new
    return label


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"x{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("text", [None, "", " \t", "One two", "a b c d E f", "a a a a a a a a", "w " * 500])
def test_shingle_set(text):
    assert set(S.shingle_set(text).tolist()) == {xxhash.xxh64_intdigest(s, simhash.SEED) for s in brute_set(text)}


def joined(n, left, right):
    label = np.arange(n)
    simhash.merge(label, left, right)
    return label


def test_pairs_and_closest_forest():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, (90, 4)).astype(np.uint64))
    fps = fps[np.argsort(np.bitwise_count(fps).sum(1))]
    left, right, apart = S.pairs(fps, 6, tile=16)
    want = {(i, j): int(np.bitwise_count(fps[i] ^ fps[j]).sum()) for i in range(90) for j in range(i + 1, 90)}
    assert dict(zip(zip(left.tolist(), right.tolist()), apart.tolist())) == {k: d for k, d in want.items() if d <= 6}
    at = S.closest_forest(90, left, right, apart)
    for radius in range(7):  # components at every radius are those of all pairs
        chosen = at[apart[at] <= radius]
        assert (joined(90, left[chosen], right[chosen]) == joined(90, left[apart <= radius], right[apart <= radius])).all()
    assert len(at) == 90 - len(np.unique(joined(90, left, right)))


@pytest.mark.parametrize("most", [2048, 7])
def test_roots_as_by_brute_force(spark, most):
    rng, texts = random.Random(3), []
    for k in range(60):
        words = [f"w{k}_{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 600]))]
        texts += [" ".join(words)] + [edited(rng, words, share) for share in (0.01, 0.02, 0.03, 0.2)]
    hot = [f"h{i}" for i in range(400)]
    texts += [edited(rng, hot, 0.005) for _ in range(40)] + [None, "", " ", "short text", "Short  TEXT", texts[0].upper()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {}
    for r in S.roots(docs, most=most).collect():
        got.setdefault(r.root, []).append(r.least["_id"])
    want = {}
    for i, root in enumerate(brute_roots(texts)):
        want.setdefault(root, i)
    assert sorted(min(x) for x in got.values()) == sorted(want.values())


def test_rows_without_ids_repeats_and_no_rows(spark):
    text = "one two three four five six"
    data = [(None, text, "b"), (4, text, "b"), (4, text, "a"), (None, "alone", "c"), (None, "alone", "c"), (7, None, None), (6, " ", None)]
    docs = spark.createDataFrame(data, SCHEMA)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(4, text, "a"), (None, "alone", "c"), (6, " ", None)], key=str)
    assert S.keep_one(docs.limit(0)).count() == 0


def least_of_roots(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {}
    for r in S.roots(docs, **how).collect():
        got.setdefault(r.root, []).append(r.least["_id"])
    return sorted(min(x) for x in got.values())


def straddling(rng, versions, pairs):
    """Versions of one text with a similarity of 0.76 or 0.79 to each other, and of some of them one further version at 0.82."""
    words, chosen = [f"w{i}" for i in range(300)], []
    while len(chosen) < versions:
        slots = frozenset(rng.sample(range(59), 4))
        if all(len(slots & x) < 2 for x in chosen):
            chosen.append(slots)
    for x in chosen[:pairs]:
        further = (frozenset([*rng.sample(sorted(x), 2), *rng.sample(sorted(set(range(59)) - x), 2)]) for _ in range(10_000))
        chosen.append(next(y for y in further if sum(len(y & z) > 1 for z in chosen) == 1))
    return [" ".join(f"x{rng.random()}" if i % 5 == 4 and i // 5 in x else w for i, w in enumerate(words)) for x in chosen]


@pytest.mark.parametrize("most", [2048, 30])
def test_versions_that_straddle_the_similarity(spark, most):
    texts = straddling(random.Random(1), 60, 20)
    want = sorted(set(brute_roots(texts)))
    assert len(want) == 60
    assert least_of_roots(spark, texts, most=most) == want


def test_near_copies_of_few_words(spark):
    rng, texts = random.Random(5), []
    for n in range(8, 31):
        for k in range(40):
            words = [f"s{n}_{k}_{i}" for i in range(n)]
            texts += [" ".join(words), " ".join([*words, "added"])]
    rng.shuffle(texts)
    assert least_of_roots(spark, texts) == sorted(set(brute_roots(texts)))


def test_short_sets_miss_few_pairs_by_calculation():
    half = [[math.comb(n, k) / 2**n for k in range(n + 1)] for n in range(90)]
    over = [[sum(p[k:]) for k in range(n + 2)] for n, p in enumerate(half)]
    for size in range(1, 65):
        for shared in range(math.ceil(0.8 * size), size + 1):
            x = size - shared
            for y in range(x, shared // 4 - x + 1):
                a, b = ([over[z][min(max((shared + z) // 2 - k + 1, 0), z + 1)] for k in range(shared + 1)] for z in (x, y))
                p = sum(h * (s * (1 - t) + t * (1 - s)) for h, s, t in zip(half[shared], a, b, strict=True))
                r = int(S.reach(np.array([size]))[0])
                assert sum(math.comb(256, k) * p**k * (1 - p) ** (256 - k) for k in range(r + 1, 257)) < 1e-5, (shared, x, y)


def test_versions_about_the_similarity(spark):
    """Groups of versions that lie at 0.7 to 0.9 of each other, so that links of a group break and others must hold it."""
    rng = np.random.default_rng(12)
    texts = []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(120)]
        for _ in range(9):
            words = list(base)
            for at in rng.choice(120, int(rng.integers(1, 4)), replace=False):
                words[at] = f"x{rng.integers(1 << 40)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in S.keep_one(docs).collect())
    label = brute_roots(texts)
    assert len(set(label)) > 60 and got == sorted(label.index(x) for x in set(label))


def test_clashing_columns_and_ids_of_text(spark):
    names = ["_id", "_null", "_text", "_row", "a.b", "row", "key", "turn", "v", "root"]
    schema = "doc_id string, text string, " + ", ".join(f"`{n}` string" for n in names)
    docs = [("b", "one two three four five six", *names), ("a", "one two three four five six", *names), ("c", "others", *names), (None, "others", *names)]
    for keep in (S.keep_one, simhash.keep_one):
        got = keep(spark.createDataFrame(docs, schema))
        assert got.columns == ["doc_id", "text", *names] and sorted(map(tuple, got.collect())) == sorted([docs[1], docs[2]])


def test_a_very_long_text(spark):
    text = " ".join(f"w{k * k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short")], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [1, 3]


def test_all_pairs_of_ten_thousand(spark):
    """One document stays of each class of all pairs alike in 0.8, found by the rarest fifth of each text's shingles, of which such a pair shares one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [frozenset(brute_set(r.text)) for r in rows]
    often = collections.Counter(g for s in sets for g in s)
    index, root = collections.defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b, key=lambda k: rows[k].doc_id)] = min(a, b, key=lambda k: rows[k].doc_id)

    empty = [k for k, s in enumerate(sets) if not s]
    for k in empty[1:]:
        join(empty[0], k)
    for i, s in enumerate(sets):
        near = set()
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) - math.ceil(0.8 * len(s)) + 1]:
            near.update(index[g])
            index[g].append(i)
        for j in near:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                join(i, j)
    least = sorted(rows[k].doc_id for k in range(len(rows)) if find(k) == k)
    assert sorted(r.doc_id for r in S.keep_one(docs).select("doc_id").collect()) == least and len(least) < 0.95 * len(rows)
