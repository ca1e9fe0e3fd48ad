import hashlib
from collections import Counter

import numpy as np

from fieldwarden.llm import digest as D


def brute(raw, buckets):
    """The codes by plain loops."""
    counts = Counter()
    for i in range(len(raw)):
        for places, salt in (((0, 1, 2), 0x9E3779B1), ((0, 1, 3), 0x85EBCA77), ((0, 2, 3), 0xC2B2AE3D)):
            if i + places[-1] < len(raw):
                x, y, z = (raw[i + p] for p in places)
                h = ((x << 16 | y << 8 | z) * salt) & 0xFFFFFFFF
                h = ((h ^ h >> 15) * 0x27D4EB2F) & 0xFFFFFFFF
                counts[(h >> 16) % buckets] += 1
    full = [counts[b] for b in range(buckets)]
    edges = [sorted(full)[k] for k in (buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1)]
    return [sum(c > e for e in edges) for c in full]


def test_codes_as_by_loops():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 50, 1000):
        raw = bytes(rng.integers(97, 105, n).astype(np.uint8))
        assert D.codes(raw, 128).tolist() == brute(raw, 128), n
    raw = bytes(rng.integers(97, 122, (1 << 18) + 500).astype(np.uint8))  # over one part
    assert D.codes(raw, 128).tolist() == brute(raw, 128)


def test_likeness():
    a = D.digest(b"the quick brown fox jumps over the lazy dog " * 20)
    b = D.digest(b"entirely different words about something else " * 20)
    assert D.likeness(a, a) == 1.0 and 0 <= D.likeness(a, b) < 0.8
    assert D.likeness(a, b) == D.likeness(b, a)


def check(rows, docs):
    order = sorted(docs, key=lambda d: (-(2**63) if d[0] is None else d[0], d[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for k, (doc_id, _) in enumerate(order):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (D.digest(x.encode()) for x in (t, changed, following))
        want.append((doc_id, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, D.likeness(a, b), D.likeness(a, c)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_edited_texts(spark):
    rng = np.random.default_rng(1)
    docs = [(int(i), "".join(rng.choice(list("abcdeé 😀"), rng.integers(0, 80)))) for i in rng.permutation(500) * 7 - 900]
    docs += [(10_000, None), (10_001, "")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string").repartition(7)
    for ranges in (1, 2, 16, 300):
        check(D.compare_edited(frame, ranges=ranges).collect(), docs)


def test_few_rows(spark):
    for docs in ([], [(5, "alone")], [(1, "same"), (1, "same"), (1, "same")], [(None, "abc"), (2, "xyz")]):
        check(D.compare_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_fingerprints(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "abcabc"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r.fingerprint for r in D.fingerprints(docs).collect()}
    assert rows[1] == rows[2] == D.digest(b"abcabc") and rows[3] == D.digest(b"")


def test_large_ids_beside_null(spark):
    big = 9007199254740993
    docs = [(None, "no id at all"), (big, "first of two large ids"), (big + 2, "second of two large ids")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(D.compare_edited(frame).collect(), docs)
    assert {r.doc_id for r in D.fingerprints(frame).collect()} == {None, big, big + 2}


def test_one_doc_id_of_many_rows_and_a_very_long_text(spark):
    docs = [(5, f"text {k}") for k in range(300)] + [(6, "long " * 200_000), (7, "x")]
    rows = D.compare_edited(spark.createDataFrame(docs, "doc_id long, text string"), ranges=7).collect()
    assert len(rows) == 302 and max(r.n_chars for r in rows) == 1_000_000
    last, long = next(r for r in rows if r.doc_id == 7), next(r for r in rows if r.doc_id == 6)
    assert long.edited_sha256 == hashlib.sha256(D.edited("long " * 200_000, "x").encode()).hexdigest() and last.fingerprint == D.digest(b"x")
