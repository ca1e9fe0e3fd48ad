import numpy as np
import pytest
import xxhash

from fieldwarden.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(fps))]
        new = [new[x] for x in new]
        if new == label:
            break
        label = new
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two three", "A b C d", "a a a a a a a a", "Ünï CODÉ  wörds\tand\nlines   x y z", "w " * 500])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_long_text_in_parts():
    text = " ".join(str(i * i) for i in range(40_000))
    assert S.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("n", [10, 10**6, 10**8, 10**10])
def test_close_fingerprints_share_a_key(n):
    rng = np.random.default_rng(4)
    masks = S.masks(n)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)


def test_pairs_as_by_loops():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(3))]))
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    for tile in (1, 7, 1024):
        left, right = S.pairs(fps, tile=tile)
        assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [16_384, 8])
def test_components(spark, most):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(25)]
    for t in texts[:12]:  # chains of small edits, which link step by step
        for _ in range(6):
            parts = t.split()
            parts[int(rng.integers(0, 60))] = str(rng.choice(words))
            t = " ".join(parts)
            texts.append(t)
    texts += [None, "", " ", "copy of a text that is here three times"] + ["copy of a text that is here three times"] * 2
    docs = [(int(k), t, "x") for k, t in zip(rng.permutation(len(texts)) + 5, texts, strict=True)]
    fps = [brute_fingerprint(t) for _, t, _ in docs]
    label = brute_components(fps)
    least = {}
    for (doc_id, _, _), root in zip(docs, label, strict=True):
        least[root] = min(least.get(root, doc_id), doc_id)
    want = sorted((d[0], f"{fp:016x}", least[root]) for d, fp, root in zip(docs, fps, label, strict=True))
    frame = spark.createDataFrame(docs, "doc_id long, text string, fp string")
    got = sorted(map(tuple, S.near_duplicates(frame, most=most, tile=16).collect()))
    assert got == want
    assert len({x[2] for x in want}) < len(texts) - 10


def test_star_steps_on_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    S.with_checkpoint_dir(spark)
    assert {(r.v, r.root) for r in S.components(edges).collect()} == {(k, 0) for k in range(n + 1)}


def test_few_rows(spark):
    S.with_checkpoint_dir(spark)
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = S.near_duplicates(spark.createDataFrame([(None, "same"), (None, "same"), (7, "other"), (3, "same again and more"), (3, "same again and more")], "doc_id long, text string")).collect()
    assert sorted(str(r.component_id) for r in rows) == ["3", "3", "7", "None", "None"]


def test_large_ids_beside_null(spark):
    rows = S.near_duplicates(spark.createDataFrame([(None, "one two"), (9007199254740993, "one two"), (9007199254740995, "others here")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == [("9007199254740993", 9007199254740993), ("9007199254740995", 9007199254740995), ("None", 9007199254740993)]


def test_forest_of_a_dense_unit():
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 1 << 63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, 3000).astype(np.uint64)))
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    assert (S.forest(fps, tile=64) == 0).all()  # all within two bits of one value, so within four of each other
