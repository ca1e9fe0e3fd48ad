"""Pools against plain Python: check characters of windows, and the best cut by recursion."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwarden.functions import identifiers as I
from fieldwarden.functions import windows
from fieldwarden.operators import pooled


@pytest.mark.parametrize("algorithm", I.ALGORITHMS)
def test_windows_as_single_values(spark, algorithm):
    """Every window of texts, of which many are right, by each source, with stripped characters inside."""
    draw = random.Random(algorithm)
    alphabet, letters = I.ALGORITHMS[algorithm][:2]
    some = ["".join(draw.choices((alphabet or "AB1") + "-" * 2 + "A", k=draw.randint(0, 9))) for _ in range(60)]
    frame = spark.createDataFrame([(t, s) for t in some for s in ("normalized_id", "digits_only", "sequence_only")], "t string, source string")
    whole = F.lit("")
    for s in ("normalized_id", "digits_only", "sequence_only"):
        whole = F.when(F.col("source") == s, I.append_check(algorithm, F.col("t"), s)).otherwise(whole)
    made = frame.select("source", F.coalesce(whole, F.concat("t", F.lit(letters[-1:] or "7"))).alias("t"))
    cut = made.select("source", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i")).select("source", F.substr("t", F.col("i")).alias("piece"))
    told = cut.select("source", "piece", *[I.validate_id(algorithm, F.col("piece"), s).alias(s) for s in ("normalized_id", "digits_only", "sequence_only")]).collect()
    pieces = [r.piece.replace("-", "") for r in told]
    raw = np.frombuffer("".join(pieces).encode(), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    for s in ("normalized_id", "digits_only", "sequence_only"):
        got = windows.valid(algorithm, raw, np.append(0, ends[:-1]), ends, s).tolist()
        assert got == [r[s] for r in told]
        assert sum(got) > 20


def best_cut(text, pool, good):
    """The cut by its definition: at each position the best way on, given the best ways from all later ones."""

    @functools.cache
    def way(i):
        if i == len(text):
            return 0, 0, 0, 0, 0
        ids, runs, longest, junk, move = way(i + 1)
        ways = [(ids, runs - (i + 1 == len(text) or move < 0), longest, junk + 1, 0)]
        for n in pool.sizes():
            if i + n <= len(text) and good(text[i : i + n]):
                ids, runs, longest, junk, _ = way(i + n)
                ways.append((ids + 1, runs, min(longest, -n), junk, -n))
        return max(ways)

    spans, i = [], 0
    while i < len(text):
        n = -way(i)[4]
        spans += [(i, n)] if n else []
        i += n or 1
    return spans


@pytest.mark.parametrize("pool", [pooled.Pool("luhn", strip="", lengths=(3, 4)), pooled.Pool("luhn", least=3, most=5, keep="-"), pooled.Pool("none", pattern="[A-C]{2}[0-9]", lengths=(3,)), pooled.Pool("damm", strip="-", pattern="[0-9A-]+", least=3, most=4, keep="-")])
def test_cuts_as_by_recursion(spark, pool):
    draw = random.Random(str(pool))
    texts = list({"".join(draw.choices("0123AB-"[: 7 if pool.keep else 6], k=draw.randint(0, 14))) for _ in range(150)})
    cutter = pooled.Cutter(pool)
    frame = spark.createDataFrame([(t[a : a + s],) for t in texts for a in range(len(t)) for s in pool.sizes()], "p string").distinct()
    ok = I.validate_id(pool.algorithm, F.col("p"), pool.source, pool.strip) & (F.col("p").rlike(rf"\A(?:{pool.pattern})\z") if pool.pattern else F.lit(True))
    known = {r.p for r in frame.where(ok).collect()}
    for t, pieces in zip(texts, cutter.cut(texts)):
        at, spans = 0, []
        for kind, words, valid in pieces:
            if kind == "id" and valid:
                spans.append((at, len(words)))
            at += len(words)
        assert "".join(p[1] for p in pieces) == t
        assert spans == best_cut(t, pool, known.__contains__), t


def test_rows_batches_and_bounds(spark):
    pool = pooled.Pool("luhn", strip="", lengths=(9,))
    longest = pool.longest_text()
    rows = [(1, None), (2, ""), (3, "00000001 8,000000026"), (4, "x" * (longest + 1)), (5, "Z" * longest), (6, "€00000001 8")]
    cut = {r.k: r.cut for r in spark.createDataFrame(rows, "k int, v string").select("k", pooled.segments(F.col("v"), pool).alias("cut")).collect()}
    assert cut[1] is None and cut[2] == [] and cut[4] is None
    assert [tuple(p) for p in cut[3]] == [("id", "000000018", True), ("id", "000000026", True)] and [tuple(p) for p in cut[5]] == [("junk", "Z" * longest, None)]
    assert [tuple(p) for p in cut[6]] == [("id", "000000018", True)]


def test_junk_that_looks_like_an_id(spark):
    pool = pooled.Pool("luhn", strip="", pattern="[0-9]{4}", lengths=(4,))
    got = pooled.Cutter(pool).cut(["A12350018B9990C12"])[0]
    assert got == [("junk", "A", None), ("id", "1235", False), ("id", "0018", True), ("junk", "B", None), ("id", "9990", False), ("junk", "C12", None)]


def test_reasons(spark):
    def of(text, **k):
        pool = pooled.Pool("luhn", strip="", lengths=(4,), **k)
        return spark.range(1).select(pooled.reasons(pooled.segments(F.lit(text), pool), pool).alias("r")).first().r

    assert of("0018") == "" and of("AB") == "no-id;junk" and of("00180018") == "duplicate" and of("0018", expected=2) == "count" and of("0018 0026", expected=2) == ""
    assert of("00181234", pattern="[0-9]{4}") == "check-character"
