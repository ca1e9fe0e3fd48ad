"""Traces of check characters against plain Python: each step by its textbook rule, and the last state against the check characters."""

import random

import pytest
from pyspark.sql import functions as F

from fieldwarden.functions import identifiers as I


def plain(name, values):
    """States after each step, in the order in which the values are taken."""
    out, a = [], {"iso7064_mod11_10": 5, "iso7064_mod37_36": 18, "iso7064_letters1": 13, "iso7064_letters2": 18}.get(name, 0)
    pure = {"iso7064_mod11_2": (11, 2), "iso7064_mod37_2": (37, 2), "iso7064_mod97_10": (97, 10)}
    hybrid = {"iso7064_mod11_10": 10, "iso7064_mod37_36": 36, "iso7064_letters1": 26, "iso7064_letters2": 36}
    weights = {"gs1_mod10": (3, 1), "aba_mod10": (3, 7, 1), "mrz_mod10": (7, 3, 1), "weighted_mod11": range(2, 99)}
    power = lambda x, n: power(I.VERHOEFF[x], n - 1) if n else x
    for i, d in enumerate(values):
        if name in pure:
            a = (a + d) * pure[name][1] % pure[name][0]
        elif name in hybrid:
            m = hybrid[name]
            a = ((a or m) * 2 % (m + 1) + d % m) % m
        elif name == "damm":
            a = int(I.DAMM[a][d])
        elif name == "verhoeff":
            a = I.dihedral(a, power(d, (i + 1) % 8))
        elif name == "luhn":
            a += sum(divmod(2 * d, 10)) if i % 2 == 0 else d
        else:
            a += d * weights[name][i % len(weights[name])]
        out.append(a)
    return out


def check(name, a):
    letters = I.ALGORITHMS[name][1]
    if name == "iso7064_mod97_10":
        return f"{98 - a * 10 % 97:02d}"
    if name in ("iso7064_mod11_2", "iso7064_mod37_2"):
        return letters[(1 - a) % len(letters)]
    if name.startswith("iso7064"):
        m = 26 if name.endswith("1") and "letters" in name else 10 if "11_10" in name else 36
        v = (1 - (a or m) * 2 % (m + 1)) % m
        return letters[v // 6] + letters[v % 6] if name == "iso7064_letters2" else letters[v]
    return str(a) if name == "damm" else str(I.INVERSE[a]) if name == "verhoeff" else str(a % 10) if name == "mrz_mod10" else letters[-a % (11 if name == "weighted_mod11" else 10)]


@pytest.mark.parametrize("name", [n for n in I.ALGORITHMS if n != "none"])
def test_every_step(spark, name):
    draw = random.Random(name)
    alphabet = I.ALGORITHMS[name][0]
    payloads = ["".join(draw.choices(alphabet, k=draw.randint(1, 20))) for _ in range(20)] + ["", "a?", None]
    rows = spark.createDataFrame([(p,) for p in payloads], "p string").select("p", I.explain(name, F.col("p")).alias("t"), I.check_characters(name, F.col("p")).alias("c")).collect()
    for r in rows:
        if r.p not in payloads[:20]:
            assert r.t is None and r.c is None
            continue
        backwards = I.STEPS[name][2]
        taken = list(enumerate(r.p, 1))[:: -1 if backwards else 1]
        values = [alphabet.index(c) for _, c in taken]
        states = plain(name, values)
        assert [tuple(x) for x in r.t] == [(k, c, v, a) for (k, c), v, a in zip(taken, values, states)]
        assert r.c == check(name, states[-1])


def test_no_algorithm_has_no_steps(spark):
    assert spark.range(1).select(I.explain("none", F.lit("AB")).alias("t")).first().t == []
