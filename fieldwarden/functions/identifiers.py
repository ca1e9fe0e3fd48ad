"""Identifier functions as column expressions: normalization, check characters, validation and minting.

Every algorithm is an `aggregate` over the characters of a payload, so it stays in the JVM and needs no shuffle.
A payload that is null, empty or outside the algorithm's alphabet has no check characters: the result is null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = DIGITS + LETTERS
#: Default characters that are stripped from a value before it is checked.
STRIP = "-/ _|\\"
DASHES = "‐‑‒–—―−"

# The order-10 quasigroup of Damm's thesis, and Verhoeff's permutation and inverses.
DAMM = (
    "0317598642", "7092154863", "4206871359", "1750983426", "6123045978",
    "3674209581", "5869720134", "8945362017", "9438617205", "2581436790",
)
VERHOEFF = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
INVERSE = (0, 4, 3, 2, 1, 5, 6, 7, 8, 9)

# Names people write for an algorithm.
SYNONYMS = {
    "iso7064_mod37_36": "3736 37_36 37-36 37,36 mod37_36 mod3736", "iso7064_mod11_10": "1110 11_10 11-10 11,10 mod11_10 mod1110",
    "iso7064_mod97_10": "9710 97_10 97-10 97,10 mod97_10 mod9710", "iso7064_mod11_2": "112 11_2 11-2 11,2 mod11_2 mod112",
    "iso7064_mod37_2": "372 37_2 37-2 37,2 mod37_2 mod372", "iso7064_letters1": "letters1 letter1", "iso7064_letters2": "letters2 letter2",
    "luhn": "mod10", "gs1_mod10": "gs1 gtin ean upc", "aba_mod10": "aba routing", "mrz_mod10": "mrz icao", "weighted_mod11": "isbn mod11w weighted11", "none": "regex format",
}


def normalize(value: Column, strip: str = STRIP, uppercase: bool = True, unify_dashes: bool = True, keep_only: str | None = None) -> Column:
    """Dashes become '-', letters upper case, strip characters go, and with keep_only all others but those."""
    if unify_dashes:
        value = F.translate(value, DASHES, "-" * len(DASHES))
    if uppercase:
        value = F.upper(value)
    if strip:
        value = F.translate(value, strip, "")
    if keep_only is not None:
        value = F.regexp_replace(value, "[^" + re.sub(r"([\\\]\[^&~-])", r"\\\1", keep_only) + "]", "") if keep_only else F.lit("")
    return value


def apply_source(value: Column, source: str = "normalized_id") -> Column:
    """The part that the algorithm runs over: all of it, its digits, or its last run of digits."""
    if source == "digits_only":
        return F.regexp_replace(value, r"[^\p{Nd}]", "")
    if source == "sequence_only":
        return F.regexp_extract(value, r"(\p{Nd}+)\P{Nd}*$", 1)
    return value


def _fold(payload: Column, alphabet: str, start: Column, step, finish) -> Column:
    """aggregate over the characters' numbers in the alphabet."""
    number = lambda c: F.instr(F.lit(alphabet), c) - 1
    return F.aggregate(F.split(payload, ""), start, lambda a, c: step(a, number(c)), finish)


def _letter(alphabet: str, k: Column) -> Column:
    return F.substr(F.lit(alphabet), k + 1, F.lit(1))


def _pure(alphabet: str, m: int, r: int, checks: str):
    return lambda p: _fold(p, alphabet, F.lit(0), lambda a, d: ((a + d) * r) % m, lambda a: _letter(checks, F.pmod(1 - a, F.lit(m))))


def _mod97(p: Column) -> Column:
    return _fold(p, DIGITS, F.lit(0), lambda a, d: ((a + d) * 10) % 97, lambda a: F.lpad((98 - (a * 10) % 97).cast("string"), 2, "0"))


def _hybrid(alphabet: str, m: int, write):
    twice = lambda a: (F.when(a == 0, m).otherwise(a) * 2) % (m + 1)
    return lambda p: _fold(p, alphabet, F.lit(m // 2), lambda a, d: (twice(a) + d % m) % m, lambda a: write(F.pmod(1 - twice(a), F.lit(m))))


def _table(rows) -> Column:
    return F.array(*[F.lit(int(x)) for row in rows for x in row])


def _damm(p: Column) -> Column:
    table = _table(DAMM)
    return _fold(p, DIGITS, F.lit(0), lambda a, d: F.get(table, a * 10 + d), lambda a: a.cast("string"))


def dihedral(a: int, b: int) -> int:
    """The product in the symmetry group of the pentagon: 0-4 are turns, 5-9 reflections."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


def _verhoeff(p: Column) -> Column:
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([VERHOEFF[x] for x in powers[-1]])
    product, power = _table([[dihedral(a, b) for b in range(10)] for a in range(10)]), _table(powers)
    inverse = F.array(*[F.lit(x) for x in INVERSE])
    start = F.struct(F.lit(0).alias("c"), F.lit(1).alias("i"))
    step = lambda s, d: F.struct(F.get(product, s["c"] * 10 + F.get(power, s["i"] % 8 * 10 + d)).alias("c"), (s["i"] + 1).alias("i"))
    return _fold(F.reverse(p), DIGITS, start, step, lambda s: F.get(inverse, s["c"]).cast("string"))


def _weighted(m: int, weights: tuple[int, ...] | None, from_right: bool, complement: bool, checks: str):
    """Weights in a cycle, or 2, 3, 4 ... if none are given."""

    def compute(p: Column) -> Column:
        p = F.reverse(p) if from_right else p
        weight = lambda i: F.get(F.array(*[F.lit(w) for w in weights]), i % len(weights)) if weights else i + 2
        parts = F.transform(F.split(p, ""), lambda c, i: c.cast("int") * weight(i))
        total = F.aggregate(parts, F.lit(0), lambda a, x: a + x) % m
        return _letter(checks, F.pmod(m - total, F.lit(m)) if complement else total)

    return compute


def _luhn(p: Column) -> Column:
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(F.split(F.reverse(p), ""), lambda c, i: F.when(i % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int")))
    return ((10 - F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


#: By algorithm: payload alphabet, check alphabet, number of check characters, and the expression of a payload column.
ALGORITHMS = {
    "iso7064_mod11_2": (DIGITS, DIGITS + "X", 1, _pure(DIGITS, 11, 2, DIGITS + "X")),
    "iso7064_mod37_2": (ALNUM, ALNUM + "*", 1, _pure(ALNUM, 37, 2, ALNUM + "*")),
    "iso7064_mod97_10": (DIGITS, DIGITS, 2, _mod97),
    "iso7064_mod11_10": (DIGITS, DIGITS, 1, _hybrid(DIGITS, 10, lambda v: v.cast("string"))),
    "iso7064_mod37_36": (ALNUM, ALNUM, 1, _hybrid(ALNUM, 36, lambda v: _letter(ALNUM, v))),
    "iso7064_letters1": (ALNUM, LETTERS, 1, _hybrid(ALNUM, 26, lambda v: _letter(LETTERS, v))),
    "iso7064_letters2": (ALNUM, "ABCDEF", 2, _hybrid(ALNUM, 36, lambda v: F.concat(_letter("ABCDEF", (v / 6).cast("int")), _letter("ABCDEF", v % 6)))),
    "damm": (DIGITS, DIGITS, 1, _damm),
    "verhoeff": (DIGITS, DIGITS, 1, _verhoeff),
    "luhn": (DIGITS, DIGITS, 1, _luhn),
    "gs1_mod10": (DIGITS, DIGITS, 1, _weighted(10, (3, 1), True, True, DIGITS)),
    "aba_mod10": (DIGITS, DIGITS, 1, _weighted(10, (3, 7, 1), False, True, DIGITS)),
    "mrz_mod10": (DIGITS, DIGITS, 1, _weighted(10, (7, 3, 1), False, False, DIGITS)),
    "weighted_mod11": (DIGITS, DIGITS + "X", 1, _weighted(11, None, True, True, DIGITS + "X")),
    "none": ("", "", 0, lambda p: F.lit("")),
}
DEFAULT = "iso7064_mod37_36"


def canonical(name: str) -> str:
    """The algorithm a name stands for; an unknown name stays as it is."""
    key = name.strip().lower()
    return next((a for a, words in SYNONYMS.items() if key in words.split()), key if key in ALGORITHMS else name)


def check_characters(algorithm: str, payload: Column) -> Column:
    alphabet, _, _, compute = ALGORITHMS[algorithm]
    if algorithm == "none":
        return F.lit("")
    return F.when(payload.rlike(f"\\A[{alphabet}]+\\z"), compute(payload))


def validate_id(algorithm: str, value: Column, source: str = "normalized_id", strip: str = STRIP) -> Column:
    """Whether the last characters of the normalized value are the check characters of what comes before."""
    n = ALGORITHMS[algorithm][2]
    if not n:
        return F.lit(True)
    norm = normalize(value, strip)
    body, check = F.substr(norm, F.lit(1), F.greatest(F.length(norm) - n, F.lit(0))), F.right(norm, F.lit(n))
    return F.coalesce((F.length(norm) > n) & (check_characters(algorithm, apply_source(body, source)) == check), F.lit(False))


def append_check(algorithm: str, value: Column, source: str = "normalized_id", strip: str = STRIP, delimiter: str = "") -> Column:
    """The value as it is, with its check characters behind it; null if there is nothing to compute them over."""
    if algorithm == "none":
        return value
    return F.concat(value, F.lit(delimiter), check_characters(algorithm, apply_source(normalize(value, strip), source)))


def _cycle(*weights: int):
    return lambda a, d, i: a + d * F.get(F.array(*map(F.lit, weights)), i % len(weights))


def _radix(m: int, r: int):
    return lambda a, d, i: ((a + d) * r) % m


def _double_add(m: int):
    return lambda a, d, i: (F.when(a == 0, m).otherwise(a) * 2 % (m + 1) + d % m) % m


def _turned(a: Column, d: Column, i: Column) -> Column:
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([VERHOEFF[x] for x in powers[-1]])
    product = _table([[dihedral(x, y) for y in range(10)] for x in range(10)])
    return F.get(product, a * 10 + F.get(_table(powers), (i + 1) % 8 * 10 + d))


#: By algorithm: the state before the first character, the next state by (state, value, turn), and whether characters are taken from the right.
STEPS = {
    "iso7064_mod11_2": (0, _radix(11, 2), False), "iso7064_mod37_2": (0, _radix(37, 2), False), "iso7064_mod97_10": (0, _radix(97, 10), False),
    "iso7064_mod11_10": (5, _double_add(10), False), "iso7064_mod37_36": (18, _double_add(36), False), "iso7064_letters1": (13, _double_add(26), False), "iso7064_letters2": (18, _double_add(36), False),
    "damm": (0, lambda a, d, i: F.get(_table(DAMM), a * 10 + d), False), "verhoeff": (0, _turned, True),
    "luhn": (0, lambda a, d, i: a + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2), True), "gs1_mod10": (0, _cycle(3, 1), True),
    "aba_mod10": (0, _cycle(3, 7, 1), False), "mrz_mod10": (0, _cycle(7, 3, 1), False), "weighted_mod11": (0, lambda a, d, i: a + d * (i + 2), True),
}


def explain(algorithm: str, payload: Column) -> Column:
    """The steps by which the check characters of a payload are found, in the order in which its characters are taken: an array of (position from 1, character,
    value, state after the step), from one fold that carries the states along. Empty for no algorithm; null where there are no check characters."""
    kind = "array<struct<position:int,character:string,value:int,state:int>>"
    if algorithm == "none":
        return F.array().cast(kind)
    alphabet = ALGORITHMS[algorithm][0]
    start, step, backwards = STEPS[algorithm]
    characters = F.split(F.reverse(payload) if backwards else payload, "")

    def add(done: Column, x: Column) -> Column:
        i, value = x["i"], F.instr(F.lit(alphabet), x["c"]) - 1
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["state"], F.lit(start))
        place = F.length(payload) - i if backwards else i + 1
        made = F.struct(place.cast("int").alias("position"), x["c"].alias("character"), value.cast("int").alias("value"), step(before, value, i).cast("int").alias("state"))
        return F.concat(done, F.array(made))

    numbered = F.transform(characters, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.when(payload.rlike(f"\\A[{alphabet}]+\\z"), F.aggregate(numbered, F.array().cast(kind), add))


def suggestion(algorithm: str, value: Column, strip: str = STRIP) -> Column:
    """The check characters that a value should end in, for sources that are the whole normalized value."""
    norm = normalize(value, strip)
    return check_characters(algorithm, F.substr(norm, F.lit(1), F.greatest(F.length(norm) - ALGORITHMS[algorithm][2], F.lit(0))))


@dataclass(frozen=True)
class Scheme:
    """How identifiers get and show their check characters."""

    algorithm: str = "none"
    source: str = "normalized_id"
    delimiter: str = "-"
    strip: str = "-/ "
    enabled: bool = True

    @property
    def active(self) -> bool:
        return self.enabled and self.algorithm != "none"

    def append(self, value: Column) -> Column:
        return append_check(self.algorithm, value, self.source, self.strip, self.delimiter) if self.active else value

    def validate(self, value: Column) -> Column:
        return validate_id(self.algorithm, value, self.source, self.strip) if self.active else F.lit(True)


#: Schemes by name: fixed values.
SCHEMES = {"default": Scheme(DEFAULT), "none": Scheme(enabled=False)}


def scheme(name: str | Scheme | None) -> Scheme:
    """A scheme by its name; none without a name, an error for an unknown one."""
    if isinstance(name, Scheme):
        return name
    if name is not None and name not in SCHEMES:
        raise ValueError(f"unknown check scheme {name!r}")
    return SCHEMES[name or "none"]
