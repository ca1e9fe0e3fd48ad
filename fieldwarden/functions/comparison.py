"""Comparison of untyped strings: exact decimals if both are numeric, bytes if neither is, and never in order across the two."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of so many characters keep their order and identity as doubles, which tell all decimals of 15 digits apart; longer ones are compared as keys.
SHORT, NUMBER = 15, "double"
#: White space around compared values, as SQL.
SPACES = r"' \t\r\n'"
NUMERIC = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\r\n"))


def is_numeric(value: Column) -> Column:
    return value.rlike(NUMERIC)


def decimal_key(value: Column) -> Column:
    """A struct that sorts numeric strings by value at any precision: sign, signed length of the whole part, digits."""
    body = F.regexp_replace(value, r"^[+-]", "")
    whole = F.regexp_replace(F.split_part(body, F.lit("."), F.lit(1)), "^0+", "")
    fraction = F.regexp_replace(F.split_part(body, F.lit("."), F.lit(2)), "0+$", "")
    digits, negative = F.concat(whole, fraction), value.startswith("-")
    sign = F.when(digits == "", 0).when(negative, -1).otherwise(1)
    shown = F.when(negative & (digits != ""), F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit("~"))).otherwise(digits)
    return F.struct(sign.alias("sign"), (sign * F.length(whole)).alias("size"), shown.alias("digits"))


def literal_key(value: str) -> Column:
    """decimal_key of a numeric text that is known when the plan is made."""
    sign, whole, shown = _parts(value)
    return F.struct(F.lit(sign).alias("sign"), F.lit(sign * whole).alias("size"), F.lit(shown).alias("digits"))


@dataclass(frozen=True)
class Prepared:
    """A value's forms that comparisons read, from one `prepare`d struct."""

    text: Column
    numeric: Column
    short: Column  # as a double, null if it is too long
    key: Column

    @staticmethod
    def of(made: Column) -> Prepared:
        return Prepared(made["text"], made["numeric"], made["short"], made["key"])


def prepare(value: Column, full: Column) -> Column:
    """The forms of a value as a struct. The key is made for numbers that are too long for a double, and with `full` for all."""
    text = trimmed(value)
    short = F.when(is_numeric(text) & (F.length(text) <= SHORT), text.try_cast(NUMBER))
    return F.struct(text.alias("text"), is_numeric(text).alias("numeric"), short.alias("short"), F.when(is_numeric(text) & (full | short.isNull()), decimal_key(text)).alias("key"))


OPS = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, ">": lambda x, y: x > y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y}
TURNED = {">": "<", "<": ">", ">=": "<=", "<=": ">="}


def compare(op: str, left: Column | str | Prepared, right: Column | str | Prepared) -> Column:
    """op is one of = <> > < >= <=; a str is a literal, about which the plan asks nothing. Never null if neither side is."""
    if isinstance(left, str) and isinstance(right, str):
        left = F.lit(left)
    if isinstance(left, str):
        return compare(TURNED.get(op, op), right, left)
    apply = OPS[op]
    plain = lambda v: v if isinstance(v, Prepared) else Prepared.of(prepare(v, F.lit(True)))
    a = plain(left)
    if isinstance(right, str):
        b = right.strip(" \t\r\n")
        if not re.match(NUMERIC.replace(r"\z", r"\Z"), b):
            return apply(a.text, F.lit(b)) if op in ("=", "<>") or b == "" else ~a.numeric & apply(a.text, F.lit(b))
        mixed = apply(a.text, F.lit(b)) if op in ("=", "<>") else (a.text == "") & apply(a.text, F.lit(b))
        exact = apply(a.key, literal_key(b))
        return F.when(a.numeric, F.coalesce(apply(a.short, F.lit(b).cast(NUMBER)), exact) if len(b) <= SHORT else exact).otherwise(mixed)
    b = plain(right)
    mixed = (a.numeric != b.numeric) & (a.text != "") & (b.text != "")
    across = apply(a.text, b.text) if op in ("=", "<>") else F.lit(False)
    return F.when(a.numeric & b.numeric, F.coalesce(apply(a.short, b.short), apply(a.key, b.key))).when(mixed, across).otherwise(apply(a.text, b.text))


@dataclass(frozen=True)
class Named:
    """A value whose forms are at a place of the arrays that `with_forms` adds."""

    number: int

    def form(self, name: str) -> str:
        return f"_{name}[{self.number}]"


def with_forms(frame: DataFrame, values: list[tuple[str, bool]]) -> DataFrame:
    """Adds the forms of values (SQL, and whether all numbers need a key), each found once for all comparisons above: arrays of their texts `_text`,
    whether they are numeric `_numeric`, as doubles `_short`, and the keys `_key` of numbers that are too long for one.

    Four columns hold them however many values there are: the optimizer relates each column to every other one.
    """
    if not values:
        return frame
    array = lambda make: F.expr(f"array({', '.join(make(Named(k), *v) for k, v in enumerate(values))})")
    frame = frame.withColumn("_text", array(lambda n, value, full: f"trim(BOTH {SPACES} FROM {value})"))
    frame = frame.withColumn("_numeric", array(lambda n, value, full: f"{n.form('text')} RLIKE r'{NUMERIC}'"))
    frame = frame.withColumn("_short", array(lambda n, value, full: f"CASE WHEN {n.form('numeric')} AND length({n.form('text')}) <= {SHORT} THEN try_cast({n.form('text')} AS {NUMBER}) END"))
    frame = frame.withColumn("_long", array(lambda n, value, full: f"CASE WHEN {n.form('numeric')}{'' if full else f' AND {n.form("short")} IS NULL'} THEN {n.form('text')} END"))
    some = F.coalesce(*[F.expr(Named(k).form("long")) for k in range(len(values))])
    return frame.withColumn("_key", F.when(some.isNotNull(), F.transform("_long", lambda x: F.when(x.isNotNull(), decimal_key(x)))))


def quoted(text: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + "".join("\\" + c if c in "\\'" else f"\\u{ord(c):04x}" if ord(c) < 32 else c for c in text) + "'"


def constant(op: str, left: str, right: str) -> bool:
    """The comparison of two texts that are known when the plan is made."""
    a, b = left.strip(" \t\r\n"), right.strip(" \t\r\n")
    numbers = [bool(re.match(NUMERIC.replace(r"\z", r"\Z"), x)) for x in (a, b)]
    apply = OPS[op]
    if all(numbers):
        with localcontext() as exact:
            exact.prec = 2 * (len(a) + len(b))
            return bool(apply(Decimal(a), Decimal(b)))
    return apply(a, b) if numbers[0] == numbers[1] or not a or not b or op in ("=", "<>") else False


def compare_sql(op: str, left: Named | str, right: Named | str) -> str:
    """`compare` as SQL over columns of `with_forms`, so that a rule is one text for Spark's parser and not a call for each of its parts."""
    if isinstance(left, str) and isinstance(right, str):
        return str(constant(op, left, right)).lower()
    if isinstance(left, str):
        return compare_sql(TURNED.get(op, op), right, left)
    equality, (text, numeric, short, key) = op in ("=", "<>"), map(left.form, FORMS)
    if isinstance(right, str):
        b = right.strip(" \t\r\n")
        plain = f"{text} {op} {quoted(b)}"
        if not re.match(NUMERIC.replace(r"\z", r"\Z"), b):
            return f"({plain})" if equality or b == "" else f"(NOT {numeric} AND {plain})"
        exact = f"{key} {op} {literal_sql(b)}"
        number = f"coalesce({short} {op} CAST({quoted(b)} AS {NUMBER}), {exact})" if len(b) <= SHORT else exact
        return f"(CASE WHEN {numeric} THEN {number} ELSE {plain if equality else f"{text} = '' AND {plain}"} END)"
    text2, numeric2, short2, key2 = map(right.form, FORMS)
    mixed = f"WHEN {numeric} <> {numeric2} AND {text} <> '' AND {text2} <> '' THEN false " if not equality else ""
    return f"(CASE WHEN {numeric} AND {numeric2} THEN coalesce({short} {op} {short2}, {key} {op} {key2}) {mixed}ELSE {text} {op} {text2} END)"


FORMS = ("text", "numeric", "short", "key")


def literal_sql(value: str) -> str:
    """decimal_key of a numeric text as SQL."""
    sign, whole, shown = _parts(value)
    return f"named_struct('sign', {sign}, 'size', {sign * whole}, 'digits', {quoted(shown)})"


def _parts(value: str) -> tuple[int, int, str]:
    body, negative = value.lstrip("+-"), value.startswith("-")
    whole, fraction = body.partition(".")[0].lstrip("0"), body.partition(".")[2].rstrip("0")
    digits = whole + fraction
    sign = 0 if not digits else -1 if negative else 1
    return sign, len(whole), digits.translate(str.maketrans("0123456789", "9876543210")) + "~" if sign < 0 else digits
