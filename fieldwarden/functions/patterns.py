"""Designers' regular expressions: which are fit to run on every row, and the column that applies one.

A pattern is judged once, on the driver, before a plan holds it: one that could backtrack without end on some value is
never run, because one such row would hold an executor's core for minutes.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwarden.functions.identifiers import normalize

#: Characters of a pattern, and the product of the length choices of neighbours that can match the same text.
MOST_CHARACTERS, MOST_CHOICES = 512, 1_000_000
PRINTABLE = frozenset(map(chr, range(32, 127)))
UNBOUNDED = c.MAXREPEAT


def _class(items: list) -> frozenset[str]:
    found: set[str] = set()
    for op, value in items:
        if op is c.NEGATE or op is c.CATEGORY and value in (c.CATEGORY_NOT_DIGIT, c.CATEGORY_NOT_SPACE, c.CATEGORY_NOT_WORD):
            return PRINTABLE
        if op is c.LITERAL:
            found.add(chr(value))
        elif op is c.RANGE:
            found |= {chr(x) for x in range(value[0], min(value[1], 126) + 1)}
        elif op is c.CATEGORY:
            name = {c.CATEGORY_DIGIT: r"\d", c.CATEGORY_SPACE: r"\s", c.CATEGORY_WORD: r"\w"}[value]
            found |= {x for x in PRINTABLE if re.match(name, x)}
    return frozenset(found)


def _atoms(tree, repeated: bool = False) -> list[tuple[frozenset[str], int, int]]:
    """The sequence as (characters, least, most); ValueError if a repeated group has more than one way to match a text."""
    out = []
    for op, value in tree:
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, body = value
            inner = _atoms(body, repeated or high > 1)
            if len(inner) == 1 and inner[0][1:] == (1, 1):
                out.append((inner[0][0], low, high))
            elif high <= 1:
                out += [(s, 0, b) for s, _, b in inner]
            else:
                if any(a != b for _, a, b in inner):
                    raise ValueError("a repeated group of variable length")
                out.append((frozenset().union(*(s for s, _, _ in inner)), low, high))
            if repeated and low != high:
                raise ValueError("a repeat inside a repeated group")
        elif op is c.SUBPATTERN:
            out += _atoms(value[-1], repeated)
        elif op is c.BRANCH:
            if repeated:
                raise ValueError("alternatives in a repeated group")
            ways = [_atoms(x) for x in value[1]]
            least, most = min(sum(a for _, a, _ in w) for w in ways), max(sum(min(b, 4096) for _, _, b in w) for w in ways)
            out.append((frozenset().union(*(s for w in ways for s, _, _ in w)), least, least if least == most else most if most < 4096 else UNBOUNDED))
        elif op in (c.ASSERT, c.ASSERT_NOT):
            out += [(s, 0, b) for s, _, b in _atoms(value[1], repeated)]
        elif op is c.LITERAL:
            out.append((frozenset(chr(value)), 1, 1))
        elif op is c.IN:
            out.append((_class(value), 1, 1))
        elif op in (c.ANY, c.NOT_LITERAL, c.GROUPREF):
            out.append((PRINTABLE, 1, 1))
    return out


def risk(pattern: str) -> str | None:
    """Why a pattern is not run; None if it may be."""
    if len(pattern) > MOST_CHARACTERS:
        return f"it has more than {MOST_CHARACTERS} characters"
    if re.search(r"\([^()]*\|[^()]*\)(?:[*+]|\{\d+,|\{(?!1\})\d+\})", pattern):
        return "alternatives in a repeated group"
    try:
        atoms = _atoms(parser.parse(pattern))
    except (re.error, ValueError, OverflowError) as e:
        return str(e)
    for k, (first, low, high) in enumerate(atoms):
        if low == high:
            continue
        choices = 1 if high is UNBOUNDED else high - low + 1
        for characters, a, b in atoms[k + 1 :]:
            overlaps = bool(first & characters)
            if a == b == 1 and len(characters) == 1 and high is UNBOUNDED and first == PRINTABLE:
                break  # one literal character between open repeats of any character: quadratic at worst, which the length of values bounds
            if not overlaps and a > 0:
                break  # a character that only this part can match keeps the two apart
            if overlaps and a != b:
                if high is UNBOUNDED and b is UNBOUNDED:
                    return "two open repeats that can match the same text"
                choices *= 1 if b is UNBOUNDED else b - a + 1
        if choices > MOST_CHOICES:
            return "too many ways to divide a text between its repeats"
    return None


def lint(pattern: str) -> list[str]:
    """Notation that the supported platforms read differently."""
    wrong = [] if pattern.isascii() else ["a pattern is written in ASCII"]
    bare = re.sub(r"\\\\", "", pattern)
    wrong += [f"{x} is not available in patterns" for x in (r"\A", r"\Z", "(?P<", r"\p{", r"\P{", r"\u{", r"\x{", r"\k<") if x in bare]
    return wrong


def compiles(pattern: str) -> bool:
    """Whether the JVM's regular expressions accept it, which run it."""
    from pyspark import SparkContext

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(body(pattern))
    except Exception:  # noqa: BLE001 a pattern of a user may fail in many ways, all of which mean no
        return False
    return True


def body(pattern: str) -> str:
    return pattern.removeprefix("^").removesuffix("$")


def matches(value: Column, pattern: str | None) -> Column:
    """Whether the value, upper case and trimmed, is matched as a whole. What can't be judged counts as matched."""
    if not pattern or risk(pattern) or not compiles(pattern):
        return F.lit(True)
    target = F.btrim(normalize(value, ""))
    return F.when(target.rlike(r"[^\x20-\x7E]"), True).otherwise(target.rlike(rf"\A(?:{body(pattern)})\z"))
