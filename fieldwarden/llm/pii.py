"""PII: format-preserving Feistel pseudonyms.

Personal values are found by pattern and then validated: card numbers (Luhn), IBANs (mod 97), social security numbers
(allotted ranges), telephone numbers (digit counts), IPv4 addresses (octets), calendar dates of 1900 to 2099, and e-mail
addresses. Each is mapped by a keyed permutation of its own format: a card stays a valid card of that length and
grouping, a date a date in the same notation, an e-mail's name keeps its letters, digits and marks in place. Equal
values have equal pseudonyms in every document, different values different ones, and no value that is found stays as it is
(an e-mail's host stays, as it names a provider and not a person; so does a name without letters and digits). A date written
month first (3/25/2024) is linked to itself alone, not to the same day in other notations. IPv6 addresses are not looked for.
Numbers that fail validation are left alone; a match that fails is tried again without its last words and as the other
kinds, and the search goes on one character after its start.

The permutation is a Feistel network of ten rounds over the format's value range, with a keyed BLAKE2b round function and
cycle walking; a value is taken through it, moved on by one, and back, which rules out fixed points. `reveal` undoes it.

Null texts stay null. Empty texts and texts without values are unchanged. Rows are independent of each other. Extra
columns of the input are kept by `apply` and ignored by `found`; `apply` adds none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: What a text must hold for any pattern to match.
HINT = re.compile(r"@|[0-9][0-9 ().\-/]{5}")

_PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[\w-]+\.)+[^\W\d_]{2,24}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\ [A-Z0-9]{4}){2,7}(?:\ [A-Z0-9]{1,4})?)(?!\w)",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "date": r"""(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})
        (?:(?=T[0-9]{2}:?[0-9]{2})|(?![\w/-]|\.[0-9]))""",
    "ssn": r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"""(?<!\w)\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)
      | (?<![\w.])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)
      | (?<![\w.+-])(?:\([0-9]{3}\)\ ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![\w-])""",
    "card": r"(?<![\w+-])(?<![0-9]\.)(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}|[0-9]{4}(?P<t>[ -])[0-9]{6}(?P=t)[0-9]{5})(?![\w-])",
}
FINDER = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _PATTERNS.items()), re.VERBOSE)
_KIND = {kind: re.compile(p, re.VERBOSE) for kind, p in _PATTERNS.items()}
#: The length of each country's IBANs, which is tried first; other lengths and countries count by mod 97 alone.
IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 "
        "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 "
        "PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


class Permutation:
    """A keyed permutation of 0 .. n-1 without fixed points, for n of at least 2."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.a = isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        self.key = blake2b(f"{kind}/{n}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, i: int, half: int, most: int) -> int:
        raw = half.to_bytes((half.bit_length() + 7) // 8 or 1)
        return int.from_bytes(blake2b(bytes([i]) + raw, key=self.key, digest_size=32).digest()) % most

    def _walk(self, x: int, rounds: range, sign: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in rounds:
                if i % 2:
                    right = (right + sign * self._f(i, left, self.b)) % self.b
                else:
                    left = (left + sign * self._f(i, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def shift(self, x: int, by: int = 1) -> int:
        """by 1: the pseudonym; by -1: what it stands for."""
        moved = (self._walk(x, range(ROUNDS), 1) + by) % self.n
        return self._walk(moved, range(ROUNDS - 1, -1, -1), -1)


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(v: str, move: Callable) -> str | None:
    d = re.sub(r"[^0-9]", "", v)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    low = 10 ** (len(d) - 2) if d[0] != "0" else 0
    body = str(move(f"card{len(d)}", int(d[:-1]) - low, 10 ** (len(d) - 1) - low if low else 10 ** (len(d) - 2)) + low).rjust(len(d) - 1, "0")
    return _refill(v, body + luhn_digit(body))


@lru_cache(4096)
def _class(c: str) -> str:
    """The characters that c may become: ASCII letters of its case, digits, or the letters of its case in its block of 128 code points."""
    for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
        if c in s:
            return s
    if c.isascii() or not c.isalnum():
        return ""
    block = ord(c) & ~127
    return "".join(x for x in map(chr, range(block, block + 128)) if x.isalnum() and (x.islower(), x.isupper(), x.isdigit()) == (c.islower(), c.isupper(), c.isdigit()))


def _mixed(text: str, kind: str, move: Callable) -> str | None:
    """The text with its letters and digits moved within their classes."""
    own = [_class(c) for c in text]
    n, value = 1, 0
    for c, s in zip(text, own, strict=True):
        if s:
            n, value = n * len(s), value * len(s) + s.index(c)
    if n < 2:
        return None
    shape = "".join(s[0] if s else c for c, s in zip(text, own, strict=True))
    value = move(f"{kind}{shape}", value, n)
    out = []
    for c, s in zip(reversed(text), reversed(own), strict=True):
        if s:
            value, k = divmod(value, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _email(v: str, move: Callable) -> str | None:
    name, _, host = v.partition("@")
    changed = _mixed(name, "email", move)
    return changed and f"{changed}@{host}"


def _iban_remainder(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _iban(v: str, move: Callable) -> str | None:
    flat = v.replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if len(flat) < 15 or _iban_remainder(country, check, body) != 1 or not (changed := _mixed(body, f"iban{country}", move)):
        return None
    flat = iter(country + f"{98 - _iban_remainder(country, '00', changed):02d}" + changed)
    return "".join(c if c == " " else next(flat) for c in v)


def _ip(v: str, move: Callable) -> str | None:
    octets = [int(x) for x in v.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in v.split(".")):
        return None
    x = move("ip", int.from_bytes(bytes(octets)), 1 << 32)
    return ".".join(map(str, x.to_bytes(4)))


FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_LATE_DAYS = [k for k in range(DAYS) if (FIRST_DAY + timedelta(k)).day > 12]


def _date(v: str, move: Callable) -> str | None:
    mark = next(c for c in v if not c.isdigit())
    parts = [int(x) for x in v.split(mark)]
    order = "ymd" if len(v.split(mark)[0]) == 4 else "mdy" if mark == "/" and parts[1] > 12 else "dmy"
    y, m, d = (parts[order.index(c)] for c in "ymd")
    try:
        day = (date(y, m, d) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    if order == "mdy":  # in this notation only days over 12 show which part is the month
        day = _LATE_DAYS[move("mdy", _LATE_DAYS.index(day), len(_LATE_DAYS))]
    else:
        day = move("date", day, DAYS)
    new = FIRST_DAY + timedelta(day)
    wide = mark == "-" or all(len(x) > 1 for x in v.split(mark))
    width = 2 if wide else 1
    return mark.join(f"{new.year:04d}" if c == "y" else f"{(new.month if c == 'm' else new.day):0{width}d}" for c in order)


def _ssn(v: str, move: Callable) -> str | None:
    area, group, serial = map(int, v.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    x = move("ssn", (areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(v: str, move: Callable) -> str | None:
    head = re.match(r"\+1(?=[^0-9]|[0-9]{10})|\+[0-9]{1,3}|", v)[0]  # the country's digits stay
    rest = v[len(head) :]
    digits = re.sub(r"[^0-9]", "", rest)
    if not 6 <= len(digits) <= 14:
        return None
    return head + _refill(rest, str(move(f"phone{len(digits)}", int(digits), 10 ** len(digits))).rjust(len(digits), "0"))


KINDS: dict[str, Callable] = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


class Pseudonyms:
    """by 1 gives pseudonyms, by -1 gives back what they stand for."""

    def __init__(self, key: bytes, by: int = 1):
        permutation = lru_cache(4096)(lambda kind, n: Permutation(key, kind, n))
        self.one = lru_cache(1 << 16)(lambda kind, v: KINDS[kind](v, lambda k, x, n: permutation(k, n).shift(x, by)))

    def at(self, text: str, start: int, first: str) -> tuple[str, int, str | None]:
        """Kind, end and pseudonym of the first valid value at a place, of the kind first or a later one; no pseudonym if there is none."""
        kinds = list(KINDS)
        for kind in kinds[kinds.index(first) :]:
            if not (m := _KIND[kind].match(text, start)):
                continue
            ends = [m.end(), *(start + k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " " and _KIND[kind].fullmatch(text, start, start + k))]
            if kind == "iban":  # false sorts first
                ends.sort(key=lambda e: len(text[start:e].replace(" ", "")) != IBAN_LENGTH.get(text[start : start + 2]))
            for end in ends:
                if end < m.end() and (c := _KIND["card"].search(text, start + 1)) and c.start() < end < c.end() and self.one("card", c[0]):
                    continue  # it would cut a card in two
                if (new := self.one(kind, text[start:end])) is not None:
                    return kind, end, new
        return first, start, None

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, start and end of each value found in the given text."""
        spans: list[tuple[str, int, int]] = []
        if not text or not HINT.search(text):
            return text, spans
        out, done, at = [], 0, 0
        while m := FINDER.search(text, at):
            kind, end, new = self.at(text, m.start(), m.lastgroup if m.lastgroup in KINDS else "card")
            if new is None:
                at = m.start() + 1  # another value may begin inside of what is none
                continue
            out += [text[done : m.start()], new]
            at = done = end
            spans.append((kind, m.start(), end))
        return ("".join([*out, text[done:]]) if spans else text), spans


def found(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, and the values found: kind, start and end (code points of the given text)."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            rows = [names.replace(t.as_py()) for t in batch.column("text")]
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for _, s in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in rows], pa.string()), pa.array(found, spans)], ["doc_id", "text", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<kind string, start int, end int>>")


def apply(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in text; all other columns as they are."""

    @F.pandas_udf("string")
    def replaced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = Pseudonyms(key)
        for t in texts:
            yield pd.Series([names.replace(x)[0] for x in t], dtype=object)

    return docs.withColumn("text", replaced("text"))


def reveal(text: str, key: bytes) -> str:
    """What a text with pseudonyms was, for whoever holds the key."""
    return Pseudonyms(key, -1).replace(text)[0]
