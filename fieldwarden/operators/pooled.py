"""Pooled identifiers: a field that holds several IDs run together is cut into IDs and junk.

Values are brought into their form by column expressions and cut in Arrow batches: which lengths make a valid ID at each position and the best
choice among them are found for all texts of a batch at once; only the pieces are written text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldwarden.functions import identifiers, patterns, windows

MOST_LENGTH, MOST_LENGTHS, MOST_KEEP, WORK, MOST_TEXT, LEAST_TEXT = 64, 32, 64, 2_000_000, 4096, 256


@dataclass(frozen=True)
class Pool:
    """How the IDs of a pool look. `problem` says why a configuration can't be used."""

    algorithm: str = identifiers.DEFAULT
    source: str = "normalized_id"
    strip: str = identifiers.STRIP
    pattern: str | None = None
    lengths: tuple[int, ...] = ()
    least: int = 8
    most: int = 14
    keep: str = ""
    expected: int | None = None

    @property
    def checks(self) -> bool:
        return self.algorithm != "none"

    def sizes(self) -> list[int]:
        if self.lengths:
            return sorted(set(self.lengths))
        return list(range(max(self.least, identifiers.ALGORITHMS[self.algorithm][2] + 1), self.most + 1))

    def problem(self) -> str | None:
        if self.algorithm not in identifiers.ALGORITHMS:
            return f"unknown algorithm {self.algorithm}"
        if not self.checks and not self.pattern:
            return "neither a check algorithm nor a pattern"
        if self.pattern and (why := patterns.risk(self.pattern)):
            return f"the pattern is not run: {why}"
        if self.pattern and not patterns.compiles(self.pattern):
            return "the pattern does not compile"
        if len(self.keep) > MOST_KEEP or re.search(r"[^\x20-\x7E]", self.keep):
            return "kept characters are printable ASCII, 64 at most"
        if self.lengths:
            if min(self.lengths) < 1 or any(a + b in self.lengths for a in self.lengths for b in self.lengths):
                return "one length is the sum of two others"
        elif not 1 <= self.least <= self.most < 2 * self.least:
            return "the longest ID must be shorter than two of the shortest"
        sizes = self.sizes()
        if not sizes or sizes[-1] > MOST_LENGTH or len(sizes) > MOST_LENGTHS:
            return "too long or too many lengths"
        return None

    def kept(self) -> str:
        """The characters that are not dropped before the cutting."""
        extra = self.keep + identifiers.ALGORITHMS[self.algorithm][1]
        if self.pattern:
            for escape, plain in re.findall(r"\\(.)|(.)", self.pattern):
                if escape in set(r"\^$.|?*+()[]{}") or plain and not plain.isalnum() and plain not in r"\^$.|?*+()[]{}":
                    extra += escape or plain
        return "".join(dict.fromkeys(identifiers.LETTERS + identifiers.DIGITS + extra))

    def longest_text(self) -> int:
        sizes = self.sizes()
        return min(MOST_TEXT, max(LEAST_TEXT, WORK // (len(sizes) * sizes[-1])))


PIECE = "struct<type:string,text:string,valid:boolean>"
#: Positions of a batch's texts, padded to the longest, that are cut at a time.
PLACES = 1 << 21
# A cut's score in one number that grows with its worth: IDs, then few runs of junk, then a short longest ID, then junk, then junk here, then a short ID here.
_IDS, _RUNS, _LONGEST, _JUNK = 1 << 40, 1 << 27, 1 << 20, 1 << 7
_NONE = 8191 * _RUNS + 64 * _LONGEST + 64


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often a lambda reads it."""
    return F.get(F.transform(F.array(value), use), 0)


class Cutter:
    """Cuts many texts at once: check sums over all windows of a length together, and the best cut of all texts by one dynamic programme."""

    def __init__(self, pool: Pool):
        self.pool, self.sizes = pool, pool.sizes()
        self.whole = re.compile(patterns.body(pool.pattern), re.ASCII).fullmatch if pool.pattern else None
        self.stripped = np.zeros(128, bool)
        if pool.checks:  # what is stripped once it is in upper case
            self.stripped[[ord(c) for c in pool.strip if ord(c) < 128 and c == c.upper()]] = True

    def valid(self, texts: list[str]) -> np.ndarray:
        """By length of an ID, text and position, whether an ID of that length begins there."""
        raw = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), 127)  # no alphabet has others
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        owner, place = np.repeat(np.arange(len(texts)), lengths), np.arange(len(raw)) - np.repeat(starts, lengths)
        plain = raw[~self.stripped[raw]]
        before = np.append(0, np.cumsum(~self.stripped[raw]))  # characters that count before each
        out = np.zeros((len(self.sizes), len(texts), int(lengths.max(initial=0)) + 1), bool)
        for k, size in enumerate(self.sizes):
            at = np.flatnonzero(place + size <= lengths[owner])
            if self.pool.checks:
                at = at[windows.valid(self.pool.algorithm, plain, before[at], before[at + size], self.pool.source)]
            if self.whole:
                at = at[np.fromiter((bool(self.whole(texts[t][i : i + size])) for t, i in zip(owner[at].tolist(), place[at].tolist(), strict=True)), bool, len(at))]
            out[k, owner[at], place[at]] = True
        return out

    def moves(self, texts: list[str]) -> list[list[int]]:
        """By position, the length of the ID to take there, 0 for a character of junk.

        The best cut has most IDs, then fewest runs of junk, then the shortest longest ID, then most junk; ties keep junk, then the
        shorter ID. It is found from the last position to the first.
        """
        valid = self.valid(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        best = np.full((valid.shape[2] + 1, len(texts)), _NONE)  # by characters from the end
        for left in range(1, valid.shape[2]):
            own = np.flatnonzero(lengths >= left)
            at = lengths[own] - left
            after = best[left - 1, own]
            opens = (left == 1) | (after % 128 < 64)
            score = after - after % 128 + 64 + _JUNK - np.where(opens, _RUNS, 0)
            for k, size in enumerate(self.sizes):
                if size > left:
                    break
                rest = best[left - size, own]
                longest = rest // _LONGEST % 128
                taken = rest - rest % 128 + 64 - size + _IDS - np.maximum(longest - (64 - size), 0) * _LONGEST
                score = np.where(valid[k, own, at], np.maximum(score, taken), score)
            best[left, own] = score
        moved = 64 - best % 128
        return [moved[n:0:-1, t].tolist() for t, n in enumerate(lengths.tolist())]

    def pieces(self, text: str, moves: list[int]) -> list[tuple[str, str, bool | None]]:
        """The pieces of a text by its moves; in junk, what looks like an ID is one that fails its check."""
        out: list[tuple[str, str, bool | None]] = []
        i, junk, ends = 0, 0, len(text)
        following = [k for k, m in enumerate(moves) if m > 0]
        following.reverse()

        def close(to: int) -> None:
            if junk < to:
                out.append(("junk", text[junk:to], None))

        while i < ends:
            while following and following[-1] <= i - 1:
                following.pop()
            size, good = moves[i], True
            if not size and self.whole and self.pool.checks:
                room = (following[-1] if following else ends) - i
                size, good = next((s for s in range(self.sizes[0], min(self.sizes[-1], room) + 1) if self.whole(text[i : i + s])), 0), False
            if size:
                close(i)
                out.append(("id", text[i : i + size], good))
                junk = i + size
            i += size or 1
        close(ends)
        return out

    def cut(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The pieces of each text, by runs of texts of about one length, so that little is padded."""
        order = sorted((k for k, t in enumerate(texts) if t is not None), key=lambda k: len(texts[k]))
        out: list[list[tuple] | None] = [None] * len(texts)
        while order:
            size = max(1, PLACES // (len(texts[order[-1]]) + 2))
            run, order = order[-size:], order[:-size]
            own = [texts[k] for k in run]
            for k, t, m in zip(run, own, self.moves(own), strict=True):
                out[k] = self.pieces(t, m)
        return out


def segments(value: Column, pool: Pool) -> Column:
    """The pieces of a value in order; null if it is null or longer than the pool's bound on work."""

    @F.arrow_udf(f"array<{PIECE}>")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter = Cutter(pool)
        for texts in parts:
            made = cutter.cut(texts.to_pylist())
            flat = [p for own in made if own for p in own]
            columns = [pa.array([p[k] for p in flat], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
            ends = np.cumsum([0, *(len(own or ()) for own in made)])
            pieces = pa.StructArray.from_arrays(columns, ["type", "text", "valid"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces, mask=pa.array([own is None for own in made]))

    return cut(F.when(F.length(value) <= pool.longest_text(), identifiers.normalize(value, "", keep_only=pool.kept())))


def reasons(cut: Column, pool: Pool) -> Column:
    """What is wrong with a pool, joined by ';': no-id, check-character, junk, duplicate, count. Empty if nothing is."""
    return _let(cut, lambda c: F.when(c.isNotNull(), _reasons(c, pool)))


def _reasons(cut: Column, pool: Pool) -> Column:
    ids = F.filter(cut, lambda s: s["type"] == "id")
    texts = F.transform(ids, lambda s: s["text"])
    count = F.size(ids) != pool.expected if pool.expected else F.lit(False)
    found = (
        (F.size(ids) == 0, "no-id"), (F.exists(ids, lambda s: ~s["valid"]), "check-character"), (F.exists(cut, lambda s: s["type"] == "junk"), "junk"),
        (F.size(texts) > F.size(F.array_distinct(texts)), "duplicate"), (count, "count"),
    )
    return F.concat_ws(";", *[F.when(test, name) for test, name in found])
