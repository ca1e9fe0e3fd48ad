"""Vectorised hashing of the words of many texts at once (numpy, inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that belong to a word: letters, digits and every byte of a non-ASCII character.
IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept from call to call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: Iterable[str | None], size: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of consecutive texts of about `size` characters; null counts as empty."""
    run: list[str] = []
    held = 0
    for t in texts:
        run.append(t or "")
        held += len(run[-1])
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of the lower-cased texts, and the index of the text it is in."""
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    buffer = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    inside = IS_WORD[buffer]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edges[0::2], edges[1::2]
    n = len(buffer)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    h = mix((total[ends] - total[starts]) * powers(INVERSE, n)[starts])
    limits = np.cumsum([len(c) + 1 for c in coded])
    return h, np.searchsorted(limits, starts, side="right")
