"""Check characters of many windows of many texts at once: numpy inside Spark tasks, for operators that try every cut of a text.

The result for a window is that of `identifiers.validate_id` over it, by arrays: all windows take one step a character together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from fieldwarden.functions import identifiers as I

Array = np.ndarray


def codes_of(alphabet: str) -> Array:
    """The number in an alphabet of each ASCII character, -1 for others."""
    out = np.full(128, -1, np.int64)
    for k, c in enumerate(alphabet):
        out[ord(c)] = k
    return out


def _fold(codes: Array, lo: Array, hi: Array, source: str, size: int, start: int, step: Callable[[Array, Array, Array], Array], backwards: bool) -> tuple[Array, Array]:
    """The state after the payloads in [lo, hi), and whether each payload has characters and all of them are in the alphabet."""
    state, turn = np.full(len(lo), start, np.int64), np.zeros(len(lo), np.int64)
    fine, begun, ended = np.ones(len(lo), bool), np.zeros(len(lo), bool), np.zeros(len(lo), bool)
    for j in range(int((hi - lo).max(initial=0))):
        live = lo + j < hi
        c = codes[np.where(live, hi - 1 - j if backwards else lo + j, 0)]
        digit = (c >= 0) & (c < 10)
        if source == "normalized_id":
            use = live
            fine &= ~live | (c >= 0) & (c < size)
        elif source == "digits_only":
            use = live & digit
        elif backwards:  # the last run of digits, which comes first
            ended |= live & begun & ~digit
            use = live & digit & ~ended
            begun |= use
        else:  # a new run begins anew
            use = live & digit
            fresh = use & ~begun
            state, turn = np.where(fresh, start, state), np.where(fresh, 0, turn)
            begun = np.where(live, digit, begun)
        state = np.where(use, step(state, np.maximum(c, 0), turn), state)
        turn += use
    return state, fine & (turn > 0)


def _cyclic(weights: tuple[int, ...]) -> Callable[[Array, Array, Array], Array]:
    table = np.array(weights)
    return lambda a, d, t: a + d * table[t % len(table)]


def _twice(a: Array, m: int) -> Array:
    return np.where(a == 0, m, a) * 2 % (m + 1)


def _hybrid(m: int) -> tuple:
    return m // 2, lambda a, d, t: (_twice(a, m) + d % m) % m, False, lambda a: (1 - _twice(a, m)) % m


def _pure(m: int, r: int) -> tuple:
    return 0, lambda a, d, t: (a + d) * r % m, False, lambda a: (1 - a) % m


def _verhoeff() -> tuple:
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([I.VERHOEFF[x] for x in powers[-1]])
    power, product = np.array(powers), np.array([[I.dihedral(a, b) for b in range(10)] for a in range(10)])
    return 0, lambda a, d, t: product[a, power[(t + 1) % 8, np.minimum(d, 9)]], True, lambda a: np.array(I.INVERSE)[a]


_DAMM = np.array([[int(x) for x in row] for row in I.DAMM])
#: By algorithm: the first state, the step, whether it goes backwards, and the check characters' number of a last state.
STEPS = {
    "iso7064_mod11_2": _pure(11, 2), "iso7064_mod37_2": _pure(37, 2), "iso7064_mod97_10": (0, lambda a, d, t: (a + d) * 10 % 97, False, lambda a: 98 - a * 10 % 97),
    "iso7064_mod11_10": _hybrid(10), "iso7064_mod37_36": _hybrid(36), "iso7064_letters1": _hybrid(26), "iso7064_letters2": _hybrid(36),
    "damm": (0, lambda a, d, t: _DAMM[a, np.minimum(d, 9)], False, lambda a: a), "verhoeff": _verhoeff(),
    "luhn": (0, lambda a, d, t: a + np.where(t % 2 == 0, np.where(d > 4, d * 2 - 9, d * 2), d), True, lambda a: -a % 10),
    "gs1_mod10": (0, _cyclic((3, 1)), True, lambda a: -a % 10), "aba_mod10": (0, _cyclic((3, 7, 1)), False, lambda a: -a % 10),
    "mrz_mod10": (0, _cyclic((7, 3, 1)), False, lambda a: a % 10), "weighted_mod11": (0, lambda a, d, t: a + d * (t + 2), True, lambda a: -a % 11),
}


def valid(algorithm: str, text: Array, lo: Array, hi: Array, source: str = "normalized_id") -> Array:
    """Whether the last characters of each window [lo, hi) are the check characters of what comes before. text: the codes of ASCII characters, without stripped ones."""
    alphabet, letters, n, _ = I.ALGORITHMS[algorithm]
    if not n:
        return np.ones(len(lo), bool)
    ok = hi - lo > n
    lo, hi = np.where(ok, lo, 0), np.where(ok, hi, n)
    if not len(text):
        return ok
    start, step, backwards, finish = STEPS[algorithm]
    state, fine = _fold(codes_of(I.ALNUM)[text], lo, hi - n, source, len(alphabet), start, step, backwards)
    number = finish(state)
    told = codes_of(letters)[text[np.minimum(hi[:, None] - n + np.arange(n), len(text) - 1)]]
    base = {"iso7064_mod97_10": 10, "iso7064_letters2": 6}.get(algorithm)
    want = np.stack([number // base, number % base], axis=1) if base else number[:, None]
    return ok & fine & (told == want).all(axis=1)
