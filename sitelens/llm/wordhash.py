"""Words and word shingles of whole texts as 64-bit hashes, computed over UTF-8 bytes with numpy.

A word's hash is a polynomial modulo 2**64 over random byte values, then mixed; a shingle's mixes the hashes of
its words in order. Two different shingles agree with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P = int(_rng.integers(2**40, 2**62)) | 1
_PINV = pow(_P, -1, 2**64)
_STEP = [U(int(x) | 1) for x in _rng.integers(2**40, 2**62, 64)]
_KEPT = 1 << 21
_powers: list[np.ndarray] = [np.zeros(0, U), np.zeros(0, U)]


def _fold(table: np.ndarray) -> np.ndarray:
    table = table.copy()
    table[65:91] = table[97:123]
    return table


#: Bytes inside a word: anything but ASCII white space; letters A-Z are folded by the byte values.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes inside a word of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
_VALUE = _fold(_BYTES)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_P, _PINV)):
            p = np.full(size, U(base), U)
            p[0] = U(1)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the byte at which each starts, and for each text its first word (one entry more)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ok = inside[data]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = ok[heads]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U), starts, bounds
    power, inverse = _pow(n)
    value = _VALUE[data] * power
    value[~ok] = 0
    if n > _KEPT:  # what a very long text needed goes again
        _powers[:] = [x[:_KEPT].copy() for x in _powers]
    return mix(np.add.reduceat(value, starts) * inverse[starts]), starts, bounds


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; k - 1 fewer than words."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    s = h[:m] * _STEP[0]
    for j in range(1, k):
        s += h[j : j + m] * _STEP[j % len(_STEP)] + U(j // len(_STEP))
    return mix(s)


def sequence(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence of words, apart from those of other lengths."""
    s = U(len(h))
    with np.errstate(over="ignore"):
        for j, x in enumerate(h):
            s = s * U(0x9E3779B97F4A7C15) + x * _STEP[j % len(_STEP)]
    return mix(np.array([s], U))[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, inside: np.ndarray = SPACED) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; fewer words, not none: the whole sequence as one."""
    h, _, bounds = words(data, offsets, inside)
    s = shingles(h, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
        else:
            out.append(np.array([sequence(h[a:b])], U) if b > a else np.zeros(0, U))
    return out
