"""Words and word windows of many texts at once, as 64-bit hashes in numpy.

A hash is a polynomial over the bytes (or over the hashes of words) modulo 2**64, taken from prefix
sums, then mixed. Every function works on one slice of texts: their bytes in a row, and offsets.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_Q = np.uint64(0xD1342543DE82EF95 | 3)

#: Bytes of words by white space (0x20, 0x09-0x0D separate), and by letters, digits and all beyond ASCII.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False
BY_SIGN = np.zeros(256, bool)
BY_SIGN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._run(self.base, size), self._run(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 offsets of each text's words among them."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    start, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, off)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _BYTES.to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, whatever text they are in: ``inside`` tells which count."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.to(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[n:] - total[:m]) * down[:m] + np.uint64(n))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n words that lie in one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    ok = np.zeros(total + 1, np.int32)
    counts = np.diff(first)
    long = counts >= n
    np.add.at(ok, first[:-1][long], 1)
    np.add.at(ok, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def whole(words: np.ndarray) -> int:
    """The hash of all the words as one run."""
    return int(grams(words, len(words))[0])
