"""Vectorised word hashing over the bytes of many texts at once.

A word is a run of bytes other than space and 0x09-0x0D. Its 64-bit hash is a polynomial over random byte
values modulo 2^64, taken from one running sum over the whole buffer and then mixed with the word's length, so
that no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words of ASCII letters, ASCII digits and everything beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a run of texts: start, end, hash (all arrays over words) and counts of words by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray = _IS_SPACE):
        n = len(data)
        self.counts = np.zeros(len(offsets) - 1, np.int64)
        self.start = self.end = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        self._sums = np.zeros(1, np.uint64)
        if n:
            space = separators[data]
            before = np.empty(n, bool)
            before[0] = True
            before[1:] = space[:-1]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = True
            after = np.empty(n, bool)
            after[-1] = True
            after[:-1] = space[1:]
            after[inner - 1] = True
            self.start = np.flatnonzero(before & ~space)
            self.end = np.flatnonzero(after & ~space) + 1
            self.counts = np.diff(np.searchsorted(self.start, offsets))
            up, down = power_tables(n)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up, out=self._sums[1:])
            self._down = down
            self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans of the same buffer."""
        if not len(start):
            return np.zeros(0, np.uint64)
        h = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def windows(words: np.ndarray, counts: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay inside one text: hash, index of the first word, number by text."""
    numbers = np.maximum(counts - k + 1, 0)
    total = int(numbers.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), numbers
    first = np.cumsum(counts) - counts
    begin = np.cumsum(numbers) - numbers
    at = np.arange(total) + np.repeat(first - begin, numbers)
    steps = np.random.default_rng(salt).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(words) - k + 1
    h = words[:n] * steps[0]
    for j in range(1, k):
        h += words[j : j + n] * steps[j]
    return mix(h[at]), at, numbers


def sequence_hash(words: np.ndarray, salt: int) -> int:
    """Hash of a short sequence of word hashes with its length."""
    h = np.uint64(len(words) + 1) * np.uint64(salt * 2 + 1)
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(np.array([h * np.uint64(0x9FB21C651E98DF25) + w], np.uint64))[0]
    return int(h)
