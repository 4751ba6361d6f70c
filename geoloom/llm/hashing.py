"""Vectorised hashes of bytes, words and spans of them.

A span's hash is a polynomial over the 64-bit ring with random odd-mixed symbol values,
taken from prefix sums, so any span costs one subtraction and one multiplication. Texts can be made that agree in it, so it only ever says
what may be equal (minimisers, places in a table); where equality counts, bytes are compared, or keyed_hashes (SipHash) and it together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n at least, modulo 2^64."""
    size = -(-n // (1 << 17)) << 17
    have = next(iter(_powers), 0)
    if have >= size:
        size = have
    else:
        _powers.clear()
        one = np.ones(1, np.uint64)
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            both.append(np.concatenate([one, np.cumprod(np.full(size - 1, b, np.uint64))]))
        _powers[size] = (both[0], both[1])
    return _powers[size]


#: A random 64-bit value for each byte; and the same with A-Z read as a-z.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_fold = np.arange(256)
_fold[65:91] += 32
BYTE_LOWER = BYTE[_fold]
#: x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class Spans:
    """Hashes of spans [s, e) of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray) -> None:
        pow_, self.inverse = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * pow_[: len(symbols)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Of every span of this length."""
        n = len(self.sums) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.inverse[:n])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (by default [^ \\t-\\r]+) of texts on end, and the first word of each text (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the first word of each text (one more than texts)."""
    s, e, first = words(data, offsets)
    if not len(s):
        return np.zeros(0, np.uint64), first
    return Spans((BYTE_LOWER if lower else BYTE)[data]).of(s, e), first


def keyed_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """SipHash of each word of data, which holds no word that goes over the end of a text; in the order of words()."""
    blob = data.tobytes()
    parts = (blob.lower() if lower else blob).split()  # bytes are split at x20 and x09 to x0D, and A-Z alone are lower-cased
    return pd.util.hash_array(np.array(parts, dtype=object), categorize=False) if parts else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < width:
        x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
    return x


def expand(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... n of them, for each."""
    if not len(begin):
        return np.zeros(0, np.int64)
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(before, n) + np.repeat(begin, n)
