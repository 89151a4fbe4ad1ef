"""Sets of word shingles as sorted 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random odd number for each byte, the same for A-Z as for a-z.
_VALUES = mixed(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + _MIX) | np.uint64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as a slice has needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, _BACK))
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice in order, and how many words stand before each text and in all."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns[:-1] == 1), np.flatnonzero(turns == -1)
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # the next text begins within a run
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    m = max(len(words) - k + 1, 0)
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + m]) * _MIX
        h ^= h >> np.uint64(29)
    return mixed(h)


def sets(column: pa.Array, k: int, powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, offsets) of consecutive texts: the distinct k-word shingles of each text, sorted.

    Words: A-Z in lower case, parted by ASCII white space. Fewer than k words are one shingle.
    """
    for data, offsets in slices(column):
        words, first = word_hashes(data, offsets, powers)
        count = np.diff(first)
        sizes = np.where(count >= k, count - k + 1, count > 0)
        to = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(to[-1], np.uint64)
        whole = count >= k
        own = np.where(whole, sizes, 0)
        at = np.repeat(first[:-1] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        out[np.repeat(whole, sizes)] = rolled(words, k)[at]
        for n in range(1, k):
            few = np.flatnonzero(count == n)
            if len(few):
                out[to[few]] = rolled(words[first[few][:, None] + np.arange(n)].ravel(), n)[::n]
        places = to.tolist()
        for a, b in zip(places[:-1], places[1:]):
            if b - a > 1:
                out[a:b].sort()
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[to[:-1][sizes > 0]] = True
        yield out[keep], np.concatenate([[0], np.cumsum(keep)])[to]
