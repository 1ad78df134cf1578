"""MinHash signatures of many sets at once, and hashes of shingles."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
CACHED = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(symbols: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` symbols in a row."""
    base = np.uint64(0xD6E8FEB86659FD93)
    h = symbols[:len(symbols) - width + 1] * np.uint64(1)
    for k in range(1, width):
        h = h * base + symbols[k:len(symbols) - width + 1 + k]
    return mixed(h)


class MinHash:
    """`size` minima of as many hash functions."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.times = rng.integers(1 << 31, 1 << 32, size, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)

    def of(self, values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Signatures (sets x size, uint32) of the sets ``values[start:start + count]``, in ascending order and none empty."""
        low = (values >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(start), len(self.times)), np.uint32)
        a = 0
        while a < len(start):  # as many sets at a time as stay in the cache
            b = max(a + 1, int(np.searchsorted(start, start[a] + CACHED)))
            part = low[start[a]:start[b - 1] + count[b - 1]]
            edges = np.empty(2 * (b - a), np.int64)
            edges[0::2] = start[a:b] - start[a]
            edges[1::2] = edges[0::2] + count[a:b]
            edges = edges[:-1]
            for k in range(len(self.times)):
                out[a:b, k] = np.minimum.reduceat(part * self.times[k] + self.plus[k], edges)[::2]
            a = b
        return out
