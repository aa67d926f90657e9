"""Word and shingle hashing of whole texts with numpy, inside tasks.

A word is a run of bytes other than space and 0x09-0x0D; ``bytes.split()`` cuts exactly there.
"""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words (then forgotten and begun anew)."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every window of k words; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        acc = mix(acc * _P + h[j : j + n])
    return acc


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word windows; fewer words count as one window, no words as none."""
    return np.unique(windows(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)
