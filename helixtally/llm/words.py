"""Hashes of words and of runs of words, for tasks that work on whole texts in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

_LONGEST = 64
_ODD = np.random.default_rng(7).integers(0, 1 << 63, _LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes:
    """Word -> 64-bit hash. None is remembered: hashing a word is faster than finding it in a large dict, and takes no memory."""

    __getitem__ = staticmethod(xxhash.xxh3_64_intdigest)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on; positions without n words have no meaning."""
    total = len(hashes)
    out = np.zeros(total, np.uint64)
    for j in range(n):
        out[: max(0, total - j)] += hashes[j:] * _ODD[j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))
