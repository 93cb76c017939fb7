"""Vectorised 2-bit k-mer codes over a buffer of base characters.

A window of length k is assembled from windows of power-of-two length: two
neighbouring windows of lengths a and b give the window of length a + b with one
shift and one OR. A 21-mer so takes 6 combinations (1, 2, 4, 8, 16 and 16+4+1)
instead of 21 steps, and short windows use narrow integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

INVALID = 4
_STEP = 1 << 17  # windows per slice: the work arrays of a slice stay cache-sized


def base_table(u_as_t: bool = True) -> np.ndarray:
    """Byte -> 2-bit code (A0 C1 G2 T3, either case), 4 for every other byte."""
    table = np.full(256, INVALID, np.uint8)
    for code, letters in enumerate(("Aa", "Cc", "Gg", "TtUu" if u_as_t else "Tt")):
        for letter in letters:
            table[ord(letter)] = code
    return table


def _width(length: int) -> type:
    """Narrowest unsigned type that holds 2 bits per base."""
    for limit, dtype in ((4, np.uint8), (8, np.uint16), (16, np.uint32)):
        if length <= limit:
            return dtype
    return np.uint64


def _join(left, right, a: int, b: int, forward: bool) -> np.ndarray:
    """Windows of length a + b from those of length a and of length b."""
    dtype = _width(a + b)
    n = len(right) - a
    head, tail = left[:n].astype(dtype), right[a:].astype(dtype)
    if forward:
        return (head << dtype(2 * b)) | tail
    return (tail << dtype(2 * a)) | head


def windows(codes: np.ndarray, k: int, forward: bool) -> np.ndarray:
    """Code of every length-k window; ``forward=False`` puts the first base lowest."""
    power, length, done, covered = codes, 1, None, 0
    while True:
        if k & length:
            done = power if done is None else _join(done, power, covered, length, forward)
            covered += length
        if covered == k:
            return done
        power = _join(power, power, length, length, forward)
        length *= 2


def slices(
    data: np.ndarray, ends: np.ndarray | None, k: int, table: np.ndarray, step: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (2-bit digits, mask of valid window starts) for slices of ``step`` windows.

    A slice overlaps the next one by k - 1 characters. Slices without any valid
    window come with an all-false mask; digits at invalid characters are arbitrary.
    """
    back = np.arange(1, k)
    for lo in range(0, len(data) - k + 1, step):
        part = data[lo : lo + step + k - 1]
        digits = table[part]
        n = len(part) - k + 1
        keep = np.ones(n, bool)
        bad = digits == INVALID
        if bad.any():
            seen = np.zeros(len(part) + 1, np.int32)
            np.cumsum(bad, out=seen[1:])
            keep = seen[k:] == seen[:n]
            digits &= 3
        if ends is not None and k > 1:
            inside = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + len(part), "left")]
            crossing = (inside[:, None] - back).ravel() - lo
            keep[crossing[(crossing >= 0) & (crossing < n)]] = False
        yield digits, keep


def canonical_slices(
    data: np.ndarray, ends: np.ndarray | None, k: int, table: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield ``(start positions, canonical codes)`` of all windows of k valid bases.

    ``data`` holds the characters of many reads back to back. ``ends`` gives the
    end of each read, sorted; no window spans one. It may be None where a
    separator byte already follows every read.
    """
    for number, (digits, keep) in enumerate(slices(data, ends, k, table, _STEP)):
        starts = np.flatnonzero(keep)
        if len(starts):
            least = np.minimum(windows(digits, k, True), windows(3 - digits, k, False))
            yield starts + number * _STEP, least[starts].astype(np.int64)
