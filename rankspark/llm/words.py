"""Words and word shingles of many texts at once, as 64-bit hashes."""
from __future__ import annotations

import numpy as np

#: Word separators: space, and the control characters 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
BYTE_LOWER = BYTE[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR,
                lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word in order, and the word offsets of each row.

    A word's hash is the difference of two prefix sums of byte x power, freed of its position by the inverse power: the
    cost is a few passes over the bytes, however many words there are.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((BYTE_LOWER if lower else BYTE)[data] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end, np.searchsorted(start, offsets)


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a row, and their row offsets; a shorter row with words has one."""
    counts = np.diff(rows)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    first = rows[row] + np.arange(at[-1]) - at[row]
    left = np.minimum(counts[row], size)
    out = left.astype(np.uint64)
    for i in range(size):
        here = words[np.minimum(first + i, max(len(words) - 1, 0))] if len(words) else words
        step = mix(here + out * np.uint64(BASE))
        out = step if size == 1 or (left > i).all() else np.where(left > i, step, out)
    return out, at
