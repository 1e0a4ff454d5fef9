"""Words of many texts at once: boundaries and 64-bit hashes from the UTF-8 bytes, without a loop over words."""

from __future__ import annotations

import numpy as np

#: The separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True

#: A-Z to a-z, all other bytes as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    n = len(raw)
    word = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    end = word.copy()
    if n:
        start[1:] &= ~word[:-1] | edge[1:n]
        end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums from which slice_hash() gets the hash of any slice."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for the same bytes, wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return slice_hash(prefix_hash(raw), starts, ends)


def windows(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words inside one row, and the word index at which each starts."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(_BASE) + hashes[k : n - width + 1 + k]
    last = np.repeat(firsts[1:], np.diff(firsts))[: n - width + 1]  # where the row of each word ends
    at = np.flatnonzero(np.arange(n - width + 1) + width <= last)
    return mix(h[at]), at
