"""Word shingles as sorted arrays of 64-bit hashes, computed for a whole text at once."""

from __future__ import annotations

import numpy as np

# fixed value: A-Z become lower case, everything else stays
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class _Tables:
    """Powers of the base and of its inverse, grown as longer texts come."""
    up = _powers(1 << 12)
    down = up.copy()


def _grown(n: int) -> type[_Tables]:
    if n > len(_Tables.up) or _Tables.down[1] == _BASE:
        size = max(len(_Tables.up), 1 << int(n - 1).bit_length() if n > 1 else 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _Tables.up = _powers(size)
        down = np.full(size, inverse, np.uint64)
        down[0] = 1
        _Tables.down = np.multiply.accumulate(down, dtype=np.uint64)
    return _Tables


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word; words are runs of characters other than \\x20 and \\x09-\\x0D.

    A word is hashed as a polynomial in its bytes, read off prefix sums over the text.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    tables = _grown(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mixed(raw.astype(np.uint64) + np.uint64(1)) * tables.up[:len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * tables.down[start] + (end - start).astype(np.uint64) * _MIX[0])


def shingles(text: str | None, k: int = 4) -> np.ndarray:
    """The different k-word shingles, sorted by hash; fewer words make one shingle, none make none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    total = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        total = total * _BASE + w[i:len(w) - n + 1 + i]
    return np.unique(mixed(total))
