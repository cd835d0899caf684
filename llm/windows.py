"""Content-defined sampling of equal-length windows: which windows of a sequence recur elsewhere.

A window is `k + w - 1` consecutive units (bytes or words). Its anchor is the unit string of length
`k` with the smallest hash inside it, the leftmost one of equals, so equal windows have equal
anchors at equal offsets. Consecutive windows with the same anchor form a phrase; the text that
they cover together is the phrase's text. Comparing one anchor hash and one phrase hash per phrase
settles nearly all windows; the rest are compared one by one (`window_hashes`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, int(n + 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Block:
    """One stretch of units whose windows start in it."""

    def __init__(self, units: np.ndarray, k: int, w: int, start: int = 0):
        self.k, self.w, self.m, self.start = k, w, k + w - 1, start
        n = len(units)
        self.n = n - self.m + 1  # windows
        pw, self.inv = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units.astype(np.uint64) * pw[:n], dtype=np.uint64, out=self.sums[1:])

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the unit strings [lo, hi)."""
        return mix((self.sums[hi] - self.sums[lo]) * self.inv[lo] + (hi - lo).astype(np.uint64))

    def phrases(self) -> dict[str, np.ndarray]:
        """Per phrase: lo and hi (first and last window), anchor hash, phrase hash."""
        count = len(self.sums) - self.k
        at = np.arange(count)
        grams = self.span_hash(at, at + self.k)
        bits = np.uint64(max(1, int(count).bit_length()))
        key = ((grams >> bits) << bits) | at.astype(np.uint64)
        low = _sliding_min(key, self.w)
        anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        a = anchor[first]
        phrase = self.span_hash(first, last + self.m) ^ mix((a - first).astype(np.uint64))
        return {"lo": first + self.start, "hi": last + self.start, "anchor": grams[a].view(np.int64), "phrase": phrase.view(np.int64)}

    def window_hashes(self, lo: int, hi: int) -> np.ndarray:
        """Hashes of windows lo..hi (positions in the whole sequence)."""
        at = np.arange(lo - self.start, hi - self.start + 1)
        return self.span_hash(at, at + self.m).view(np.int64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by running minima from both ends of stretches of w."""
    n = len(x)
    if w == 1:
        return x
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def blocks(units: np.ndarray, k: int, w: int, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of at most `size` windows; together they hold each window of the sequence once."""
    m = k + w - 1
    for start in range(0, len(units) - m + 1, size):
        yield Block(units[start : start + size + m - 1], k, w, start)


def covered(flags: np.ndarray, m: int) -> np.ndarray:
    """Which units lie in a flagged window; flags has one entry per window."""
    n = len(flags) + m - 1
    step = np.zeros(n + 1, np.int32)
    step[: len(flags)] += flags
    step[m : m + len(flags)] -= flags
    return np.cumsum(step[:n]) > 0
