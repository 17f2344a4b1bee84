"""Vectorised fingerprints of fixed-length windows over documents.

A document is a sequence of symbols (bytes or words). ``L`` consecutive symbols
are a *window*. Every window is named by its *anchor*: the leftmost position
whose ``k``-symbol string has the smallest hash among the ``L - k + 1`` such
strings inside the window. Equal windows have equal anchors at equal offsets,
so only windows whose anchor string occurs twice can repeat. Consecutive
windows with one anchor form a *segment*, which is the unit that Spark moves.

All of it is numpy inside a task, on pieces of bounded length.
"""

from __future__ import annotations

import functools

import numpy as np

PIECE = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(n, b, dtype=np.uint64)
        a[0] = 1
        np.multiply.accumulate(a, out=a)
        out.append(a)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Prefix sums from which the hash of any substring of ``symbols`` follows."""

    def __init__(self, symbols: np.ndarray, base: int, most: int):
        up, self.down = _powers(base, 1 << max(18, int(most).bit_length()))
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def sliding(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


def byte_values(seed: int) -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) * _M)


def leftmost_minimum(order: np.ndarray, w: int) -> np.ndarray:
    """Offset of the leftmost minimum of each run of ``w`` values (w <= 255)."""
    val, off, span = order, np.zeros(len(order), dtype=np.uint8), 1
    while span < w:
        step = min(span, w - span)
        n = len(val) - step
        right = val[step:] < val[:n]
        off = np.where(right, off[step:] + np.uint8(step), off[:n])
        val = np.minimum(val[:n], val[step:])
        span += step
    return off


def segments(names: np.ndarray, starts: np.ndarray, ends: np.ndarray, L: int, k: int):
    """Anchors and inclusive window ranges of the pieces ``starts[i]:ends[i]``.

    ``names`` are the hashes of the k-symbol strings at every position. Returns
    arrays (piece, anchor, first window, last window).
    """
    w = L - k + 1
    if len(names) < w:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    off = leftmost_minimum((names >> np.uint64(32)).astype(np.uint32), w)
    n = len(off)
    valid = np.zeros(n + 1, dtype=np.int8)
    long = ends - starts >= L
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - L + 1, -1)
    ok = np.cumsum(valid[:n]) > 0
    anchor = np.arange(n) + off
    piece_start = np.zeros(n, dtype=bool)
    piece_start[starts[long]] = True
    change = np.ones(n, dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | piece_start[1:] | (ok[1:] != ok[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    return np.searchsorted(starts, first, side="right") - 1, anchor[first], first, last
