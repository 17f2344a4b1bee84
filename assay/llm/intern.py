"""Interning of byte strings in a task: words of texts, their XXH64, and an open-addressed table in NumPy arrays.

A table gives every occurrence of a string the slot of its first one. Keys are XXH64; a slot is taken only by
occurrences whose bytes equal those of its first, so two strings of one hash stay two strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of texts that are looked at together, and words of a part.
BYTES, WORDS = 1 << 22, 1 << 19
#: Longer strings are compared and hashed one by one.
LONG = 31
_PAD = 40
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
# the five primes of XXH64 (fixed values)
_P1, _P2, _P3, _P4, _P5 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)


def _rolled(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def _reader(data: np.ndarray, kind: str) -> np.ndarray:
    """Little-endian numbers at every byte of padded ``data``."""
    return np.ndarray(shape=(len(data) - _PAD + 1,), dtype=kind, buffer=data, strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for each pair, with one seed or one each; ``data`` is padded."""
    size = end - start
    seeds = np.broadcast_to(np.asarray(seed, dtype=_U), size.shape)
    out = seeds + _P5 + size.astype(_U)
    eight, four = _reader(data, "<u8"), _reader(data, "<u4")
    for lane in range(3):
        own = np.flatnonzero((size >= 8 * lane + 8) & (size <= LONG))
        if not len(own):
            break
        k = _rolled(eight[start[own] + 8 * lane] * _P2, 31) * _P1
        out[own] = _rolled(out[own] ^ k, 27) * _P1 + _P4
    own = np.flatnonzero((size & 4 != 0) & (size <= LONG))
    at = start[own] + (size[own] & ~7)
    out[own] = _rolled(out[own] ^ four[at].astype(_U) * _P1, 23) * _P2 + _P3
    for back in (3, 2, 1):
        own = np.flatnonzero(((size & 3) >= back) & (size <= LONG))
        out[own] = _rolled(out[own] ^ data[end[own] - back].astype(_U) * _P5, 11) * _P1
    out = (out ^ (out >> _U(33))) * _P2
    out = (out ^ (out >> _U(29))) * _P3
    out ^= out >> _U(32)
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], int(seeds[i]))
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and ``b`` agree."""
    out = np.ones(len(a), dtype=bool)
    eight = _reader(data, "<u8")
    for lane in range(0, LONG, 8):
        own = np.flatnonzero((size > lane) & (size <= LONG) & out)
        if not len(own):
            break
        unread = _U(8) * np.maximum(0, lane + 8 - size[own]).astype(_U)
        out[own] = (eight[a[own] + lane] ^ eight[b[own] + lane]) << unread == 0
    for i in np.flatnonzero(size > LONG):
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return out


class Table:
    """An open-addressed table over slices of one padded buffer; linear probing, at most half full."""

    def __init__(self, data: np.ndarray, most: int):
        self.data = data
        self.mask = (1 << max(8, int(2 * most - 1).bit_length())) - 1
        self.key = np.zeros(self.mask + 1, dtype=_U)
        self.start = np.full(self.mask + 1, -1, dtype=np.int64)
        self.size = np.zeros(self.mask + 1, dtype=np.int64)

    def put(self, start: np.ndarray, end: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """The slot of each string; strings of one slot are equal. ``keys`` are XXH64 unless given."""
        keys = xxh64(self.data, start, end) if keys is None else keys
        size = end - start
        slots = np.empty(len(start), dtype=np.int64)
        todo = np.arange(len(start))
        at = (keys & _U(self.mask)).astype(np.int64)
        while len(todo):
            free = self.start[at] < 0
            new, where = todo[free][::-1], at[free][::-1]  # of several that want a free slot the first gets it
            self.start[where], self.key[where], self.size[where] = start[new], keys[new], size[new]
            alike = (self.key[at] == keys[todo]) & (self.size[at] == size[todo])
            check = np.flatnonzero(alike & (self.start[at] != start[todo]))
            alike[check] = _same(self.data, self.start[at[check]], start[todo[check]], size[todo[check]])
            slots[todo[alike]] = at[alike]
            todo, at = todo[~alike], (at[~alike] + 1) & self.mask
        return slots

    def used(self) -> np.ndarray:
        return np.flatnonzero(self.start >= 0)

    def crc32(self, slots: np.ndarray) -> np.ndarray:
        """Unsigned CRC32 of the strings in ``slots``."""
        view, crc = memoryview(self.data), zlib.crc32
        low = self.start[slots]
        return np.fromiter([crc(view[a:b]) for a, b in zip(low.tolist(), (low + self.size[slots]).tolist(), strict=True)], dtype=np.int64, count=len(slots))


class Words:
    """Lower-cased words of texts, joined by one space in ``data``: of each its ``start``, ``end``, ``text`` and ``piece``.

    The first ``own`` words begin here; up to ``reach`` more follow, which runs that begin here may need.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, piece: np.ndarray, own: int):
        size = end - start
        self.start = np.cumsum(size + 1) - (size + 1)
        self.end, self.text, self.piece, self.own = self.start + size, text, piece, own
        self.data = np.full(int(self.end[-1] + 1 if len(size) else 0) + _PAD, 32, dtype=np.uint8)
        to = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        self.data[to] = _LOWER[data[to + np.repeat(start - self.start, size)]]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, is_break: np.ndarray | None = None, reach: int = 0, size: int | None = None) -> Iterator[Words]:
    """The words of texts (bytes and n + 1 offsets) in parts of about ``size`` bytes.

    ``is_word`` and ``is_break`` say for each byte value whether it belongs to a word and whether a run of words ends at it.
    """
    n, size = len(offsets) - 1, size or BYTES
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        for low, high, lead in _cuts(data, int(offsets[i]), int(offsets[j]), is_word, size):
            yield from _part(data, offsets, low, high, lead, int(offsets[j]), is_word, is_break, reach)
        i = j


def _cuts(data: np.ndarray, low: int, high: int, is_word: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of at most about twice ``size`` that end between words."""
    while low < high:
        end = min(high, low + 2 * size)
        while end < high and is_word[data[end]] and is_word[data[end - 1]]:
            step = np.flatnonzero(~is_word[data[end : end + size]])
            end = min(high, end + (int(step[0]) if len(step) else size))
        yield low, end, low
        low = end


def _part(data, offsets, low, high, lead, last, is_word, is_break, reach) -> Iterator[Words]:
    """The words of ``data[low:high]``, with those that follow within ``last`` for runs that begin here."""
    ahead = high
    if reach:
        found = 0
        while ahead < last and found <= reach:  # a word more than needed: the last may be cut
            more = is_word[data[ahead : ahead + 4096]]
            found += int(np.count_nonzero(more[:-1] & ~more[1:]))
            ahead = min(last, ahead + 4096)
        while ahead < last and is_word[data[ahead]] and is_word[data[ahead - 1]]:
            ahead += 1
    part = data[lead:ahead]
    inside = is_word[part]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.zeros(len(part) + 1, dtype=bool)
    ends[1:-1] = inside[:-1] & ~inside[1:]
    ends[-1] = bool(len(part)) and inside[-1]
    edges = offsets[(offsets > lead) & (offsets < ahead)] - lead  # a word never runs on into the next text
    begins[edges] |= inside[edges]
    ends[edges] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(start):
        return
    text = np.searchsorted(offsets, start + lead, side="right") - 1
    piece = text.astype(np.int64)
    if is_break is not None:
        breaks = np.cumsum(is_break[part])
        piece = breaks[start] + text  # both grow: equal only where both are
    own = int(np.searchsorted(start, high - lead))
    for a in range(0, own, WORDS):
        b = min(own, a + WORDS)
        c = min(len(start), b + reach)
        yield Words(part, start[a:c], end[a:c], text[a:c], piece[a:c], b - a)

