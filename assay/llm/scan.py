"""Reading documents for repeated windows, shared by the byte and the word operator: symbols, anchors of windows,
texts with what is asked of them, and documents without what repeats.

Text is read again only for documents that a small fixed-size bitmap lets through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, raw_texts, saved
from .windows import BASES, PIECE, Fingerprints, byte_values, mix, segments

BITS = 26
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
C1, C2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_VALUES = byte_values(0)

#: From (bytes, offsets) of several texts to (symbol values, offsets).
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _VALUES[data], offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each text."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, before = word_bounds(data, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # parts of bounded bytes, cut between words
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 4 * PIECE, side="right")))
        low = starts[i]
        part = Fingerprints(_VALUES[data[low : ends[j - 1]]], BASES[0], int(ends[j - 1] - low))
        out[i:j] = part.of(starts[i:j] - low, ends[i:j] - low)
        i = j
    return out, before


class Unit:
    """What a window is made of: L symbols, anchors of k."""

    def __init__(self, symbols: Symbols, length: int, anchor: int):
        if not 0 < anchor <= length or length - anchor + 1 > 255:
            raise ValueError("an anchor is shorter than a window, by at most 254")
        self.symbols, self.L, self.k = symbols, length, anchor

    def scan(self, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, anchor, least offset, largest offset, name, class name) of all segments, piece by piece."""
        L, parts, total = self.L, [], 0

        def done():
            x = np.concatenate([values[a:b] for _, a, b in parts])
            ends = np.cumsum([b - a for _, a, b in parts])
            starts = ends - np.array([b - a for _, a, b in parts])
            own = Fingerprints(x, BASES[0], len(x))
            piece, anchor, first, last = segments(own.sliding(self.k), starts, ends, L, self.k)
            other = Fingerprints(x, BASES[1], len(x))
            near, far = anchor - last, anchor - first
            name = own.of(anchor, anchor + self.k)
            kind = mix(other.of(first, last + L) + near.astype(np.uint64) * C1 + far.astype(np.uint64) * C2)
            text = np.array([t for t, _, _ in parts])[piece]
            base = np.array([a - offsets[t] for t, a, _ in parts])[piece]
            return text, anchor - starts[piece] + base, near, far, name.view(np.int64), kind.view(np.int64)

        for t in range(len(offsets) - 1):
            n = int(offsets[t + 1] - offsets[t]) - L + 1
            for w in range(0, n, PIECE):
                a = int(offsets[t]) + w
                b = int(offsets[t]) + min(w + PIECE, n) + L - 1
                parts.append((t, a, b))
                total += b - a
                if total >= PIECE:
                    yield done()
                    parts, total = [], 0
        if parts:
            yield done()


def _slices(batch: pa.RecordBatch, at: int, unit: Unit) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded size: (first row, last row + 1, symbol values, offsets)."""
    data, offsets = raw_texts(batch.column(at))
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 4 * PIECE, side="right")) - 1)
        yield (i, j, *unit.symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j


SEGMENT = "key long, kind long, rid long, pos long, near int, far int"


def anchors(docs: DataFrame, unit: Unit, among: "Bitmap | None" = None) -> DataFrame:
    """One row per segment of ``docs`` (rid, text); with ``among``, of those whose key it may hold."""
    bits = among and among.shared

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            for i, _, values, offsets in _slices(b, 1, unit):
                for text, pos, near, far, key, kind in unit.scan(values, offsets):
                    columns = [key, kind, rid[i + text], pos, near.astype(np.int32), far.astype(np.int32)]
                    if bits:
                        keep = held(bits.value, key)
                        columns = [c[keep] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "kind", "rid", "pos", "near", "far"])

    return map_texts(docs.select("rid", "text"), scan, SEGMENT)


def held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    h = mix(values.view(np.uint64)) >> np.uint64(64 - BITS)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


class Bitmap:
    """A one-hash filter of 2**26 bits over a long column: 8 MB whatever the input. It only spares
    work: false positives are removed by the join that follows, and a full one lets all through."""

    def __init__(self, rows: DataFrame, column: str):
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << BITS - 6, dtype=np.uint64)
            for b in batches:
                h = mix(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - BITS)
                np.bitwise_or.at(bits, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["at", "bits"])

        parts = rows.select(column).mapInArrow(fold, "at long, bits long")
        found = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.bits = np.zeros(1 << BITS - 6, dtype=np.uint64)
        self.bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        self.shared = rows.sparkSession.sparkContext.broadcast(self.bits)


def repeated(docs: DataFrame, unit: Unit) -> DataFrame:
    """Segments whose anchor string occurs more than once; ``alone`` says its segments are all alike."""
    first = anchors(docs, unit).groupBy("key").agg(F.count("*").alias("n"), (F.min("kind") == F.max("kind")).alias("alike"))
    keys = saved(first.filter("n > 1").select("key", "alike"), "keys")
    return saved(anchors(docs, unit, Bitmap(keys, "key")).join(keys, "key"), "repeated")


def with_texts(docs: DataFrame, requests: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Documents named by ``requests`` with the list of theirs, which is no longer than the text."""
    bits = Bitmap(requests, "rid").shared
    asked = requests.groupBy("rid").agg(F.collect_list(F.struct(*fields)).alias("asked"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held(bits.value, b.column(0).to_numpy())))

    return map_texts(docs.select("rid", "text"), pick, "rid long, text string").join(asked, "rid")


def hashes(rows: DataFrame, unit: Unit, work: Callable, fields: tuple[str, ...], schema: str) -> DataFrame:
    """``work(fingerprints, requests)`` for each document of ``with_texts``, in pieces."""
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, rid = b.column(2), b.column(0).to_numpy()
            columns = {f: lists.values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(fields)}
            at = lists.offsets.to_numpy()
            for i, j, values, offsets in _slices(b, 1, unit):
                for t in range(i, j):
                    x = values[offsets[t - i] : offsets[t - i + 1]]
                    own = {f: c[at[t] : at[t + 1]] for f, c in columns.items()}
                    low = own["pos"] - own["far"]
                    for w in range(0, len(x), PIECE):
                        mine = (low >= w) & (low < w + PIECE)
                        if mine.any():
                            part = x[w : w + PIECE + 2 * unit.L]
                            got = work(Fingerprints(part, BASES[1], len(part)), {f: c[mine] for f, c in own.items()}, w)
                            got["rid"] = np.full(len(got["pos"]), rid[t])
                            yield pa.RecordBatch.from_arrays([pa.array(got[n]) for n in names], names)

    return map_texts(rows, scan, schema)


def windows(unit: Unit) -> Callable:
    def work(prints: Fingerprints, own: dict, w: int) -> dict:
        times = own["far"] - own["near"] + 1
        row = np.repeat(np.arange(len(times)), times)
        d = own["near"][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        start = own["pos"][row] - w - d
        return {"key": own["key"][row], "d": d.astype(np.int32), "text": prints.of(start, start + unit.L).view(np.int64), "pos": own["pos"][row], "single": own["single"][row]}

    return work


def covered(n: int, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Which of n symbols the windows starting at ``low``..``high`` cover."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, low, 1)
    np.add.at(steps, high + length, -1)
    return np.cumsum(steps[:n]) > 0


def rewritten(docs: DataFrame, spans: DataFrame, whole: Callable[[bytes], tuple], cut: Callable[[bytes, np.ndarray, np.ndarray], tuple], columns: str) -> DataFrame:
    """One row per document: ``whole(text)`` where nothing repeats, else ``cut(text, low, high)``."""
    spans = saved(spans, "spans")
    bits = Bitmap(spans, "rid").shared
    names = [c.split()[0] for c in columns.split(", ")]
    kept = docs.select("doc_id", "rid", F.coalesce("text", F.lit("")).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = held(bits.value, b.column(1).to_numpy())
            rows = [(None,) * len(names) if m else whole(t.as_buffer().to_pybytes()) for m, t in zip(maybe, b.column(2), strict=True)]
            texts = pa.array([t.as_py() if m else None for m, t in zip(maybe, b.column(2), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts, *map(pa.array, zip(*rows, strict=True))], ["doc_id", "rid", "text", *names]) if rows else b.slice(0, 0)

    key = dict(docs.dtypes)["doc_id"]
    seen = map_texts(kept, look, f"doc_id {key}, rid long, text string, {columns}")
    grouped = spans.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans_, *done in zip(b.column(1), b.column(2), *(b.column(i).to_pylist() for i in range(3, b.num_columns)), strict=True):
                if not text.is_valid:
                    rows.append(tuple(done))
                elif not spans_.is_valid:
                    rows.append(whole(text.as_buffer().to_pybytes()))
                else:
                    v = spans_.values
                    rows.append(cut(text.as_buffer().to_pybytes(), v.field(0).to_numpy(), v.field(1).to_numpy()))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*rows, strict=True))], ["doc_id", *names])

    return map_texts(seen.join(grouped, "rid", "left").select("doc_id", "text", "spans", *names), finish, f"doc_id {key}, {columns}")
