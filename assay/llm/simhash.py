"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint is eight bytes, in four blocks of two. Two fingerprints that differ in at most two bits share at
least six of their eight positional bytes, and so both bytes of at least two blocks. The index has a posting list for
each two blocks and each value of their four bytes. The members of a list of up to ``FEW`` fingerprints are compared
position by position: a pair whose tally of shared positional bytes reaches six is kept, and its distance verified.
Members of a longer list are posted again under two of its other four positions, in lists that a pair shares exactly
when its tally reaches six. Those hold 65,536 distinct fingerprints at most, and each member looks up its neighbours.
In either case a linked member is tied to the least one of its part, so no list is expanded into pairs.

Equal fingerprints are one entry of the index, however many documents have them.
A null, empty or wordless text has fingerprint 0 and is linked like any other.
Repeated rows repeat their result; a null doc_id is carried and never a component's id
unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import map_texts, raw_texts, runs, saved, table

SHINGLE, SEED, MOST_BITS = 3, 42, 2
PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The least positional bytes that a linked pair shares: 8 less the most that can hold a differing bit.
SHARED = 8 - MOST_BITS
BLOCKS = ((0, 1), (2, 3), (4, 5), (6, 7))
#: Members of a list that are compared with each other.
FEW = 128


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of several texts, joined by one space: (bytes, word starts, word ends, words before each text)."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= inside[firsts]  # a word never runs on into the next text
    starts = np.flatnonzero(begins)
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:] | begins[1:]
    ends = np.flatnonzero(ends_mask) + 1
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(int(to[-1] + lengths[-1] + 1) if len(to) else 0, 32, dtype=np.uint8)
    shift = np.repeat(to - starts, lengths)
    at = np.flatnonzero(inside)
    out[at + shift] = data[at]
    return out.tobytes(), to, to + lengths, np.searchsorted(starts, offsets)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per text."""
    joined, starts, ends, before = words(data, offsets)
    n = np.diff(before)
    out = np.zeros(len(n), dtype=np.uint64)
    if not len(starts):
        return out
    first = np.ones(len(starts), dtype=bool)  # words at which a shingle begins
    for back in range(1, SHINGLE):
        late = before[1:][n >= SHINGLE] - back
        first[late] = False
    for short in range(2, SHINGLE):
        for back in range(1, short):
            first[before[1:][n == short] - back] = False
    begin = np.flatnonzero(first)
    doc = np.searchsorted(before, begin, side="right") - 1
    last = np.minimum(begin + SHINGLE, before[doc + 1]) - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    h = np.fromiter([digest(view[s:e], SEED) for s, e in zip(starts[begin].tolist(), ends[last].tolist(), strict=True)], dtype=np.uint64, count=len(begin))
    docs, at = np.unique(doc, return_index=True)
    count = np.diff(np.append(at, len(h)))
    for lo, hi in runs(count, 1 << 16):
        a, b = at[lo], at[hi - 1] + count[hi - 1]
        sums = np.zeros((hi - lo, 64), dtype=np.int64)
        for c in range(a, b, 1 << 18):  # a very long text is summed in parts
            d = min(b, c + (1 << 18))
            rows = np.unpackbits(h[c:d].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own = np.searchsorted(at[lo:hi], np.arange(c, d), side="right") - 1
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[cuts]] += np.add.reduceat(rows, cuts, axis=0, dtype=np.int64)
        bits = (2 * sums > count[lo:hi, None]).astype(np.uint8)
        out[docs[lo:hi]] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp the fingerprint as a signed long."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw_texts(b.column(1))
            parts = [fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in runs(np.diff(offsets), PIECE)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_texts(kept, scan, f"doc_id {dict(kept.dtypes)['doc_id']}, fp long")


class _Parts:
    """Union-find over the members of a list; the least member stands for its part."""

    def __init__(self, members: list[int]):
        self.members = sorted(members)
        self.root = list(range(len(members)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)

    def ties(self) -> list[tuple[int, int]]:
        return [(m, self.members[r]) for i, m in enumerate(self.members) if (r := self.find(i)) != i]


def tallied(members: list[int], most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links of a short list as (member, least member of its part): pairs that share SHARED positional bytes, verified."""
    parts = _Parts(members)
    x = np.array(parts.members, dtype=np.uint64)
    own = x.view(np.uint8).reshape(-1, 8)
    tally = (own[:, None, :] == own[None, :, :]).sum(axis=2)
    for i, j in zip(*np.nonzero(np.triu(tally >= SHARED, 1)), strict=True):
        if int(x[i] ^ x[j]).bit_count() <= most:
            parts.link(int(i), int(j))
    return parts.ties()


def ties(members: list[int]) -> list[tuple[int, int]]:
    """The same for a list whose members differ in two bytes only: each looks up all fingerprints within two bits."""
    parts = _Parts(members)
    at = {m: i for i, m in enumerate(parts.members)}
    differ = 0
    for m in parts.members:
        differ |= m ^ parts.members[0]
    bits = [1 << i for i in range(64) if differ >> i & 1]
    masks = [*bits, *(a | b for x, a in enumerate(bits) for b in bits[:x])]
    for m, i in at.items():
        for mask in masks:
            if m < m ^ mask and (j := at.get(m ^ mask)) is not None:
                parts.link(i, j)
    return parts.ties()


def _at(positions: tuple[int, ...]) -> F.Column:
    """The bytes of ``fp`` at these positions, as one number."""
    byte_at = lambda p: F.shiftright("fp", 8 * (7 - p)).bitwiseAND(F.lit(255))
    return sum((F.shiftleft(byte_at(p), 8 * i) for i, p in enumerate(positions)), F.lit(0).cast("long"))


def _lists(postings: DataFrame, work) -> DataFrame:
    """(a, b): what ``work`` finds in each list of ``postings`` (c, v, fp)."""
    lists = postings.groupBy("c", "v").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [t for m in b.column(0).to_pylist() for t in work([x & 0xFFFFFFFFFFFFFFFF for x in m])]
            a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return lists.select("members").mapInArrow(verify, "a long, b long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, enough of them to join what is joined."""
    chosen = [a + b for a, b in combinations(BLOCKS, 2)]
    keys = F.array(*[F.struct(F.lit(c).alias("c"), _at(p).alias("v")) for c, p in enumerate(chosen)])
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are light, but each makes six
    postings = prints.repartition(tasks, F.xxhash64("fp")).select("fp", F.inline(keys))
    sizes = saved(postings.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    found = _lists(postings.join(sizes.filter(F.col("n") <= FEW).select("c", "v"), ["c", "v"]), tallied)

    more = {c: [tuple(sorted(p + two)) for two in combinations(sorted(set(range(8)) - set(p)), SHARED - len(p))] for c, p in enumerate(chosen)}
    six = sorted({p for own in more.values() for p in own})
    again = F.array(*[F.when(F.col("c").isin([c for c, own in more.items() if p in own]), F.struct(F.lit(i).alias("c"), _at(p).alias("v"))) for i, p in enumerate(six)])
    longer = postings.join(sizes.filter(F.col("n") > FEW).select("c", "v"), ["c", "v"]).select("fp", F.explode(again).alias("k")).filter("k is not null")
    return found.unionByName(_lists(longer.select("fp", "k.c", "k.v").distinct(), ties)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (least doc_id reachable)."""
    prints = saved(with_fingerprint(docs), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(distinct.select("fp")))
    labelled = distinct.join(parts, distinct["fp"] == parts["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    labelled = saved(labelled, "parts")
    best = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    return prints.join(labelled.join(best, "part").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
