"""Texts alike, found without comparing all pairs.

Two texts are alike when their sets of character bigrams have a Jaccard index of ``least``. Sets of at most n bigrams that are so differ
in at most ``d = 2 n (1 - least) / (1 + least)`` of them. Bigrams are dealt to d + 2 parts by a hash, so two parts at least are equal in
both: texts meet on two parts that they share, and are compared only then. n is the upper end of a class of sizes; a text is dealt
by its own class and by the next one, where larger texts may be that are alike. No pair is missed; what meets by chance is mostly told by
sketches of 256 bits, and the rest by the bigrams themselves.

``matching_blocks`` is the share of two texts that common stretches cover, the longest first. It can be high where bigrams agree less;
``alike`` looks for it among pairs whose bigrams reach ``sets_from``. That may be set lower for small tables: sentences of one
language share half of their bigrams, so far below .85 all texts meet, and edits all over a text would take a comparison of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import jaccard, ngrams
from ..scratch import saved

LEAST = SETS_FROM = 0.85
#: Code points of texts that are looked at together.
TOGETHER = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bigram) of the distinct character bigrams of each text; a text of one character is one."""
    joined = np.frombuffer("".join(t + "\0" * (len(t) == 1) for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + (len(t) == 1) for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    pair = (joined[:-1] << np.uint64(21)) | joined[1:]
    inside = text[:-1] == text[1:]
    key = np.sort((text[:-1][inside].astype(np.uint64) << np.uint64(42)) | pair[inside])
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> np.uint64(42)).astype(np.int64), key & np.uint64((1 << 42) - 1)


def parts(least: float, size_class: np.ndarray) -> np.ndarray:
    """Into how many parts the bigrams of texts of these classes are dealt: two more than may differ, or one where none may."""
    differ = np.floor(2 * np.ceil(least ** -(size_class + 1.0)) * (1 - least) / (1 + least) + 1e-9).astype(np.int64)
    return np.where(differ == 0, 1, differ + 2)


def _sketches(texts: int, text: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Of each text the bits that its bigrams name. Two texts differ in no more bits than in bigrams."""
    bit = _mixed(gram) >> np.uint64(56)
    out = np.zeros((texts, 4), dtype=np.uint64)
    np.bitwise_or.at(out.ravel(), 4 * text + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _meetings(sizes: np.ndarray, text: np.ndarray, gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, meeting, whether the class is the text's own) of every two parts of each text."""
    own_class = np.floor(np.log(np.maximum(sizes, 1)) / -math.log(least) + 1e-9).astype(np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))]
    for up in (0, 1):
        classes = own_class + up
        count = parts(least, classes)
        first = np.cumsum(count) - count
        salted = _mixed(gram + (classes[text].astype(np.uint64) << np.uint64(48)))
        at = first[text] + ((salted >> np.uint64(20)) % count[text].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(count.sum()), dtype=np.uint64)
        np.add.at(total, at, _mixed(salted))
        of = np.repeat(np.arange(len(sizes)), count)
        place = (np.arange(len(of)) - first[of]).astype(np.uint64) | (classes[of].astype(np.uint64) << np.uint64(32))
        part = _mixed(total + _mixed(place))
        for m in np.unique(count[sizes > 0]):
            own = np.flatnonzero((count == m) & (sizes > 0))
            table = part[first[own][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1) if m > 1 else (np.zeros(1, np.int64), np.zeros(1, np.int64))
            both = _mixed(table[:, i] * np.uint64(0x9E3779B97F4A7C15) + table[:, j])
            out.append((np.repeat(own, len(i)), both.ravel(), np.full(both.size, up == 0)))
    a, b, c = zip(*out, strict=True)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


FIELDS = ("meeting", "own", "size", "s0", "s1", "s2", "s3")


class Places:
    """A bitmap over meetings, 2**16 to 2**27 bits by their number: what it lets through by chance the join drops."""

    def __init__(self, rows: DataFrame):
        self.bits = min(27, max(16, (64 * rows.count()).bit_length()))
        h = F.col("meeting")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 64 - self.bits).bitwiseAND(F.lit(63)).cast("int"))
        found = rows.groupBy(F.shiftrightunsigned(h, 70 - self.bits).alias("at")).agg(F.bit_or(one).alias("set")).toArrow()  # at most 2**21 rows
        words = np.zeros(1 << self.bits - 6, dtype=np.uint64)
        words[found["at"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
        self.shared = rows.sparkSession.sparkContext.broadcast(words)


def _held(words: np.ndarray, bits: int, meeting: np.ndarray) -> np.ndarray:
    at = meeting >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def meetings(rows: DataFrame, key: str, text: str, least: float = LEAST, among: Places | None = None) -> DataFrame:
    """(key, meeting, own, size, s0 to s3): where each text of ``rows`` may meet texts alike, and its sketch; with ``among``, at its places only."""
    kept = rows.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")))
    shared, bits = among and among.shared, among and among.bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOGETHER, side="right")))
                text, gram = bigrams(texts[i:j])
                sizes = np.bincount(text, minlength=j - i)
                of, meeting, own = _meetings(sizes, text, gram, least)
                if shared:
                    keep = _held(shared.value, bits, meeting)
                    of, meeting, own = of[keep], meeting[keep], own[keep]
                some = np.zeros(j - i, dtype=bool)
                some[of] = True
                sketch = _sketches(j - i, text[some[text]], gram[some[text]])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of + i)), pa.array(meeting.view(np.int64)), pa.array(own), pa.array(sizes[of]), *(pa.array(sketch[of, w].view(np.int64)) for w in range(4))], [key, *FIELDS])
                i = j

    return kept.mapInArrow(deal, f"{key} {dict(kept.dtypes)[key]}, meeting long, own boolean, size long, s0 long, s1 long, s2 long, s3 long")


def met(left: DataFrame, right: DataFrame | None, key: str, text: str, least: float = LEAST) -> DataFrame:
    """(a, b): pairs of keys, each once, among which are all whose bigrams reach ``least``. Without ``right``, of one table, a < b.

    ``left`` is the smaller table: its meetings are written, and of ``right`` only those are looked up that it may have.
    """
    x = saved(meetings(left, key, text, least), "meetings")
    y = x if right is None else meetings(right, key, text, least, Places(x))
    side = lambda rows, name: rows.select(F.col(key).alias(name), "meeting", *[F.col(c).alias(f"{c}_{name}") for c in FIELDS[1:]])
    pairs = side(x, "a").join(side(y, "b"), "meeting").filter("(own_a or own_b)" + (" and a < b" if right is None else ""))
    # of sets that are alike this many differ at most, and no more bits of their sketches
    most = (F.col("size_a") + F.col("size_b")) * ((1 - least) / (1 + least)) + 1e-9
    differ = sum((F.bit_count(F.col(f"s{w}_a").bitwiseXOR(F.col(f"s{w}_b"))) for w in range(4)), F.lit(0))
    return pairs.filter((F.abs(F.col("size_a") - F.col("size_b")) <= most) & (differ <= most)).select("a", "b").distinct()


def with_texts(pairs: DataFrame, left: DataFrame, right: DataFrame | None, key: str, text: str) -> DataFrame:
    """(a, b, text_a, text_b)."""
    right = left if right is None else right
    own = lambda rows, side: rows.select(F.col(key).alias(side), F.col(text).cast("string").alias(f"text_{side}"))
    return pairs.join(own(left, "a"), "a").join(own(right, "b"), "b")


def sets_alike(left: DataFrame, key: str, text: str, right: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(a, b, similarity): all pairs of texts whose bigrams have a Jaccard index of ``least`` or more. Keys are unique; null texts are alike to none.

    Repeated texts make pairs each: pass distinct ones where there are many (``classes``).
    """
    both = with_texts(saved(met(left, right, key, text, least), "met"), left, right, key, text)
    scored = both.select("a", "b", jaccard(ngrams(F.col("text_a"), 2), ngrams(F.col("text_b"), 2)).alias("similarity"))
    return scored.filter(F.col("similarity") >= least)


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks, of the characters of both texts; 1 for two empty ones."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """The share of matching blocks where it is over .9, else the larger of that and of the bigrams' Jaccard index."""
    blocks = matching_blocks(a, b)
    return F.when(blocks > 0.9, blocks).otherwise(F.greatest(blocks, jaccard(ngrams(a, 2), ngrams(b, 2))))


def alike(left: DataFrame, key: str, text: str, right: DataFrame | None = None, least: float = LEAST, sets_from: float = SETS_FROM) -> DataFrame:
    """(a, b, similarity): pairs whose bigrams reach ``sets_from`` and whose similarity by blocks or bigrams reaches ``least``."""
    both = with_texts(saved(met(left, right, key, text, sets_from), "met"), left, right, key, text)
    near = both.filter(jaccard(ngrams(F.col("text_a"), 2), ngrams(F.col("text_b"), 2)) >= min(least, sets_from))
    scored = near.select("a", "b", similarity(F.col("text_a"), F.col("text_b")).alias("similarity"))
    return scored.filter(F.col("similarity") >= least)


def classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n): each distinct text once, under its smallest key."""
    return rows.groupBy(F.col(text)).agg(F.min(key).alias(key), F.count("*").alias("n")).filter(F.col(text).isNotNull()).select(key, text, "n")
