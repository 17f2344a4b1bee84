"""Substring dedup by distributed prefix doubling.

Ranking every byte position would move some hundred bytes for each byte of text, so the set of positions is thinned first,
and exactly. Every string of ``LENGTH`` bytes holds an *anchor*, its ``ANCHOR``-byte string of least hash; equal strings have
equal anchors at equal offsets. What has a unique anchor is unique. Strings that follow each other with one anchor
are a segment; segments alike repeat as a whole, and one of them stands for all.

Around the anchors that are left lie positions a step of ``step(LENGTH)`` bytes apart. Prefix doubling ranks them:

1. Positions are ranked by their next ``step`` bytes.
2. Each position is paired with the one as far on as its rank reaches; Spark sorts the pairs of ranks, and the
   place of a pair is the rank by twice as many bytes. A pair that is unique is done and drops out.
3. So on with growing offsets, the last one such that ranks reach ``LENGTH - step`` bytes: what all windows have in common
   that begin within a step.

A rank that is still shared is of a cell of windows that may repeat. Cells that are alike in all their windows repeat as a whole;
the windows of the others, at the borders of what repeats, are ranked one by one by the whole threshold.

Ranks are the places of sorted pairs, so their equality is exact; the first names and the last windows are compared by 64-bit
fingerprints, under two independent ones together with the anchor's. Groups are counted, never listed: a passage
that a third of all documents share costs its own length.

A null or empty text has 0 bytes; texts shorter than ``LENGTH`` lose nothing; repeated rows are
copies of each other; a null doc_id is carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table, with_row_id
from .scan import C1, C2, Unit, byte_symbols, covered, hashes, repeated, rewritten, windows, with_texts
from .windows import Fingerprints, mix

LENGTH, ANCHOR = 200, 48
COLUMNS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def step(length: int) -> int:
    """Distance of the ranked positions: the largest divisor of ``length`` up to an eighth of it."""
    return next(s for s in range(max(1, length // 8), 0, -1) if length % s == 0)


def _positions(length: int) -> Callable:
    """The ranked positions of segments: place ``t`` is ``t`` steps after the anchor. Where cell ``-t`` begins, also the hash of all its windows."""
    size = step(length)

    def work(prints: Fingerprints, own: dict, w: int) -> dict:
        first, last = own["near"] // size, own["far"] // size
        reach = length // size - 1
        times = last - first + reach
        row = np.repeat(np.arange(len(times)), times)
        t = -last[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        pos = own["pos"][row] - w
        start = pos + size * t
        # a cell's windows begin from ``hi`` to ``lo`` bytes before the anchor
        is_cell = -t >= first[row]
        lo = np.where(is_cell, np.maximum(own["near"][row], -t * size), 0)
        hi = np.where(is_cell, np.minimum(own["far"][row], -t * size + size - 1), 0)
        a, b = np.where(is_cell, pos - hi, start), np.where(is_cell, pos - lo + length, start)
        whole = mix(prints.of(a, b) + lo.astype(np.uint64) * C1 + hi.astype(np.uint64) * C2)
        return {
            "oid": own["oid"][row], "t": t.astype(np.int32), "name": prints.of(start, start + size).view(np.int64), "cell": is_cell, "whole": whole.view(np.int64),
            "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "pos": own["pos"][row],
        }

    return work


def ranked(pairs: DataFrame, *pair: str) -> DataFrame:
    """(oid, t, rank) of ``pairs`` (oid, t, *pair): the place of a pair among all in sorted order; unique ones drop out."""
    again = saved(pairs.groupBy(*pair).agg(F.count("*").alias("n")).filter("n > 1").select(*pair), "pairs")
    places = saved(again.sort(*pair).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return saved(pairs.join(places, [*pair]).select("oid", "t", "rank"), "ranked")


def paired(ranks: DataFrame, offset: int) -> DataFrame:
    """(oid, t, a, b): the rank at each position and the one ``offset`` steps on, both of one segment, where both are left."""
    on = Window.partitionBy("oid").orderBy("t").rangeBetween(offset, offset)
    both = ranks.select("oid", "t", F.col("rank").alias("a"), F.first("rank").over(on).alias("b"))
    return both.filter("b is not null")


def doubled(names: DataFrame, reach: int) -> DataFrame:
    """(oid, t, rank) by the next ``reach`` steps, of positions ``names`` (oid, t, name) where that is not unique."""
    ranks, done = ranked(names.select("oid", "t", "name"), "name"), 1
    while done < reach:
        offset = min(done, reach - done)
        ranks, done = ranked(paired(ranks, offset), "a", "b"), done + offset
    return ranks


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(rid, low, high) of repeated strings in ``docs`` (rid, text): first and last starts of runs."""
    unit = Unit(byte_symbols, length, anchor)
    span = lambda rows, near="near", far="far": rows.select("rid", (F.col("pos") - F.col(far)).alias("low"), (F.col("pos") - F.col(near)).alias("high"))
    found = repeated(docs, unit)
    mixed = found.filter("not alike")
    classes = saved(mixed.groupBy("key", "kind", "near", "far").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("at")), "classes")
    many = classes.filter("n > 1").select("key", "kind")
    settled = [span(found.filter("alike")), span(mixed.join(many, ["key", "kind"], "left_semi"))]

    # one segment for each class, where an anchor has a class of one and another class
    left = classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("classes > 1 and least = 1").select("key")
    segments = classes.join(left, "key").select("key", "at.rid", "at.pos", "near", "far", (F.col("n") == 1).alias("single"))
    segments = saved(segments.withColumn("oid", F.monotonically_increasing_id()), "segments")
    fields = ("oid", "pos", "near", "far")
    schema = "oid long, t int, name long, cell boolean, whole long, lo int, hi int, rid long, pos long"
    positions = saved(hashes(with_texts(docs, segments.select("rid", *fields), fields), unit, _positions(length), fields, schema), "positions")
    ranks = doubled(positions, length // step(length) - 1)

    cells = ranks.join(positions.filter("cell").drop("name", "cell"), ["oid", "t"]).join(segments.select("oid", "key", "single"), "oid")
    cells = saved(cells, "cells")
    shared = cells.groupBy("key", "t", "rank").agg(F.count("*").alias("n"), F.max("single").alias("open")).filter("n > 1 and open").select("key", "t", "rank")
    cells = cells.join(shared, ["key", "t", "rank"])
    same = cells.groupBy("key", "lo", "hi", "whole").agg(F.count("*").alias("alike"), F.min("oid").alias("one"))
    cells = saved(cells.join(same, ["key", "lo", "hi", "whole"]), "shared")
    settled.append(span(cells.filter("single and alike > 1"), "lo", "hi"))

    # border cells, and one of each kind of the others to compare them with
    borders = cells.filter("alike = 1 or oid = one").select("rid", "key", "pos", F.col("lo").alias("near"), F.col("hi").alias("far"), F.expr("single and alike = 1").alias("single"))
    fields = ("key", "pos", "near", "far", "single")
    own = saved(hashes(with_texts(docs, saved(borders, "borders"), fields), unit, windows(unit), fields, "key long, d int, text long, rid long, pos long, single boolean"), "windows")
    twice = own.groupBy("key", "d", "text").agg(F.count("*").alias("n"), F.max("single").alias("open")).filter("n > 1 and open").select("key", "d", "text")
    settled.append(span(own.filter("single").join(twice, ["key", "d", "text"], "left_semi"), "d", "d"))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    docs = with_row_id(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", "text")

    def whole(text: bytes) -> tuple:
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()

    def cut(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple:
        gone = covered(len(text), low, high, length)
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        return len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()

    return rewritten(docs, repeated_spans(docs, length, anchor), whole, cut, COLUMNS)


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
