"""Exact repeated windows of documents.

Plan, for windows of L symbols (see ``windows`` for anchors and segments):

1. ``anchors``: one row per segment; ``repeated`` anchor strings keep theirs, the rest is done.
2. Segments of equal text form a class. A class of two or more repeats as a whole.
3. A class of one still may share windows with another class of its anchor. Its segment is cut into
   blocks of 16 windows. Windows of a block share a core string; where no other
   class has the core, none repeats; where another has the whole block, all do.
4. Only blocks on the border of a repeat are left and are compared window by window.

Names are 64-bit hashes; windows are compared under two independent ones (the anchor's and
their own). No step gathers a group: groups are counted, never listed, and only one
row stands for each class, so a passage that a third of all documents share costs
its own length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .scan import C1, C2, Unit, hashes, windows, with_texts
from .windows import Fingerprints, mix

BLOCK = 16


def _blocks(unit: Unit) -> Callable:
    def work(prints: Fingerprints, own: dict, w: int) -> dict:
        first, last = own["near"] // BLOCK, own["far"] // BLOCK
        times = last - first + 1
        row = np.repeat(np.arange(len(times)), times)
        block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        pos = own["pos"][row] - w
        lo = np.maximum(own["near"][row], block * BLOCK)
        hi = np.minimum(own["far"][row], block * BLOCK + BLOCK - 1)
        core = prints.of(pos - block * BLOCK, pos - block * BLOCK - BLOCK + 1 + unit.L) if unit.L >= BLOCK else np.zeros(len(row), np.uint64)
        whole = mix(prints.of(pos - hi, pos - lo + unit.L) + lo.astype(np.uint64) * C1 + hi.astype(np.uint64) * C2)
        return {"key": own["key"][row], "block": block.astype(np.int32), "core": core.view(np.int64), "whole": whole.view(np.int64), "pos": own["pos"][row], "near": lo.astype(np.int32), "far": hi.astype(np.int32), "single": own["single"][row]}

    return work


def repeats(docs: DataFrame, found: DataFrame, unit: Unit) -> DataFrame:
    """(rid, low, high): first and last start of runs of repeated windows, given ``repeated`` segments."""
    alike = found.filter("alike")
    mixed = found.filter("not alike")
    classes = saved(mixed.groupBy("key", "kind", "near", "far").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("at")), "classes")
    many = classes.filter("n > 1").select("key", "kind")
    settled = [alike.select("rid", "pos", "near", "far"), mixed.join(many, ["key", "kind"], "left_semi").select("rid", "pos", "near", "far")]

    # anchors with a class of one and another class
    open_keys = classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("classes > 1 and least = 1").select("key")
    first = classes.join(open_keys, "key").select("key", F.col("at.rid").alias("rid"), F.col("at.pos").alias("pos"), "near", "far", (F.col("n") == 1).alias("single"))
    fields = ("key", "pos", "near", "far", "single")
    blocks = hashes(with_texts(docs, saved(first, "open"), fields), unit, _blocks(unit), fields, "key long, block int, core long, whole long, rid long, pos long, near int, far int, single boolean")
    blocks = saved(blocks, "blocks")
    shared = blocks.groupBy("key", "block", "core").agg(F.count("*").alias("n"), F.max("single").alias("open")).filter("n > 1 and open").select("key", "block", "core")
    blocks = blocks.join(shared, ["key", "block", "core"])
    same = blocks.groupBy("key", "block", "whole").agg(F.count("*").alias("alike"), F.min(F.struct("rid", "pos")).alias("one"))
    blocks = saved(blocks.join(same, ["key", "block", "whole"]), "shared")
    settled.append(blocks.filter("single and alike > 1").select("rid", "pos", "near", "far"))

    # border blocks, and one of each kind of settled blocks to compare them with
    borders = blocks.filter("alike = 1 or (rid = one.rid and pos = one.pos)").withColumn("single", F.expr("single and alike = 1"))
    own = hashes(with_texts(docs, saved(borders.select("rid", *fields), "borders"), fields), unit, windows(unit), fields, "key long, d int, text long, rid long, pos long, single boolean")
    own = saved(own, "windows")
    twice = own.groupBy("key", "d", "text").agg(F.count("*").alias("n"), F.max("single").alias("open")).filter("n > 1 and open").select("key", "d", "text")
    settled.append(own.filter("single").join(twice, ["key", "d", "text"], "left_semi").select("rid", "pos", F.col("d").alias("near"), F.col("d").alias("far")))

    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("rid", (F.col("pos") - F.col("far")).alias("low"), (F.col("pos") - F.col("near")).alias("high"))
