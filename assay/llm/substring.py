"""Substring dedup with a log-structured index of window fingerprints.

Documents come in batches. A batch's fingerprints become a run: a table sorted and bucketed
by fingerprint that never changes. Each new run is merge-joined with the older ones, bucket by
bucket and without a shuffle: a fingerprint seen before makes the batch's windows candidates, and also
the one older window that had it alone. Then the runs are compacted into one. Candidates of
all batches are verified word window by word window (``repeats``).

A null or empty text has no words; texts of fewer than ``LENGTH`` words lose nothing;
repeated rows are copies of each other; a null doc_id is carried.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, with_row_id
from .repeats import repeats
from .scan import Bitmap, Unit, anchors, covered, rewritten, word_symbols

LENGTH, ANCHOR = 35, 6
BATCHES, FAN_IN = 2, 2
COLUMNS = "n_words long, n_removed long, kept_sha256 string"


class Index:
    """Sorted immutable runs (key, n, and the segment of a key that is alone) in the warehouse."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN, runs: tuple[str, ...] = ()):
        """``runs``: names of an earlier index's runs, to go on with it."""
        self.spark, self.fan_in, self.runs = spark, fan_in, list(runs)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "key").sortWithinPartitions("key").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        self.runs.append(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Append ``batch`` (segments) as a run. Returns its repeated keys and older segments now repeated."""
        older = [self.spark.table(r) for r in self.runs]
        run = self.write(batch.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos", "kind", "near", "far")).alias("one")))
        known, woken = run.filter("n > 1").select("key"), []
        for old in older:
            both = old.join(run.select("key"), "key")
            known = known.unionByName(both.select("key"))
            woken.append(saved(both.filter("n = 1").select("key", "one.*"), "woken"))
        return saved(known.distinct(), "known"), woken

    def compact(self) -> None:
        """Merge the runs into one when there are ``fan_in`` of them."""
        if len(self.runs) < self.fan_in:
            return
        old, self.runs = self.runs, []
        rows = self.spark.table(old[0])
        for r in old[1:]:
            both = rows.withColumnsRenamed({"n": "n0", "one": "one0"}).join(self.spark.table(r), "key", "full")
            rows = both.select("key", (F.coalesce("n0", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("one0", "one").alias("one"))
        self.write(rows)
        for r in old:
            self.spark.sql(f"DROP TABLE {r}")

    def drop(self) -> None:
        for r in self.runs:
            self.spark.sql(f"DROP TABLE {r}")
        self.runs = []


def add_batch(index: Index, batch: DataFrame, unit: Unit) -> list[DataFrame]:
    """Enter ``batch`` (rid, text) into the index. Returns its segments whose anchor has been seen, in it or before, and the older segments that it repeats."""
    keys, woken = index.add(anchors(batch, unit))
    found = saved(anchors(batch, unit, Bitmap(keys, "key")).join(keys, "key"), "candidates")
    index.compact()
    return [found, *woken]


def together(found: list[DataFrame], batches: int) -> DataFrame:
    """Segments of several batches, each once: with three or more, one may be repeated by two later batches."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f.select(*out.columns))
    return out.dropDuplicates(["key", "rid", "pos", "near"]) if batches > 2 else out


def candidates(docs: DataFrame, unit: Unit, batches: int = BATCHES) -> DataFrame:
    """Segments of ``docs`` (rid, text) whose anchor occurs more than once, found batch by batch by an index that is dropped then."""
    index, found = Index(docs.sparkSession), []
    try:
        for b in range(batches):
            found += add_batch(index, docs.filter(F.pmod(F.xxhash64("rid"), F.lit(batches)) == b), unit)
    finally:
        index.drop()
    return together(found, batches)


def digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    docs = with_row_id(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", "text")
    unit = Unit(word_symbols, length, anchor)
    spans = repeats(docs, candidates(docs, unit, batches).withColumn("alike", F.lit(False)), unit)

    def whole(text: bytes) -> tuple:
        words = text.split()
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()

    def cut(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple:
        words = text.split()
        gone = covered(len(words), low, high, length)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    return rewritten(docs, spans, whole, cut, COLUMNS)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
