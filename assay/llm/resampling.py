"""Importance resampling towards a target distribution, on hashed n-gram features.

A feature is a run of 1 to n consecutive words; its bucket is its CRC32 modulo the number of buckets. A bucket's gain is the
logarithm of how much likelier it is in the target than in the documents, a document's weight the floored mean of the gains of
its features, and its score the weight plus Gumbel noise that follows from its id: the highest scores are a draw without
replacement in proportion to the weights.

In a task the features of a batch are interned in an open-addressed table (``intern.Table``): a slot holds a feature's bucket
and its count, so a bucket is computed once a feature and batch. The documents are read twice: the counts of the slots are
summed to one number a bucket, then each occurrence's slot gathers its gain. What the driver sees are the counts of the
buckets, as many as the parameter says. Highest scores are found by counts of scores, and only what is drawn is sorted.

Null, empty and wordless texts have no features and weight 0. Repeated rows are documents each and score alike; a null doc_id is
hashed as the empty string. An empty target gives all buckets nearly one gain; without documents the result is empty. Texts of
any length are read whole, in parts. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, raw_texts, saved, table
from .intern import Table, words

N, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, "2024"
_WORD = np.ones(256, dtype=bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x41] = _WORD[0x5B:0x61] = _WORD[0x7B:0x80] = False  # A-Z are lower-cased


def _interned(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> Iterator[tuple]:
    """Parts of texts as (text of each feature, its slot, slots in use, their buckets, whether a feature is one word)."""
    for part in words(data, offsets, _WORD, reach=n - 1):
        first, last = [], []
        at = np.arange(part.own)
        for longer in range(n):
            at = at[at + longer < len(part.text)]
            at = at[part.text[at + longer] == part.text[at]]
            first.append(at)
            last.append(at + longer)
        first, last = np.concatenate(first), np.concatenate(last)
        own = Table(part.data, len(first))
        slots = own.put(part.start[first], part.end[last])
        used = own.used()
        yield part.text[first], slots, used, own.crc32(used) % buckets, own.mask + 1, first == last


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts`` in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, slots, used, bucket, size, _ in _interned(*raw_texts(b.column(0)), n, buckets):
                np.add.at(total, bucket, np.bincount(slots, minlength=size)[used])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = map_texts(texts.select(F.col(text_col).cast("string")), count, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log-ratio of each bucket's smoothed shares."""
    S, T, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (S + k) / ((s + 1) * (T + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            total, features, single = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for text, slots, used, bucket, size, one in _interned(*raw_texts(b.column(1)), n, len(gain)):
                of_slot = np.zeros(size, dtype=np.int64)
                of_slot[used] = gain[bucket]
                np.add.at(total, text, of_slot[slots])
                features += np.bincount(text, minlength=b.num_rows)
                single += np.bincount(text[one], minlength=b.num_rows)
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(single), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return map_texts(kept, weigh, f"doc_id {dict(kept.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: str = SEED) -> DataFrame:
    """``weights`` with ``score``: the weight plus noise that follows from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weights.withColumn("score", (F.col("weight") + noise).cast("long"))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... for the highest scores among documents of enough words, else null.

    ``rows`` is a written table. Scores are floored thousandths of logarithms, so there are some 10**5 of them at most,
    and the count of each tells the last one that is drawn.
    """
    enough = F.col("n_words") >= least_words
    counts = rows.filter(enough).groupBy("score").agg(F.count("*").alias("n")).toArrow().to_pydict()
    order = sorted(zip(counts["score"], counts["n"], strict=True), reverse=True)
    room = percent * sum(n for _, n in order) // 100
    taken, cut = 0, None
    for score, n in order:
        if taken >= room:
            break
        taken, cut = taken + n, score
    none = F.lit(None).cast("long")
    if cut is None:
        return rows.withColumn("rank", none)
    at_top = enough & (F.col("score") >= cut)
    best = rows.filter(at_top).withColumn("tie", F.monotonically_increasing_id())
    best = best.repartitionByRange(F.desc("score"), F.asc("doc_id"), "tie").sortWithinPartitions(F.desc("score"), "doc_id", "tie")
    best = saved(best.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "drawn")
    before, sizes = 0, {}
    for part, n in sorted(best.groupBy("part").count().collect()):  # a row a partition
        sizes[part], before = before, before + n
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("part"))
    rank = offset + F.col("at") + 1
    best = best.withColumn("rank", F.when(rank <= room, rank).cast("long"))
    columns = [*rows.columns, "rank"]
    return best.select(*columns).unionByName(rows.filter(~at_top).withColumn("rank", none).select(*columns))


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    gain = gains(bucket_counts(docs, n=n, buckets=buckets), bucket_counts(target, n=n, buckets=buckets))
    return drawn(saved(scored(weighed(docs, gain, n), seed), "scores"), percent, least_words)


#: CRC32 is folded over the bytes of each distinct word; its table of 256 follows from the polynomial.
OP13_SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS c FROM (SELECT unnest(range(256)) AS b)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
own AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM docs) GROUP BY 1, 2),
forms AS (SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT w, n AS s, 0 AS t FROM own UNION ALL SELECT w, 0, 1 FROM aims) GROUP BY 1),
hashed AS (SELECT w, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc.c[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM forms, crc),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
totals AS (SELECT rid, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM own JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1),
weights AS (SELECT docs.rid, doc_id, coalesce(n, 0) AS n_features, coalesce(CASE WHEN g < 0 THEN -((n - 1 - g) // n) ELSE g // n END, 0) AS weight FROM docs LEFT JOIN totals USING (rid)),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM weights),
places AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS room FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= room THEN rank END AS rank FROM scores LEFT JOIN places USING (rid)
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
