"""Evidence: credibility, recency, quality, deduplication and graph-aware scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeezed
from ..scratch import saved

# Names in a source that raise its credibility.
HIGH = "nature|science|cell|nejm|lancet|arxiv|pnas|acm|ieee"
MEDIUM = "wikipedia|news|blog"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def credibility(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.when(low.rlike(HIGH), 0.9).when(low.rlike(MEDIUM), 0.7).otherwise(0.5)


def recency(date: Column, as_of_year: int) -> Column:
    """1 in the year of ``as_of``, a tenth less a year, at least .5; .5 for what no format reads."""
    parsed = F.coalesce(*[F.try_to_date(date, f) for f in DATE_FORMATS])
    return F.coalesce(clamp(F.greatest(F.lit(0.5), 1.0 - (as_of_year - F.year(parsed)) * 0.1)), F.lit(0.5))


def combined(cred: Column, rec: Column, rel: Column) -> Column:
    return 0.4 * cred + 0.3 * rec + 0.3 * rel


def exact_dedup(rows: DataFrame, text: str, score: str, tie: str) -> DataFrame:
    """The best row of each squeezed text; rows without a text are not copies of each other.

    Grouped by a digest of the text, so the shuffle carries no texts and a group of copies is combined before it.
    """
    keyed = rows.withColumn("__key", F.coalesce(F.sha2(squeezed(F.col(text)), 256), F.concat(F.lit("null "), F.col(tie).cast("string"))))
    best = keyed.groupBy("__key").agg(F.min_by(tie, F.struct(-F.col(score), F.col(tie))).alias(tie))
    return rows.join(best.select(tie), tie, "left_semi")


def greedy_dedup(rows: DataFrame, links: DataFrame, key: str, score: str) -> DataFrame:
    """Keep rows in order of score (ties by key) unless linked (a, b) to one kept before.

    Decided in rounds over the links alone: what no open link precedes is kept, what it is linked to is dropped.
    Groups are never gathered, and rows without a link are not touched.
    """
    rank = rows.select(F.col(key).alias("id"), F.struct(-F.col(score), F.col(key)).alias("rank"))
    ends = links.join(rank.withColumnsRenamed({"id": "a", "rank": "ra"}), "a").join(rank.withColumnsRenamed({"id": "b", "rank": "rb"}), "b")
    first = F.col("ra") < F.col("rb")
    edges = saved(ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), "links")
    dropped = edges.select(F.col("b").alias("id")).limit(0)
    while not edges.isEmpty():
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = saved(edges.join(kept, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        dropped = dropped.unionByName(out)
        edges = saved(edges.join(kept, "a", "left_anti").join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti"), "links")
    return rows.join(dropped.withColumnRenamed("id", key), key, "left_anti")


def graph_scores(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """``evidence`` (id, credibility, recency, relevance) with the support ratio of its edges and the mean
    confidence of its conflicts, and the composite of all five."""
    ends = edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), "support", "confidence")
    by = ends.groupBy("id").agg(F.avg(F.col("support").cast("double")).alias("s"), F.avg(F.when(~F.col("support"), F.col("confidence"))).alias("c"))
    out = evidence.join(by, "id", "left")
    out = out.withColumns({"support": F.coalesce("s", F.lit(0.5)), "conflict": F.coalesce("c", F.lit(0.0))})
    score = clamp(0.3 * F.col("credibility") + 0.2 * F.col("recency") + 0.3 * F.col("relevance") + 0.1 * F.col("support") - 0.1 * F.col("conflict"))
    return out.drop("s", "c").withColumn("score", score)


def claim_slots(scored: DataFrame, group: str, key: str, conflict: str, most: int = 6) -> DataFrame:
    """The best ``most`` of each group and all in conflict, in their original order (the key's)."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("__r", F.row_number().over(order)).filter((F.col("__r") <= most) | F.col(conflict)).drop("__r")


#: Share of pairs just at the wanted cosine that meet in a band, and the fewest bits of a band.
MEET, LEAST_BITS, MOST_BITS = 0.994, 12, 40


def banding(rows: int, least: float) -> tuple[int, int]:
    """(bands, bits a band) for this many vectors: bits grow with their logarithm, so that a vector meets about one other by chance in a band, and bands to the number that MEET takes."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, rows)))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - MEET) / math.log1p(-agree))) if agree < 1 else 1, bits


def cosine_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b) with a cosine of at least ``least``: vectors that are close on every sign-hyperplane of one of several bands.

    Bands are a blocking key; every pair they propose is verified.
    """
    count, size = banding(vectors.count(), least)

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for n, every in part.groupby(part["v"].map(len)):
                planes = np.random.default_rng(n).standard_normal((n, count * size))
                for low in range(0, len(every), 1000):
                    own = every.iloc[low : low + 1000]
                    x = np.array(own["v"].tolist(), dtype=np.float64)
                    bits = (x @ planes > 0).reshape(len(x), count, size)
                    codes = bits @ (1 << np.arange(size))
                    yield pd.DataFrame({"id": np.repeat(own["id"].to_numpy(), count), "band": np.tile(np.arange(count), len(x)), "code": codes.ravel()})

    keyed = vectors.select("id", "v").mapInPandas(bands, "id long, band int, code long")
    a, b = keyed.withColumnRenamed("id", "a"), keyed.withColumnRenamed("id", "b")
    met = a.join(b, ["band", "code"]).filter("a < b").select("a", "b").distinct()
    both = met.join(vectors.withColumnsRenamed({"id": "a", "v": "x"}), "a").join(vectors.withColumnsRenamed({"id": "b", "v": "y"}), "b")
    product = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return both.filter(product("x", "y") / F.sqrt(product("x", "x") * product("y", "y")) >= least).select("a", "b")
