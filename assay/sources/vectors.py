"""A vector index as Parquet tables: versions, lists of vectors near one centroid as partitions, centroids, a table of versions.

Vectors are dealt to lists by the direction of the nearest centroid; centroids are settled on a bounded sample. A search looks at the lists
whose centroids are nearest to a query and reads their partitions only; over all lists it is exact. A version counts once its
line is in the table of versions, appended after its data: a reader that has opened one keeps it while the next is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import DIGITS, RRF_K, check_k, dot, fused, norm, top
from .index import search as search_terms

#: Lists at most, and rows of the sample for each.
LISTS, ROWS_A_LIST, ROUNDS = 4_096, 16, 4
VERSIONS = "version int, rows long, lists int, width int"


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _usable(v: str) -> F.Column:
    return F.col(v).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Directions settled by k-means from evenly spaced rows of a sample of unit vectors."""
    own = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        near = (sample @ own.T).argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.where(size > 0, sums / np.where(size == 0, 1, size), own)
    return own


def save(rows: DataFrame, path: str, id_col: str = "doc_id", vector: str = "v", lists: int | None = None) -> int:
    """Write ``rows`` as the next version of the index; its number. All vectors have one width, else this raises; unusable ones (null, empty, not finite) are left out."""
    kept = rows.filter(_usable(vector)).select(F.col(id_col).alias("doc_id"), F.col(vector).cast("array<double>").alias("v"))
    seen = kept.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if not seen["n"]:
        raise ValueError("there is no vector to index")
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors of {seen['least']} and of {seen['most']} components")
    lists = min(seen["n"], LISTS, lists or max(1, math.isqrt(seen["n"])))
    order = F.xxhash64("doc_id", "v")
    bound = lists * ROWS_A_LIST
    share = min(1.0, 1.5 * bound / seen["n"])
    sample = kept.withColumn("h", order).filter(F.pmod("h", F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy("h").limit(bound).select("v").toArrow()
    own = centroids(_units(sample["v"].to_pylist()), min(lists, sample.num_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_units(b.column(1).to_pylist()) @ own.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], ["doc_id", "v", "list"])

    spark, version = rows.sparkSession, (_versions(rows.sparkSession, path)[-1:] or [(0,)])[0][0] + 1
    dealt = kept.mapInArrow(deal, f"doc_id {dict(kept.dtypes)['doc_id']}, v array<double>, list int")
    dealt.repartition("list").write.partitionBy("list").parquet(f"{path}/v{version}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(own)], "list int, v array<double>").coalesce(1).write.parquet(f"{path}/v{version}/centroids")
    spark.createDataFrame([(version, seen["n"], len(own), seen["most"])], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def _versions(spark: SparkSession, path: str) -> list[tuple]:
    import pyspark.errors

    try:
        return sorted(map(tuple, spark.read.schema(VERSIONS).parquet(f"{path}/versions").collect()))  # a line a version
    except pyspark.errors.AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []


class Index:
    """A version of the index at ``path``, the newest unless one is named."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        known = _versions(spark, path)
        chosen = [v for v in known if version in (None, v[0])]
        if not chosen:
            raise ValueError(f"no such version of an index at {path}" if known else f"no index at {path}")
        self.version, self.rows, self.lists, self.width = chosen[-1]
        at = f"{path}/v{self.version}"
        self.vectors = spark.read.parquet(f"{at}/lists")
        self.centroids = _units(spark.read.parquet(f"{at}/centroids").orderBy("list").toArrow()["v"].to_pylist())  # at most LISTS rows

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score): cosine top k of queries (query_id, q) in their ``probes`` nearest lists, or in all."""
        check_k(k)
        wide = queries.filter(F.size("q") != self.width).select(F.size("q")).first()
        if wide:
            raise ValueError(f"a query of {wide[0]} components, an index of {self.width}")
        vectors = self.vectors.withColumn("vn", norm("v"))
        asked = queries.withColumn("qn", norm("q"))
        if probes is None or probes >= self.lists:
            both = vectors.crossJoin(asked)  # exact: each vector meets each query of a stated set
        else:
            own, most = self.centroids, probes

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        order = np.argsort(-(_units(b.column(1).to_pylist()) @ own.T), axis=1, kind="stable")[:, :most]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))), pa.array(order.ravel().astype(np.int32))], ["query_id", "list"])

            probed = queries.select("query_id", F.col("q").cast("array<double>")).mapInArrow(near, f"query_id {dict(queries.dtypes)['query_id']}, list int")
            chosen = [r[0] for r in probed.select("list").distinct().collect()]  # at most LISTS numbers: partitions to read
            both = vectors.filter(F.col("list").isin(chosen)).join(probed, "list").join(asked, "query_id")
        scores = both.select("query_id", "doc_id", F.round(dot("v", "q") / (F.col("vn") * F.col("qn")), DIGITS).alias("score"))
        return top(scores, "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")

    def hybrid(self, terms: dict[str, DataFrame], queries: DataFrame, k: int, depth: int = 100, weights: tuple[float, float] = (0.3, 0.7), probes: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
        """Fusion of a saved sparse index (``index.load``) and this one: queries (query_id, query, q); one without a vector is asked for its terms only."""
        sparse = search_terms(terms, queries.select("query_id", "query"), depth)
        return fused([(sparse, weights[0]), (self.search(queries.filter("q is not null").select("query_id", "q"), depth, probes), weights[1])], k, rrf_k)
