"""Embedding near-duplicates by collision counting on one-dimensional projections.

Gaussian projections of two unit vectors at distance d differ by a normal value of deviation d.
A projection's window of half width h, centred on one vector, holds the other with
probability 2 Phi(h/d) - 1, so the number of windows that hold a pair at the
wanted cosine is binomial: the count that 99.9% of such pairs reach is the filter.

Counting over all pairs would be quadratic. Pairs to count come from ``tables``: each ranks some further sets of projections
of a vector and keeps which one leads, and pairs what agrees on all its leaders. The sets that a
table reads grow with the logarithm of the rows, so that chance meetings stay in proportion
to the rows; the tables are as many as 98.5% of simulated pairs at the threshold need to meet, which
hardly depends on the rows. A pair is counted in the first table where it meets, and verified in
double precision if it passes the count.

Exact copies are one entry with a weight. Vectors that are null, zero, or hold null or
non-finite components link with nothing; vectors link within one length only. Repeated rows are
copies of each other; a null vec_id is carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import saved, table, with_row_id

LEAST_COSINE, RECALL = 0.9, 0.985
COUNTED, COUNT_RECALL = 64, 0.999
WINDOW = 1.5
#: Projections of which a table keeps the leader, and the mates by chance that a vector may have in a table.
LEADERS, MATES = 64, 4
#: Pairs that are simulated to choose the number of tables, and the most tables.
SIMULATED, MOST_TABLES = 2_000, 400
#: Projections are kept as whole steps of this size, in a byte.
STEP = 1 / 24


def usable(embedding: str = "embedding") -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def least_count(distance: float, counted: int = COUNTED, recall: float = COUNT_RECALL) -> int:
    """The largest count that pairs at this distance reach with probability ``recall``."""
    p = 2 * _phi(WINDOW) - 1
    left = 0.0
    for c in range(counted + 1):
        left += math.comb(counted, c) * p**c * (1 - p) ** (counted - c)
        if left > 1 - recall:
            return c
    return counted


def directions(table: int, dimension: int, sets: int) -> np.ndarray:
    return np.random.default_rng([20, dimension, table]).standard_normal((sets, dimension, LEADERS))


def leaders(x: np.ndarray, table: int, sets: int) -> np.ndarray:
    """The cell of each unit vector: which of the projections leads, and its sign, in each set."""
    cell = np.zeros(len(x), dtype=np.int32)
    for d in directions(table, x.shape[1], sets):
        p = x @ d
        lead = np.abs(p).argmax(axis=1)
        cell = cell * (2 * LEADERS) + 2 * lead + (p[np.arange(len(x)), lead] > 0)
    return cell.astype(np.int32)


def plan(rows: int, dimension: int, cosine: float = LEAST_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, sets a table) for this many distinct vectors: simulated pairs at ``cosine`` tell how many tables they need."""
    sets = min(4, max(1, math.ceil(math.log(max(2, rows) / MATES) / math.log(2 * LEADERS))))
    rng = np.random.default_rng(dimension)
    x, z = unit(rng.standard_normal((SIMULATED, dimension))), rng.standard_normal((SIMULATED, dimension))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * unit(z) if dimension > 1 else x
    met = np.zeros(SIMULATED, dtype=bool)
    for t in range(MOST_TABLES):
        met |= leaders(x, t, sets) == leaders(y, t, sets)
        if met.mean() >= recall:
            break
    return t + 1, sets


def matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors in double precision) for each length of a list column without nulls."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, values[offsets[at][:, None] + np.arange(n)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def candidates(distinct: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(a, b), a < b: pairs of ``distinct`` (rid, embedding) that share a cell and pass the count, each once."""
    # one row for each length of vectors
    plans = {r["n"]: plan(r["count"], r["n"], cosine) for r in distinct.groupBy(F.size("embedding").alias("n")).count().collect()}
    distance = math.sqrt(2 - 2 * cosine)
    enough, reach = least_count(distance), round(WINDOW * distance / STEP)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            for low in range(0, b.num_rows, 2048):
                part = b.column(1).slice(low, 2048)
                for at, x in matrix(part):
                    x = unit(x)
                    size, (tables, sets) = x.shape[1], plans[x.shape[1]]
                    counted = x @ np.random.default_rng([20, size]).standard_normal((size, COUNTED))
                    codes = np.clip(np.rint(counted / STEP), -127, 127).astype(np.int8).tobytes()
                    codes = [codes[i : i + COUNTED] for i in range(0, len(codes), COUNTED)]
                    cells = np.stack([leaders(x, t, sets) for t in range(tables)], axis=1)
                    flat = pa.array(cells.ravel(), pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[low + at]), pa.array(np.full(len(x), size, np.int32)), lists, pa.array(codes, pa.binary())], ["rid", "size", "cells", "codes"])

    vectors = saved(distinct.select("rid", "embedding").mapInArrow(project, "rid long, size int, cells array<int>, codes binary"), "leaders")
    met = ["size", "t", "cell"]
    shared = vectors.select("size", F.posexplode("cells").alias("t", "cell")).groupBy(*met).agg(F.count("*").alias("n")).filter("n > 1").select(*met)
    rows = vectors.select("*", F.posexplode("cells").alias("t", "cell")).join(shared, met)
    rows = saved(rows, "cells")
    pairs = rows.alias("x").join(rows.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in met] + [F.col("x.rid") < F.col("y.rid")])
    first = F.array_position(F.zip_with("x.cells", "y.cells", lambda i, j: i == j), F.lit(True)) == F.col("x.t") + 1
    pairs = pairs.filter(first).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), F.col("x.codes").alias("p"), F.col("y.codes").alias("q"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.int8).reshape(-1, COUNTED).astype(np.int16) for i in (2, 3))
            keep = pa.array((np.abs(p - q) <= reach).sum(axis=1) >= enough)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.mapInArrow(count, "a long, b long")


def links(distinct: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(a, b, cosine) of verified pairs of distinct vectors."""
    own = distinct.select("rid", "embedding")
    pairs = candidates(distinct, cosine).join(own.withColumnsRenamed({"rid": "a", "embedding": "x"}), "a").join(own.withColumnsRenamed({"rid": "b", "embedding": "y"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for at, x in matrix(b.column(2)):
                y = np.array(b.column(3).take(pa.array(at)).to_pylist(), dtype=np.float64)
                out[at] = (unit(x) * unit(y)).sum(axis=1)
            keep = pa.array(out >= cosine)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(out).filter(keep)], ["a", "b", "cosine"])

    return pairs.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, cosine double")


def near_duplicates(embeddings: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept."""
    rows = with_row_id(embeddings, "vec_id", "embedding")
    rows = rows.withColumn("embedding", F.when(usable(), F.col("embedding")))
    distinct = saved(rows.filter("embedding is not null").groupBy("embedding").agg(F.min("rid").alias("rid"), F.count("*").alias("weight")), "distinct")
    found = saved(links(distinct, cosine), "links")
    weight = distinct.select("rid", "weight")
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(weight.withColumnRenamed("rid", "b"), "b").groupBy(F.col("a").alias("rid")).agg(F.sum("weight").alias("others"))
    parts = components(found.select("a", "b")).withColumnsRenamed({"id": "rid"})
    classes = distinct.join(others, "rid", "left").join(parts, "rid", "left")
    classes = classes.select("embedding", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("part"))
    # copies of a vector may be most rows: the side of classes has one row for each
    placed = saved(rows.join(classes, "embedding", "left").select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", "rid").alias("part")), "placed")
    least = placed.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    out = placed.join(least, "part").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
