"""Approximate nearest neighbours on balanced posting lists.

``fit`` clusters a bounded sample into lists of ``LIST_ROWS`` rows, up to twice as many: parts are halved until they
are balanced, then settle in two rounds of k-means. The centroids and a graph of their near
neighbours go to the workers. Every vector is posted to its nearest centroid and, where it lies on a boundary, to the
next one. A query walks the graph and reads the lists whose distance is within a ratio of that to the nearest ones,
and further ones until they hold enough rows for ``k`` neighbours. Boundary and ratio are those that
reach ``RECALL`` on held-out rows of the sample with the fewest rows read.

Of equal vectors only the ``k + 1`` of least id are posted, as no more can be among ``k`` neighbours: a
vector that a third of all rows share costs eleven. Lists and queries meet in blocks of bounded
size, however long a list is, and every task keeps ``k`` neighbours a query.

Bounds: the sample has about ``SAMPLE`` rows, ``SAMPLE_LIST`` of them at least for each centroid; so there are at most
``SAMPLE / SAMPLE_LIST`` centroids, 4,096 as they are halved (2 MB for 64 dimensions), and beyond some 130,000 rows lists grow. All rows are indexed.

Vectors that are null, zero or hold null or non-finite components take no part. Vectors of another length have no distance:
each length has lists of its own. Rows without a vec_id are left out. Rows that share a vec_id are different rows, and
neighbours of each other. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table, with_row_id
from .vectors import matrix, usable

K, EVERY = 10, 100
SAMPLE, SAMPLE_LIST, LIST_ROWS = 40_000, 8, 16
#: A vector is also posted to its second centroid where that is at most this many times as far as the first.
BOUNDARIES = (1.01, 1.03, 1.06)
COPIES = 2
#: A query's distances to lists are taken relative to the mean over this many nearest: that to the nearest alone varies, being small where the query was in the sample.
NEAREST = 8
RECALL = 0.95
BLOCK = 512
FLUSH = 100_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def _parts(x: np.ndarray, rows: int = 512) -> list[np.ndarray]:
    """Parts of few rows: their distances to all centroids are what takes memory."""
    return [x[i : i + rows] for i in range(0, len(x), rows)]


class Centroids:
    """Centroids of the vectors of one length, their graph, and the calibrated boundary and ratio."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        sample = sample[rng.permutation(len(sample))]
        held = sample[: len(sample) // 4]
        self.points = _settled(_balanced(sample[len(held) :], lists, rng), sample[len(held) :])
        n = len(self.points)
        # near neighbours and, lest the graph fall into parts, as many others at random; a search starts from an even share of all
        self.graph = np.concatenate([np.argsort(distances(p, self.points), axis=1)[:, 1 : min(n, 25)] for p in _parts(self.points)])
        self.graph = np.concatenate([self.graph, rng.integers(0, n, self.graph.shape)], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, int(min(n, 6 * n**0.5))).astype(int))
        self.boundary, self.ratio = self._calibrate(held)

    def _calibrate(self, held: np.ndarray) -> tuple[float, float]:
        """Of the boundaries, the one that reaches RECALL with the fewest rows read, and its ratio."""
        if len(held) < 3 * K or len(self.points) < 2:
            return BOUNDARIES[0], float("inf")
        asked = held[:400]
        d = distances(asked, held)
        d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        hits = np.argsort(d, axis=1)[:, :K]
        to = distances(asked, self.points)
        to /= np.maximum(self.near(to)[:, None], 1e-12)
        best = None
        for boundary in BOUNDARIES:
            first, second = (np.concatenate(x) for x in zip(*[self.post(p, boundary) for p in _parts(held)], strict=True))
            # the ratio at which a query reaches each row of ``held``
            at = to[:, first]
            at = np.where(second >= 0, np.minimum(at, to[:, second]), at)
            ratio = float(np.quantile(np.take_along_axis(at, hits, 1), RECALL)) * 1.0001
            read = (to[:, first] <= ratio).sum() + ((to[:, second] <= ratio) & (second >= 0)).sum()
            if best is None or read < best[0]:
                best = read, boundary, ratio
        return best[1:]

    @staticmethod
    def near(d: np.ndarray) -> np.ndarray:
        """Mean distance to the nearest lists."""
        n = min(NEAREST, d.shape[-1])
        return np.partition(d, n - 1, axis=-1)[..., :n].mean(axis=-1)

    def post(self, x: np.ndarray, boundary: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row, and the second one or -1."""
        d = distances(x, self.points)
        first = d.argmin(axis=1)
        if len(self.points) == 1:
            return first, np.full(len(x), -1)
        least = d[np.arange(len(x)), first]
        d[np.arange(len(x)), first] = np.inf
        second = d.argmin(axis=1)
        close = d[np.arange(len(x)), second] <= least * (self.boundary if boundary is None else boundary)
        return first, np.where(close, second, -1)

    def search(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
        """Lists within the ratio of the nearest centroid, found on the graph from its entries; more while they hold too few rows."""
        d = np.full(len(self.points), np.inf)
        d[self.entries] = distances(q[None], self.points[self.entries])[0]
        seen = np.zeros(len(self.points), dtype=bool)
        wide = min(31, len(d) - 1)
        while True:
            bound = max(self.near(d) * self.ratio, np.partition(d, wide)[wide])
            front = np.flatnonzero(~seen & (d <= bound))
            if not len(front):
                break
            seen[front] = True
            to = np.unique(self.graph[front])
            to = to[np.isinf(d[to])]
            d[to] = distances(q[None], self.points[to])[0]
        chosen = d <= max(self.near(d) * self.ratio, d.min())
        if sizes[chosen].sum() < enough:
            d = distances(q[None], self.points)[0]
            order = np.argsort(d, kind="stable")
            held = np.cumsum(sizes[order])
            chosen[order[: int(np.searchsorted(held, enough)) + 1]] = True
        return np.flatnonzero(chosen)


def _settled(points: np.ndarray, x: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Two rounds of k-means; a centroid that loses all its rows stays where it is."""
    for _ in range(rounds if len(points) > 1 else 0):
        nearest = np.concatenate([distances(p, points).argmin(axis=1) for p in _parts(x)])
        sums = np.zeros_like(points)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(points))
        points = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points)
    return points


def _balanced(x: np.ndarray, lists: int, rng) -> np.ndarray:
    """Centroids of a recursive split: parts are halved as often as makes ``lists`` at most."""
    share = -(-len(x) // (1 << max(1, lists).bit_length() - 1))
    todo, done = [x], []
    while todo:
        part = todo.pop()
        if len(part) <= share or len(np.unique(part[:: max(1, len(part) // 64)], axis=0)) < 2:
            done.append(part.mean(axis=0))
            continue
        # two-means axis, then the median: both halves hold the same number
        c = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            side = distances(part, c).argmin(axis=1)
            if side.min() == side.max():
                break
            c = np.stack([part[side == 0].mean(axis=0), part[side == 1].mean(axis=0)])
        axis = c[1] - c[0]
        order = np.argsort(part @ axis, kind="stable")
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return np.array(done)


class Index:
    """What the workers get: a model for each length, and the number of its first list."""

    def __init__(self, models: dict[int, Centroids | None]):
        self.models, self.first, self.lists = models, {}, 0
        for length in sorted(models):
            self.first[length] = self.lists
            self.lists += len(models[length].points) if models[length] else 1
        self.sizes = np.zeros(self.lists, dtype=np.int64)

    def sized(self, counts: dict[int, int]) -> "Index":
        for k, n in counts.items():
            self.sizes[k] = n
        return self

    def post(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their lists), once or twice."""
        model, base = self.models[x.shape[1]], self.first[x.shape[1]]
        rows = np.arange(len(x))
        if model is None:
            yield rows, np.full(len(x), base)
            return
        first, second = model.post(x)
        yield rows, base + first
        yield rows[second >= 0], base + second[second >= 0]

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        model, base = self.models[len(q)], self.first[len(q)]
        if model is None:
            return np.array([base])
        own = self.sizes[base : base + len(model.points)]
        return base + model.search(q, own, COPIES * (k + 1))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Index:
    """Lists for ``vectors`` (rid, embedding), from about ``sample`` rows taken by a hash; a length of few rows is one list."""
    lengths = {r["n"]: r["count"] for r in vectors.groupBy(F.size("embedding").alias("n")).count().collect()}
    total = sum(lengths.values())
    rows = vectors.select("rid", "embedding")
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("rid", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    found = rows.toArrow().sort_by("rid")["embedding"].combine_chunks()
    models: dict[int, Centroids | None] = dict.fromkeys(lengths)
    if len(found):
        for _, x in matrix(found):
            lists = min(lengths[x.shape[1]] // LIST_ROWS, len(x) // SAMPLE_LIST)
            if lists > 1:
                models[x.shape[1]] = Centroids(x, lists)
    return Index(models)


def _assign(rows: DataFrame, index, way: str, k: int) -> DataFrame:
    """(list, rid, vec_id, vector): postings, or the lists that queries read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                for at, x in matrix(part.column(2)):
                    if way == "post":
                        placed = own.post(x)
                    else:
                        found = [own.search(q, k) for q in x]
                        placed = [(np.repeat(np.arange(len(x)), [len(f) for f in found]), np.concatenate(found))]
                    raw = [v.tobytes() for v in x]
                    for which, lists in placed:
                        ids = part.take(pa.array(at[which]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(lists, pa.int32()), ids.column(0), ids.column(1), pa.array([raw[i] for i in which], pa.binary())],
                            ["list", "rid", "vec_id", "vector"],
                        )

    return rows.select("rid", "vec_id", "embedding").mapInArrow(scan, "list int, rid long, vec_id long, vector binary")


def _blocks(rows: DataFrame, sizes: dict[int, int], name: str) -> DataFrame:
    """Rows of a list in blocks of about BLOCK, as (list, name)."""
    parts = rows.sparkSession.createDataFrame([(k, max(1, -(-n // BLOCK))) for k, n in sizes.items()], "list int, parts int")
    dealt = rows.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("rid"), "parts"))
    grouped = dealt.groupBy("list", "part").agg(F.collect_list(F.struct("rid", "vec_id", "vector")).alias(name))
    return grouped.select("list", name)


def _nearest(k: int):
    """The ``k`` nearest rows of each query that a task meets."""

    def unpack(cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = cell.values
        raw = v.field(2).to_pylist()
        return v.field(0).to_numpy(), v.field(1).to_numpy(), np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {}

        def out() -> pa.RecordBatch:
            flat = [(q, r, v, d) for q, hits in best.items() for d, v, r in hits]
            best.clear()
            q, r, v, d = zip(*flat, strict=True) if flat else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["asked", "rid", "vec_id", "score"])

        for b in batches:
            for rows, asked in zip(b.column(0), b.column(1), strict=True):
                rid, ids, x = unpack(rows)
                own, _, q = unpack(asked)
                rough = (x * x).sum(1) - 2 * q @ x.T
                for i, query in enumerate(own.tolist()):
                    a = np.where(rid == query, np.inf, rough[i])
                    bound = np.partition(a, k - 1)[k - 1] if len(a) > k else np.inf
                    near = np.flatnonzero((a <= bound + 1e-9 * (1 + abs(bound))) & np.isfinite(a))
                    diff = x[near] - q[i]
                    d = np.sqrt((diff * diff).sum(axis=1))
                    hits = dict.fromkeys(best.get(query, ())) | dict.fromkeys(zip(d.tolist(), ids[near].tolist(), rid[near].tolist(), strict=True))
                    best[query] = sorted(hits)[:k]
            if len(best) > FLUSH:
                yield out()
        yield out()

    return work


def search(vectors: DataFrame, asking: F.Column, k: int = K) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) for each of its rows that ``asking`` selects: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = with_row_id(vectors.filter(usable() & F.col("vec_id").isNotNull()), "vec_id", "embedding")
    queries = rows.filter(asking)
    copies = Window.partitionBy("embedding").orderBy("vec_id", "rid")
    first = rows.withColumn("__copy", F.row_number().over(copies)).filter(F.col("__copy") <= k + 1).drop("__copy")
    index = fit(rows)
    counted = lambda rows: {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}  # noqa: E731  one row a list
    posted = saved(_assign(first, spark.sparkContext.broadcast(index), "post", k), "postings")
    lists = counted(posted)
    asked = saved(_assign(queries, spark.sparkContext.broadcast(index.sized(lists)), "search", k), "asked")
    wanted = counted(asked)
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    meet = _blocks(posted, lists, "rows").join(_blocks(asked, wanted, "queries"), "list")
    found = meet.select("rows", "queries").mapInArrow(_nearest(k), "asked long, rid long, vec_id long, score double").distinct()
    order = Window.partitionBy("asked").orderBy("score", "vec_id", "rid")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = queries.select(F.col("rid").alias("asked"), F.col("vec_id").alias("query_id"))
    return found.join(names, "asked").select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % EVERY == 0)
