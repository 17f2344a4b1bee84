"""Bootstrap intervals, paired tests, agreement and calibration.

Draws are hashes of (seed, replicate, stratum, draw), so every engine and every run draws alike.
A statistic over rows is first summed by cluster; replicates then weigh the sums, which costs
replicates times clusters and not replicates times rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import saved

RESAMPLES, SEED = 2_000, 1729
TIE = 1e-12


def draw(*parts: Column, n: Column) -> Column:
    """A number from 1 to n from the first 32 bits of an md5 digest."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n) + 1


def draws(units: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(replicate, stratum, i): the units that replicates draw, as many of each stratum as it has.

    ``units`` (stratum, i from 1 to n, n): the k-th draw of all replicates is made where unit k is, and units are dealt evenly to tasks.
    """
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.repartition(parts, "stratum", "i").select("stratum", "n", F.col("i").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"))
    return rows.select("replicate", "stratum", draw(F.lit(seed), F.col("replicate"), F.col("stratum"), F.col("k"), n=F.col("n")).alias("i"))


def numbered(rows: DataFrame, stratum: Column, order: str) -> DataFrame:
    """``rows`` with stratum, i, from 1 in order of ``order`` within the stratum, and its size n.

    Rows are sorted in ranges; a row's number is that in its range and the rows of the stratum in the ranges before, so no task sorts a stratum.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("stratum", stratum).repartitionByRange(ranges, "stratum", order)
    rows = saved(rows.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("stratum", "__range").agg(F.count("*").alias("__n"))  # at most strata and ranges together
    every = Window.partitionBy("stratum")
    sizes = sizes.withColumns({"n": F.sum("__n").over(every), "__before": F.sum("__n").over(every.orderBy("__range")) - F.col("__n")})
    within = F.row_number().over(Window.partitionBy("stratum", "__range").orderBy(order))
    rows = rows.withColumn("i", within.cast("long")).withColumnRenamed("stratum", "__stratum").withColumnRenamed("__range", "__own")
    met = F.col("__stratum").eqNullSafe(F.col("stratum")) & (F.col("__own") == F.col("__range"))
    placed = rows.join(F.broadcast(sizes), met).withColumn("i", F.col("i") + F.col("__before"))
    return placed.drop("__stratum", "__own", "__range", "__n", "__before")


def bootstrap(units: DataFrame, value: str, weight: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(replicate, estimate): sum of ``value`` over sum of ``weight`` of the drawn units (stratum, i, value, weight).

    Draws meet their units in parts of both, of which only the units are held in memory.
    """
    if "n" not in units.columns:
        units = units.join(units.groupBy("stratum").agg(F.count("*").alias("n")), "stratum")
    units = saved(units.select("stratum", "i", "n", F.col(value).alias("__value"), F.col(weight).alias("__weight")), "units")
    drawn = draws(units, resamples, seed).join(units.drop("n").hint("shuffle_hash"), ["stratum", "i"])
    return drawn.groupBy("replicate").agg((F.sum("__value") / F.sum("__weight")).alias("estimate"))


def interval(estimates: DataFrame, column: str = "estimate", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    at = lambda p: F.round(F.percentile(column, F.lit(p)), 6)
    return estimates.agg(F.count("*").alias("resamples"), at(tail).alias("lower"), at(1 - tail).alias("upper"))


def outcomes(paired: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return paired.agg(F.count_if(d > TIE).alias("wins"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.count_if(d < -TIE).alias("losses"))


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p value of b and c discordant pairs; 1 without any."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.exp(max(log)) * sum(math.exp(x - max(log)) for x in log))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two annotators; 1 where both only ever use one label."""
    cells = rows.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("p")), cells.groupBy("b").agg(F.sum("n").alias("q"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("pq"))
    both = total.crossJoin(chance)  # one row each
    agree, expected = F.col("same") / F.col("n"), F.col("pq") / (F.col("n") * F.col("n"))
    return both.select(F.col("n").cast("long").alias("n"), agree.alias("agreement"), F.when(expected == 1, 1.0).otherwise((agree - expected) / (1 - expected)).alias("kappa"))


def hash_split(rows: DataFrame, key: str, by: str, share: float, seed: int = SEED) -> DataFrame:
    """``rows`` with ``part``: the first of each stratum in order of a salted digest calibrate, at least one on both sides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    order = Window.partitionBy(by).orderBy(digest)
    n = F.count("*").over(Window.partitionBy(by))
    quota = F.greatest(F.lit(1), F.least(n - 1, F.round(n * share).cast("long")))
    return rows.withColumn("part", F.when(F.row_number().over(order) <= quota, "calibration").otherwise("holdout"))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def temperature(results: DataFrame, grid: int = 160, low: float = 0.05, high: float = 10.0) -> DataFrame:
    """(temperature, nll): the best of a geometric grid by log loss.

    Rows are counted by (confidence, correct) first, so the grid meets distinct values only.
    """
    counts = results.groupBy("confidence", "correct").agg(F.count("*").alias("n"))
    step = math.log(high / low) / (grid - 1)
    temps = results.sparkSession.range(grid).select(F.col("id").alias("i"), F.exp(math.log(low) + F.col("id") * step).alias("temperature"))
    p = sigmoid(logit(F.col("confidence")) / F.col("temperature"))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    loss = -F.when(F.col("correct"), F.log(p)).otherwise(F.log(1 - p)) * F.col("n")
    by = counts.crossJoin(F.broadcast(temps)).groupBy("i", "temperature").agg((F.sum(loss) / F.sum("n")).alias("nll"))  # the grid has a fixed size
    by = by.withColumn("nll", F.round("nll", 9))
    return by.agg(F.min(F.struct("nll", "i", "temperature")).alias("m")).select(F.col("m.temperature").alias("temperature"), F.col("m.nll").alias("nll"))


def platt(results: DataFrame, l2: float = 1e-3, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of correct on the logit of confidence, by Newton steps.

    Each step is one aggregate of five sums over distinct confidences; the driver solves two equations.
    """
    counts = results.groupBy("confidence").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("double")).alias("y")).select(logit(F.col("confidence")).alias("x"), "n", "y")
    counts = counts.persist()
    a, b = 1.0, 0.0
    try:
        for _ in range(rounds):
            p = sigmoid(a * F.col("x") + b)
            w = F.col("n") * p * (1 - p)
            g = F.col("n") * p - F.col("y")
            s = counts.agg(*[F.sum(e) for e in (g * F.col("x"), g, w * F.col("x") * F.col("x"), w * F.col("x"), w, F.col("n"))]).first()
            if not s[5]:
                break
            ga, gb = s[0] / s[5] + l2 * (a - 1), s[1] / s[5] + l2 * b
            haa, hab, hbb = s[2] / s[5] + l2, s[3] / s[5], s[4] / s[5] + l2
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            scale = 1 / max(1.0, abs(da) + abs(db))  # far from the optimum a full step overshoots
            a, b = a - scale * da, b - scale * db
            if abs(da) + abs(db) < 1e-10:
                break
    finally:
        counts.unpersist()
    return a, b


def thresholds(rows: DataFrame, probability: str, label: str) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) at each distinct probability, by running sums."""
    by = rows.groupBy(F.col(probability).alias("threshold")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    all_p = F.sum("p").over(Window.partitionBy())
    out = by.select("threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), all_p.alias("all"))
    out = out.withColumn("fn", F.col("all") - F.col("tp"))
    return out.select("threshold", "tp", "fp", "fn", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("all")).alias("recall"), (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def grouped_platt(results: DataFrame, by: str, least: int = 20) -> dict[str, tuple[float, float]]:
    """Slope and intercept of each group of at least ``least`` rows with both outcomes, and of all under ``*``."""
    out = {"*": platt(results)}
    sizes = results.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("y"))
    for row in sizes.filter((F.col("n") >= least) & (F.col("y") > 0) & (F.col("y") < 1)).collect():  # a row for each group
        out[row[by]] = platt(results.filter(F.col(by) == row[by]))
    return out


def gates(checks: list[tuple[str, bool]], spark) -> DataFrame:
    """(gate, passed, promoted): named gates of a promotion, all of which must hold."""
    rows = spark.createDataFrame(checks, "gate string, passed boolean")
    return rows.withColumn("promoted", F.bool_and("passed").over(Window.partitionBy()))


def quota_split(groups: DataFrame, key: str, by: str, shares: tuple[tuple[str, float], ...] = (("validation", 0.15), ("test", 0.15), ("train", 0.7))) -> DataFrame:
    """``groups`` with ``split``: each stratum's groups in order of their sha1 fill validation, then test, then train."""
    order = Window.partitionBy(by).orderBy(F.sha1(F.col(key).cast("string")))
    share = (F.row_number().over(order) - 1) / F.count("*").over(Window.partitionBy(by))
    out, upto, split = groups.withColumn("__p", share), 0.0, None
    for name, part in shares[:-1]:
        upto += part
        split = F.when(F.col("__p") < upto, name) if split is None else split.when(F.col("__p") < upto, name)
    return out.withColumn("split", split.otherwise(shares[-1][0])).drop("__p")
