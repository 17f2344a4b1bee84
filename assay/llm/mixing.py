"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is dealt up to three times in a shuffled order. A deal's virtual
finish time is the source's tokens dealt so far divided by the source's target. Deals are
taken in order of that time until the total budget is spent.

No source passes through one task: the shuffled order is cut into slots, running sums are
taken inside a slot and slots are offset by the sums of those before. The cut at the total
budget is found by histograms of finish times, each over the cell that holds it, until few
enough rows are left to sort.

Sizes are words; a null text has size 0 and is taken 0 words. Repeated rows count each.
Where two rows tie in the shuffled order they are alike, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
ROWS_A_SLOT = 4_000
CELLS = 4_096


def size_of(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_TIMES) -> dict[str | None, float]:
    """Shares of the whole by weight, none above ``most`` times its source's size; one entry per source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _cut(deals: DataFrame, budget: float):
    """The last deal, in order of finish time, that the budget pays; None if it pays all."""
    spent, low, high = 0, 0.0, None
    while True:
        rows = deals if high is None else deals.filter((F.col("finish") >= low) & (F.col("finish") <= high))
        top = rows.agg(F.max("finish").alias("m")).first()["m"]
        if top is None:
            return None
        cell = F.floor((F.col("finish") - low) / (max(top - low, 1e-12) / CELLS)).alias("cell")
        cells = rows.groupBy(cell).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).collect()
        edge = None
        for c in sorted(cells, key=lambda c: c["cell"]):
            if spent + c["size"] > budget:
                edge = c
                break
            spent += c["size"]
        if edge is None:
            return None
        low, high = edge["low"], edge["high"]
        if edge["n"] <= ROWS_A_SLOT or low == high:
            break
    order = Window.orderBy("finish", "sid", "doc_id", "turn").rowsBetween(Window.unboundedPreceding, 0)
    one = deals.filter((F.col("finish") >= low) & (F.col("finish") <= high)).withColumn("run", F.sum("size").over(order))
    # the first deal beyond the budget is taken too: a mix ends with a whole document
    return one.filter(F.col("run") - F.col("size") <= budget - spent).agg(F.max(F.struct("finish", "sid", "doc_id", "turn")).alias("m")).first()["m"]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, times, taken (and ``keep``)."""
    spark = docs.sparkSession
    sized = saved(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size"), *[F.col(c).alias(f"kept_{c}") for c in keep])
        .withColumn("h", F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", F.lit("mix"))), 1, 15), 16, 10).cast("long")),
        "sizes",
    )
    # one row per source: names of sources and their sizes are what the driver sees
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"]))
    target = targets({r["source"]: r["source_size"] for r in totals}, weights)
    plan = spark.createDataFrame(
        [(i, r["source"], r["source_size"], target[r["source"]], max(1, -(-r["n"] // ROWS_A_SLOT))) for i, r in enumerate(totals)],
        "sid int, source string, source_size long, target double, slots int",
    )
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = rows.withColumn("slot", F.floor(F.col("h") / F.lit(float(1 << 60)) * F.col("slots")).cast("int"))
    slots = rows.groupBy("sid", "slot").agg(F.sum("size").alias("in_slot"))
    before = slots.select("sid", "slot", (F.sum("in_slot").over(Window.partitionBy("sid").orderBy("slot")) - F.col("in_slot")).alias("before"))
    inside = Window.partitionBy("sid", "slot").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.withColumn("run", F.sum("size").over(inside)).join(before, ["sid", "slot"])
    ends = dealt.withColumn("end", F.col("before") + F.col("run")).drop("slot", "slots", "before", "run", "h")
    ends = saved(ends, "ends")

    deals = ends.filter("size > 0 and target > 0").select(
        "size", "sid", "doc_id", "end", F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))).alias("turn"), "source_size", "target"
    ).withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("end")) / F.col("target"))
    last = _cut(deals, float(sum(target.values())))
    if last is None:
        within = lambda finish, turn: F.lit(True)
    else:
        bound = F.struct(F.lit(last["finish"]), F.lit(last["sid"]), F.lit(last["doc_id"]).cast(dict(ends.dtypes)["doc_id"]), F.lit(last["turn"]))
        within = lambda finish, turn: F.struct(finish, "sid", "doc_id", turn) <= bound
    times = F.lit(0)
    for turn in range(MOST_TIMES):
        finish = (turn * F.col("source_size") + F.col("end")) / F.col("target")
        times = times + F.when((F.col("size") > 0) & (F.col("target") > 0) & within(finish, F.lit(turn)), 1).otherwise(0)
    out = ends.withColumn("times", times.cast("int")).withColumn("taken", (F.col("times") * F.col("size")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", "taken", *[F.col(f"kept_{c}").alias(c) for c in keep])


#: Source order is that of code points. A target is a share of what is left when the sources with the least room for their weight are full.
OP5_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':mix'), 1, 15))::BIGINT AS h FROM docs),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM hashed GROUP BY 1),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sources),
ranked AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, sid) AS k, (sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, sid) - 3 * source_size)::DOUBLE AS full_before,
  sum(w) OVER (ORDER BY 3 * source_size / w DESC, sid DESC) AS w_left, (sum(source_size) OVER ())::DOUBLE AS total FROM weighed),
level AS (SELECT min(k) AS k FROM ranked WHERE (total - full_before) * w / w_left <= 3 * source_size),
cut AS (SELECT total - full_before AS left_, w_left FROM ranked JOIN level USING (k)),
targets AS (SELECT source, sid, source_size, CASE WHEN k < (SELECT k FROM level) THEN (3 * source_size)::DOUBLE ELSE (SELECT left_ FROM cut) * w / (SELECT w_left FROM cut) END AS target FROM ranked),
ends AS (SELECT h.doc_id, h.size, t.sid, t.source_size, t.target, row_number() OVER () AS rid, sum(h.size) OVER (PARTITION BY t.sid ORDER BY h.h, h.doc_id NULLS FIRST, h.size ROWS UNBOUNDED PRECEDING) AS end_
  FROM hashed h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source),
deals AS (SELECT *, (turn * source_size + end_)::DOUBLE / target AS finish FROM ends, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0),
spent AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, sid, doc_id NULLS FIRST, turn ROWS UNBOUNDED PRECEDING) AS run FROM deals),
taken AS (SELECT rid, count(*) AS times FROM spent WHERE run - size <= (SELECT sum(target) FROM targets) GROUP BY 1)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (coalesce(times, 0) * size)::BIGINT AS taken, coalesce(times, 0)::INT AS times FROM ends LEFT JOIN taken USING (rid)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")
