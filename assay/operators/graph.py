"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is a grouped minimum and a join on the node; a hub is one row on the other side,
so a skewed join can be split. Rounds are written to the shared folder. Nothing but one
count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, each once."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every node that is not itself the least. ``edges``: (a, b) of longs."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = saved(edges, "edges")
    state = None
    while True:
        edges = saved(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def labelled(parts: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, component): every node with the least node of its component, itself where it has no edge."""
    out = nodes.select(key).join(parts.withColumnRenamed("id", key), key, "left")
    return out.select(key, F.coalesce("component", key).alias("component"))


def traceability(span: F.Column, text: F.Column) -> F.Column:
    """How a quoted span is found: ``exact``, ``segmented`` (its parts between ellipses in order) or ``untraceable``."""
    parts = F.filter(F.transform(F.split(span, r"\.\.\.|…"), lambda t: F.trim(t)), lambda p: p != "")
    # the place after each part, 0 once one is missing
    place = F.aggregate(parts, F.lit(1), lambda at, p: F.when((at > 0) & (F.call_function("locate", p, text, at) > 0), F.call_function("locate", p, text, at) + F.length(p)).otherwise(F.lit(0)))
    return F.when(F.contains(text, span), "exact").when((F.size(parts) > 1) & (place > 0), "segmented").otherwise("untraceable")
