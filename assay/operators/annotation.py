"""Rounds of annotation as tables: blinded packets, what breaks the protocol, agreement, and where each item stands.

Labels are (item_id, annotator_id, present, kind, pair, rationale), ``present`` whether there is a conflict. An item is open until LEAST annotators have labelled
it; then agreed or disputed; adjudicated once an adjudicator has. Only labels that break no rule count.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, LEAST_KAPPA = 2, 0.6
# The kinds of conflict.
KINDS = ("numeric_conflict", "temporal_conflict", "entity_mismatch", "scope_conflict", "causal_conflict", "definitional_conflict")
NONE = "none"


def packets(items: DataFrame, annotators: list[str], seed: str, show: tuple[str, ...]) -> DataFrame:
    """(annotator_id, place_key, item_id, *show): every item for each annotator, only with what may be seen, in an order of each one's own.

    Sorting a packet by ``place_key``, a keyed hash, shuffles it: no task holds a packet.
    """
    if not annotators or len(set(annotators)) != len(annotators) or not all(a and a.replace("_", "").replace("-", "").isalnum() for a in annotators):
        raise ValueError("annotators have ids of their own, of letters, digits, - and _")
    each = items.select("item_id", *show, F.explode(F.array(*map(F.lit, annotators))).alias("annotator_id"))
    return each.select("annotator_id", F.sha2(F.concat_ws(":", F.lit(seed), "annotator_id", "item_id"), 256).alias("place_key"), "item_id", *show)


def _broken(evidence: Column) -> Column:
    """Names of the rules that a label breaks."""
    pair = F.coalesce("pair", F.array().cast("array<string>"))
    present, kind = F.col("present"), F.coalesce("kind", F.lit(""))
    rules = {
        "unknown_item": evidence.isNull(),
        "no_annotator": F.coalesce(F.trim("annotator_id"), F.lit("")) == "",
        "no_label": present.isNull(),
        "kind_of_conflict": present & ~kind.isin(*KINDS),
        "pair_of_two": present & ((F.size(pair) != 2) | (F.size(F.array_distinct(pair)) != 2)),
        "pair_of_known": present & evidence.isNotNull() & (F.size(F.array_except(pair, F.coalesce(evidence, F.array().cast("array<string>")))) > 0),
        "kind_without_conflict": ~present & ~kind.isin(NONE, ""),
        "pair_without_conflict": ~present & (F.size(pair) > 0),
    }
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]), lambda r: r.isNotNull())


def judged(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """``labels`` with ``broken``: the rules that they break. ``evidence`` (item_id, ids) are the items and their evidence; a second label by one annotator is ``doubled``."""
    twice = labels.groupBy("item_id", "annotator_id").count().filter("count > 1").select("item_id", "annotator_id", F.lit(True).alias("twice"))
    rows = labels.join(evidence.select("item_id", "ids"), "item_id", "left").withColumn("broken", _broken(F.col("ids")))
    rows = rows.join(twice, ["item_id", "annotator_id"], "left")
    return rows.withColumn("broken", F.when(F.col("twice"), F.concat("broken", F.array(F.lit("doubled")))).otherwise(F.col("broken"))).drop("ids", "twice")


def answer() -> Column:
    """What a label says, as one text: its kind of conflict or none."""
    return F.when(F.col("present"), F.col("kind")).otherwise(NONE)


def states(labels: DataFrame, adjudications: DataFrame, evidence: DataFrame, least: int = LEAST) -> DataFrame:
    """(item_id, labels, state, final) of every item: open, agreed, disputed or adjudicated, and the answer that stands, null while there is none."""
    good = judged(labels, evidence).filter(F.size("broken") == 0).withColumn("answer", answer())
    tally = good.groupBy("item_id").agg(F.count("*").alias("labels"), F.min("answer").alias("low"), F.max("answer").alias("high"))
    ruled = judged(adjudications, evidence).filter(F.size("broken") == 0).select("item_id", answer().alias("ruling"))
    rows = evidence.select("item_id").join(tally, "item_id", "left").join(ruled, "item_id", "left")
    enough, same = F.coalesce(F.col("labels") >= least, F.lit(False)), F.col("low") == F.col("high")
    state = F.when(F.col("ruling").isNotNull() & enough, "adjudicated").when(~enough, "open").when(same, "agreed").otherwise("disputed")
    final = F.when(state == "adjudicated", F.col("ruling")).when(state == "agreed", F.col("low"))
    return rows.select("item_id", F.coalesce("labels", F.lit(0)).alias("labels"), state.alias("state"), final.alias("final"))


def agreement(labels: DataFrame, annotators: list[str], of: str = "answer") -> DataFrame:
    """(a, b, items, observed, expected, kappa) of each two annotators, over the items that both labelled; from counts of answers, not from pairs of rows."""
    own = labels.filter(F.col("annotator_id").isin(*annotators)).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("annotator_id", F.col(of)))).alias("said"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("said")[a].alias("x"), F.col("said")[b].alias("y")) for a, b in combinations(sorted(annotators), 2)])
    cells = own.select(F.inline(pairs)).filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    total = cells.groupBy("a", "b").agg(F.sum("n").alias("items"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("a", "b", F.col("x").alias("v")).agg(F.sum("n").alias("p"))
    right = cells.groupBy("a", "b", F.col("y").alias("v")).agg(F.sum("n").alias("q"))
    chance = left.join(right, ["a", "b", "v"]).groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("by_chance"))
    rows = total.join(chance, ["a", "b"], "left")
    observed = F.col("same") / F.col("items")
    expected = F.coalesce("by_chance", F.lit(0)) / (F.col("items") * F.col("items"))
    kappa = F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected))
    return rows.select("a", "b", "items", observed.alias("observed"), expected.alias("expected"), kappa.alias("kappa"))
