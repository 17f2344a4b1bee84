"""Stored results scored again by the metrics as they are now, with a report of what that changes.

A stored row carries a signature of the question it was scored against; it is scored again only where the question has that signature still. A row with
an error stays as it is, one whose question has changed is stale, one whose question is gone is an orphan. Metrics have a version; a row names the version
of its scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, normal_answer
from .metrics import bag_f1

VERSION = "2"
CORRECT = 0.3
METRICS = ("em", "f1", "correct")
TOLERANCE = 1e-9


def signature(*parts: Column) -> Column:
    """Of what a question is scored by; null and empty parts differ."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.to_json(F.struct(p.alias("v"))), F.lit("")).alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def correct(f1: Column, kind: Column, behaviour: Column) -> Column:
    """Right where the behaviour that is asked for is shown, else from an F1 over CORRECT."""
    asked = ((kind == "unanswerable") & (behaviour == "abstain")) | ((kind == "misleading") & (behaviour == "correct_premise"))
    return F.coalesce(asked, F.lit(False)) | F.coalesce(f1 > CORRECT, F.lit(False))


def scores(rows: DataFrame, key: str) -> DataFrame:
    """(key, em, f1) of ``rows`` (key, predicted, truth)."""
    tokens = rows.select(key, answer_tokens(F.coalesce("predicted", F.lit(""))).alias("a"), answer_tokens(F.coalesce("truth", F.lit(""))).alias("b"))
    em = (normal_answer(F.coalesce("predicted", F.lit(""))) == normal_answer(F.coalesce("truth", F.lit("")))).cast("double")
    return rows.select(key, em.alias("em")).join(bag_f1(tokens, key, "a", "b"), key)


def rescored(stored: DataFrame, questions: DataFrame, version: str = VERSION) -> DataFrame:
    """``stored`` (row_id, question_id, signature, predicted, behaviour, error, version, em, f1, correct) with ``state`` and new scores.

    ``questions`` (question_id, signature, truth, kind). ``state`` is changed, same, error, stale or orphan; ``old`` are the scores as stored, ``version`` that of the
    scores that stand.
    """
    own = questions.select("question_id", F.col("signature").alias("now"), "truth", "kind")
    rows = stored.join(own, "question_id", "left")
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("now").isNull(), "orphan").when(~F.col("now").eqNullSafe(F.col("signature")), "stale")
    rows = rows.withColumn("state", state)
    fresh = scores(rows.filter("state is null").select("row_id", "predicted", "truth"), "row_id").select("row_id", F.col("em").alias("new_em"), F.col("f1").alias("new_f1"))
    rows = rows.join(fresh, "row_id", "left").withColumn("new_correct", F.when(F.col("state").isNull(), correct(F.col("new_f1"), F.col("kind"), F.col("behaviour"))))
    differs = lambda c: ~(F.col(c).eqNullSafe(F.col(f"new_{c}"))) if c == "correct" else ~F.coalesce(F.abs(F.col(c) - F.col(f"new_{c}")) <= TOLERANCE, F.col(c).isNull() & F.col(f"new_{c}").isNull())
    moved = differs("em") | differs("f1") | differs("correct")
    rows = rows.withColumn("old", F.struct(*METRICS)).withColumn("scored", F.col("state").isNull())
    rows = rows.withColumn("state", F.coalesce("state", F.when(moved, "changed").otherwise("same")))
    stands = {c: F.when(F.col("scored"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in METRICS}
    rows = rows.withColumns({**stands, "version": F.when(F.col("scored"), F.lit(version)).otherwise(F.col("version"))})
    return rows.select("row_id", "question_id", "signature", "predicted", "behaviour", "error", "version", *METRICS, "old", "state")


def changes(rescored_rows: DataFrame, *by: str) -> DataFrame:
    """Rows by state (and ``by``): how many, their mean scores before and after, and how many became right or wrong."""
    was, now = F.col("old.correct"), F.col("correct")
    return rescored_rows.groupBy("state", "version", *by).agg(
        F.count("*").alias("n"), F.round(F.avg("old.f1"), 6).alias("old_f1"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("old.em"), 6).alias("old_em"), F.round(F.avg("em"), 6).alias("em"),
        F.count_if(now & ~was).alias("righted"), F.count_if(was & ~now).alias("wronged"),
    )
