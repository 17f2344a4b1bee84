"""Task analysis, uncertainty, decisions, verification roll-up and confidence, as expressions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations

from .evidence import clamp

# Weights of the five uncertainties, in the order of PARTS.
PARTS = ("retrieval", "evidence", "conflict", "reasoning", "knowledge")
WEIGHTS = (0.25, 0.30, 0.20, 0.15, 0.10)

# Words that mark a kind of question.
MARKS = {
    "comparison": r"(?i)\b(compare|versus|vs|difference|better|worse|than)\b",
    "temporal": r"(?i)\b(when|before|after|since|until|year|latest|recent)\b",
    "causal": r"(?i)\b(why|because|cause|reason|lead to)\b",
    "multi_hop": r"(?i)\b(and then|who also|which of|both)\b",
    "verification": r"(?i)\b(true|false|verify|correct|really)\b",
}


def analysis(question: Column) -> dict[str, Column]:
    """Flags of a question, its complexity and the hops it takes."""
    flags = {k: question.rlike(v) for k, v in MARKS.items()}
    count = sum((f.cast("int") for f in flags.values()), F.lit(0)) + (F.length(question) > 200).cast("int")
    complexity = F.when(count == 0, "low").when(count <= 2, "medium").otherwise("high")
    hops = F.when(complexity == "low", 1).when(complexity == "medium", 2).otherwise(4)
    return {**flags, "complexity": complexity, "hops": hops}


def overall(*parts: Column) -> Column:
    return sum((w * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0))


def at_answer(uncertainty: Column, confidence: Column) -> Column:
    """A fifth more where an answer is sure of what is uncertain."""
    return clamp(uncertainty + F.when((confidence > 0.8) & (uncertainty > 0.5), 0.2).otherwise(0.0))


def action(total: Column, conflict: Column, retrieval: Column, rounds: Column, most: int = 3) -> Column:
    """The first that applies: abstain, stop, resolve, retrieve, refine, proceed."""
    return (
        F.when(total > 0.7, "abstain")
        .when(rounds >= most, "proceed")
        .when(conflict > 0.6, "resolve_conflict")
        .when(retrieval > 0.6, "retrieve_more")
        .when(total > 0.3, "refine")
        .otherwise("proceed")
    )


def needs_repair(status: Column, ignored: Column, uncertainty: Column) -> Column:
    return (status == "refuted") | (ignored > 0) | (uncertainty > 0.6)


def calibrated(raw: Column, penalty: Column, severe: Column) -> Column:
    """raw less up to 35% for the penalty, less the severe deduction."""
    return clamp(raw * (1 - 0.35 * clamp(penalty)) - severe)


def verdicts(claims: DataFrame, by: str) -> DataFrame:
    """(by, status, supported, refuted, open): any refuted, else all supported, else not enough."""
    refuted, supported = F.count_if(F.col("status") == "refuted"), F.count_if(F.col("status") == "supported")
    status = F.when(refuted > 0, "refuted").when(supported == F.count("*"), "supported").otherwise("not_enough_info")
    return claims.groupBy(by).agg(status.alias("status"), supported.alias("supported"), refuted.alias("refuted"), (F.count("*") - supported - refuted).alias("open"))


def ignored(conflicts: DataFrame, cited: DataFrame) -> DataFrame:
    """Conflicts (a, b) neither end of which any claim cites (id)."""
    some = cited.select("id").distinct()
    return conflicts.join(some.withColumnRenamed("id", "a"), "a", "left_anti").join(some.withColumnRenamed("id", "b"), "b", "left_anti")


def repaired(confidence: Column, status: Column) -> Column:
    return confidence * F.when(status == "refuted", 0.3).when(status == "not_enough_info", 0.6).otherwise(1.0)


def fused(parts: list[Column]) -> Column:
    """Final confidence of five signals."""
    return clamp(sum((w * p for w, p in zip((0.34, 0.24, 0.18, 0.14, 0.10), parts, strict=True)), F.lit(0.0)))


# Words by which an answer owns up to a conflict, and what is put before one that does not, and after one without its citations.
ACKNOWLEDGED = ("冲突", "矛盾", "不一致", "争议", "错误", "不准确", "不实")
CONFLICT_NOTE = ("证据存在冲突：", " 提到“", "”，而 ", " 提到“", "”。综合判断，")
FOOTER = "引用证据："


def acknowledged(answer: Column, source: Column, source_claim: Column, target: Column, target_claim: Column) -> Column:
    """``answer`` after a note of the first conflict in its evidence, unless there is none (null) or it speaks of one."""
    spoken = F.exists(F.array(*map(F.lit, ACKNOWLEDGED)), lambda w: F.contains(answer, w))
    lead, told, but, again, end = map(F.lit, CONFLICT_NOTE)
    note = F.concat(lead, source, told, F.substring(source_claim, 1, 80), but, target, again, F.substring(target_claim, 1, 80), end)
    return F.when(source.isNull() | spoken, answer).otherwise(F.concat(note, answer))


def cited_ids(answer: Column) -> Column:
    """Distinct bracketed ids in the order of their first mention."""
    return F.array_distinct(citations(answer))


def with_citations(answer: Column, supports: Column, available: Column) -> Column:
    """``answer`` with a footer of the available ids that its claims rest on and it does not cite."""
    missing = F.array_except(F.filter(F.array_distinct(supports), lambda e: F.array_contains(available, e)), cited_ids(answer))
    footer = F.concat(F.lit(FOOTER), F.array_join(F.transform(missing, lambda e: F.concat(F.lit("["), e, F.lit("]"))), " "))
    return F.when((answer == "") | (F.size(missing) == 0), answer).otherwise(F.concat(F.rtrim(answer), F.lit("\n"), footer))


def synced(answer: Column, supports: Column, available: Column) -> Column:
    """Citations and support of an answer after they are brought together: struct(support, dropped, added_support, added_citations).

    Support outside the evidence is dropped, valid citations that no claim rests on become support, support that is not cited is to be cited.
    """
    cited = cited_ids(answer)
    valid = F.filter(cited, lambda e: F.array_contains(available, e))
    kept = F.filter(F.array_distinct(supports), lambda e: F.array_contains(available, e))
    support = F.array_union(kept, valid)
    return F.struct(
        support.alias("support"),
        F.filter(supports, lambda e: ~F.array_contains(available, e)).alias("dropped"),
        F.array_except(valid, kept).alias("added_support"),
        F.array_except(support, cited).alias("added_citations"),
    )
