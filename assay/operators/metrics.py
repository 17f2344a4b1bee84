"""Evaluation metrics as aggregations. Conventions for empty sides are stated at each one.

Per-row metrics are Column functions; corpus metrics take a DataFrame of results with
``confidence`` (0 to 1) and ``correct`` (boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunking import document_of

BINS = 10


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def micro_f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def bag_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays, inside the row."""
    count = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def bag_f1(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, f1) of two token arrays as multisets, for texts of any length: both empty 1, one empty 0.

    Tokens are counted by key and token, so a long text is spread over tasks.
    """
    sides = rows.select(key, F.explode(F.col(a)).alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(
        rows.select(key, F.explode(F.col(b)).alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    )
    counts = sides.groupBy(key, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = counts.groupBy(key).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.least("x", "y")).alias("c"))
    got = rows.select(key).join(sums, key, "left")
    score = F.when(F.col("x").isNull(), 1.0).when((F.col("x") == 0) | (F.col("y") == 0) | (F.col("c") == 0), 0.0).otherwise(2.0 * F.col("c") / (F.col("x") + F.col("y")))
    return got.select(key, score.alias("f1"))


def set_scores(retrieved: Column, relevant: Column) -> tuple[Column, Column, Column]:
    """Precision (0 if none retrieved), recall (1 if none relevant), F1 of two arrays as sets."""
    hits = F.size(F.array_intersect(retrieved, relevant)).cast("double")
    p = ratio(hits, F.size(F.array_distinct(retrieved)))
    r = ratio(hits, F.size(F.array_distinct(relevant)), 1.0)
    return p, r, f1(p, r)


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Equal bins, the last one closed."""
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("long")


def reliability(results: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, n, confidence, accuracy) of all bins, those without a row too."""
    got = results.groupBy(bin_of(F.col("confidence"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )
    every = results.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def ece(results: DataFrame, bins: int = BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error, by group where asked."""
    cell = results.groupBy(*by, bin_of(F.col("confidence"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(F.col("correct").cast("double")).alias("y")
    )
    return cell.groupBy(*by).agg((F.sum(F.abs(F.col("c") - F.col("y"))) / F.sum("n")).alias("ece"))


def brier() -> Column:
    d = F.col("confidence") - F.col("correct").cast("double")
    return F.avg(d * d)


def abstention_auroc(results: DataFrame, thresholds: int = 100) -> DataFrame:
    """Area under (abstains on correct, abstains on wrong) over evenly spaced thresholds, strictly below, by trapezoids.

    Rows are counted by the first threshold above them; running sums over the thresholds do the rest.
    """
    step = thresholds - 1
    first = F.least(F.floor(F.col("confidence") * step) + 1, F.lit(thresholds)).cast("long")  # c < i / step
    counts = results.groupBy(first.alias("i")).agg(F.count_if(~F.col("correct")).alias("wrong"), F.count_if(F.col("correct")).alias("right"))
    grid = results.sparkSession.range(thresholds + 1).withColumnRenamed("id", "i").join(counts, "i", "left").fillna(0)
    up = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as thresholds
    total = Window.partitionBy()
    curve = grid.select(
        "i",
        ratio(F.sum("wrong").over(up), F.sum("wrong").over(total)).alias("tpr"),
        ratio(F.sum("right").over(up), F.sum("right").over(total)).alias("fpr"),
    ).filter(F.col("i") < thresholds)
    before = Window.orderBy("i")
    area = (F.col("fpr") - F.lag("fpr").over(before)) * (F.col("tpr") + F.lag("tpr").over(before)) / 2
    return curve.withColumn("area", area).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("auroc"))


def pair_auroc(results: DataFrame) -> DataFrame:
    """Probability that a right answer is more confident than a wrong one, ties half; null without both.

    Counts by distinct confidence and running sums, not pairs.
    """
    by = results.groupBy("confidence").agg(F.count_if("correct").alias("p"), F.count_if(~F.col("correct")).alias("n"))
    below = Window.orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)
    wins = by.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return wins.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


def risk_coverage(results: DataFrame, key: str, cells: int = 1000) -> DataFrame:
    """(key, k, coverage, risk): error rate of the k most confident rows, ties by key.

    Running sums are taken within cells of confidence and offset by those of the cells above.
    """
    rows = results.select(key, "confidence", (~F.col("correct")).cast("double").alias("wrong"), bin_of(F.col("confidence"), cells).alias("cell"))
    per = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("wrong").alias("w"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    start = per.select("cell", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(above), F.lit(0.0)).alias("w0"), F.sum("n").over(Window.partitionBy()).alias("all"))
    order = Window.partitionBy("cell").orderBy(F.desc("confidence"), key)
    ranked = rows.withColumns({"i": F.row_number().over(order), "run": F.sum("wrong").over(order.rowsBetween(Window.unboundedPreceding, 0))}).join(start, "cell")
    k = (F.col("n0") + F.col("i")).cast("long")
    return ranked.select(key, k.alias("k"), (k / F.col("all")).alias("coverage"), ((F.col("w0") + F.col("run")) / k).alias("risk"))


def pairs_of(a: str, b: str) -> list[Column]:
    """An undirected pair in canonical order."""
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def pair_counts(predicted: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """(by, tp, fp, fn) of undirected pairs (by, a, b)."""
    p = predicted.select(by, *pairs_of("a", "b")).distinct().withColumn("in_p", F.lit(1))
    g = gold.select(by, *pairs_of("a", "b")).distinct().withColumn("in_g", F.lit(1))
    both = p.join(g, [by, "lo", "hi"], "full")
    return both.groupBy(by).agg(
        F.count_if(F.col("in_p").isNotNull() & F.col("in_g").isNotNull()).alias("tp"),
        F.count_if(F.col("in_g").isNull()).alias("fp"),
        F.count_if(F.col("in_p").isNull()).alias("fn"),
    )


def soft_tokens(text: Column) -> Column:
    """Numbers, Latin words and bigrams of Han runs of a normalised answer."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(r"[0-9]+(?:\.[0-9]+)?%?|[a-z]+(?:-[a-z]+)*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.regexp_extract_all(r, F.lit("(?=(..))"), F.lit(1)))))
    return F.concat(latin, pairs)


def row_bag_f1(a: Column, b: Column) -> Column:
    """Multiset F1 of two short arrays inside the row: both empty 1, one empty 0."""
    common, n, m = bag_common(a, b), F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2.0 * common / (n + m))


def soft_f1(predicted: Column, reference: Column) -> Column:
    """1 if the reference is contained once both are stripped to letters and digits, else the F1 of soft tokens."""
    strip = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    p, r = strip(predicted), strip(reference)
    return F.when((p == "") & (r == ""), 1.0).when((p == "") | (r == ""), 0.0).when(F.contains(p, r), 1.0).otherwise(row_bag_f1(soft_tokens(predicted), soft_tokens(reference)))


def citation_scores(cited: Column, required: Column) -> tuple[Column, Column, Column]:
    """Precision over all citations made, recall over the distinct required ones (1 if none), F1."""
    good = F.size(F.filter(cited, lambda c: F.array_contains(required, c))).cast("double")
    p = ratio(good, F.size(cited))
    r = ratio(F.size(F.array_intersect(cited, required)).cast("double"), F.size(F.array_distinct(required)), 1.0)
    return p, r, f1(p, r)


def ranking_scores(hits: DataFrame, gold: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, rr, ndcg, retrieved, relevant, found) for every query of ``hits`` or ``gold``.

    The ideal gain counts as many documents as are relevant and retrieved at most; nDCG is 1 without a relevant one.
    """
    marked = hits.join(gold.select(query, doc).distinct().withColumn("good", F.lit(1)), [query, doc], "left")
    by = marked.groupBy(query).agg(
        F.coalesce(1.0 / F.min(F.when(F.col("good") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(F.col("good") == 1, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.count("*").alias("retrieved"),
        F.count("good").alias("found"),
    )
    both = by.join(gold.groupBy(query).agg(F.countDistinct(doc).alias("relevant")), query, "full").fillna(0)
    places = F.when(F.least("relevant", "retrieved") > 0, F.sequence(F.lit(1), F.least("relevant", "retrieved").cast("int"))).otherwise(F.array().cast("array<int>"))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    ndcg = F.when(F.col("relevant") == 0, 1.0).when(ideal == 0, 0.0).otherwise(F.col("dcg") / ideal)
    return both.select(query, "rr", ndcg.alias("ndcg"), "retrieved", "relevant", "found")


def type_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold pairs (a, b, kind) whose prediction (a, b, kind, seq) names the kind; the last one of a pair counts; 1 without gold."""
    last = predicted.select(*pairs_of("a", "b"), "kind", "seq").groupBy("lo", "hi").agg(F.max_by("kind", "seq").alias("said"))
    both = gold.select(*pairs_of("a", "b"), "kind").join(last, ["lo", "hi"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce(F.col("said") == F.col("kind"), F.lit(False)).cast("double")), F.lit(1.0)).alias("accuracy"))


def false_rate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of predicted pairs that no gold pair matches; 0 without a prediction."""
    p, g = predicted.select(*pairs_of("a", "b")).distinct(), gold.select(*pairs_of("a", "b")).distinct().withColumn("real", F.lit(1))
    return p.join(g, ["lo", "hi"], "left").agg(F.coalesce(F.avg(F.col("real").isNull().cast("double")), F.lit(0.0)).alias("rate"))


def unsupported_rate(claims: DataFrame, support: DataFrame, key: str) -> DataFrame:
    """Share of claims without any support; 0 without a claim."""
    marked = claims.select(key).join(support.select(key).distinct().withColumn("backed", F.lit(1)), key, "left")
    return marked.agg(F.coalesce(F.avg(F.col("backed").isNull().cast("double")), F.lit(0.0)).alias("rate"))


def joint_em(answer_right: Column, facts_right: Column) -> Column:
    """1 where the answer and the supporting facts are both exactly right."""
    return F.when(answer_right & facts_right, 1.0).otherwise(0.0)


def resolution_accuracy(decided: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold resolutions (pair, resolution) that the first decision (pair, resolution, seq) on the pair agrees with; 1 without gold."""
    first = decided.groupBy("pair").agg(F.min_by("resolution", "seq").alias("said"))
    both = gold.join(first, "pair", "left")
    return both.agg(F.coalesce(F.avg(F.coalesce(F.col("said") == F.col("resolution"), F.lit(False)).cast("double")), F.lit(1.0)).alias("accuracy"))


def mapped_pairs(predicted: DataFrame, evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, lo, hi) of ``predicted`` pairs of chunks (query_id, a, b) in the gold evidence ids of their question.

    ``evidence`` (query_id, doc_id, evidence_id, seq): a document may give several spans. A pair of chunks takes the first pair of
    ids of its documents that is a ``gold`` pair (query_id, a, b); without one, the last id of each document, or the chunk's own.
    """
    ids = evidence.groupBy("query_id", "doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "evidence_id"))), lambda e: e["evidence_id"]).alias("ids"))
    known = gold.groupBy("query_id").agg(F.collect_set(F.struct(*pairs_of("a", "b"))).alias("gold"))
    rows = predicted
    for side in ("a", "b"):
        own = ids.select("query_id", F.col("doc_id").alias(f"{side}_doc"), F.col("ids").alias(f"{side}_ids"))
        rows = rows.withColumn(f"{side}_doc", document_of(F.col(side))).join(own, ["query_id", f"{side}_doc"], "left")
        rows = rows.withColumn(f"{side}_ids", F.coalesce(f"{side}_ids", F.array(side)))
    pair = lambda x, y: F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    every = F.flatten(F.transform("a_ids", lambda x: F.transform("b_ids", lambda y: pair(x, y))))
    rows = rows.join(known, "query_id", "left")
    best = F.get(F.filter(every, lambda e: F.array_contains("gold", e)), F.lit(0))
    last = pair(F.element_at("a_ids", -1), F.element_at("b_ids", -1))
    return rows.select("query_id", F.coalesce(best, last).alias("p")).select("query_id", "p.lo", "p.hi").distinct()


def restricted_counts(mapped: DataFrame, evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, tp, fp, fn, extraneous): mapped pairs (query_id, lo, hi) against gold pairs (query_id, a, b), with pairs that leave the
    question's gold evidence, and self pairs that are not gold, set aside."""
    inside = evidence.select("query_id", F.col("evidence_id")).distinct()
    g = gold.select("query_id", *pairs_of("a", "b")).distinct().withColumn("in_g", F.lit(1))
    p = mapped.join(inside.select("query_id", F.col("evidence_id").alias("lo"), F.lit(1).alias("lo_in")), ["query_id", "lo"], "left")
    p = p.join(inside.select("query_id", F.col("evidence_id").alias("hi"), F.lit(1).alias("hi_in")), ["query_id", "hi"], "left")
    both = p.withColumn("in_p", F.lit(1)).join(g, ["query_id", "lo", "hi"], "full")
    scored = F.col("lo_in").isNotNull() & F.col("hi_in").isNotNull() & ((F.col("lo") != F.col("hi")) | F.col("in_g").isNotNull())
    said, real = F.col("in_p").isNotNull(), F.col("in_g").isNotNull()
    return both.groupBy("query_id").agg(
        F.count_if(said & scored & real).alias("tp"),
        F.count_if(said & scored & ~real).alias("fp"),
        F.count_if(real & ~(said & scored)).alias("fn"),
        F.count_if(said & ~scored).alias("extraneous"),
    )


def retrieval_report(hits: DataFrame, gold: DataFrame, slices: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Macro and micro precision, recall and F1, mean reciprocal rank and nDCG over all queries and over each value of each slice.

    ``slices``: (query_id, *names). A row has the value of one name, or of none for all queries.
    """
    per = ranking_scores(hits, gold).join(slices, "query_id")
    p, r = ratio(F.col("found").cast("double"), F.col("retrieved")), ratio(F.col("found").cast("double"), F.col("relevant"), 1.0)
    per = per.withColumns({"p": p, "r": r, "f": f1(p, r)})
    sums = per.groupingSets([(n,) for n in names] + [()], *names).agg(
        F.count("*").alias("queries"),
        *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("p", "r", "f")],
        F.round(F.avg("rr"), 6).alias("mrr"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"),
        *[F.sum(c).alias(c) for c in ("found", "retrieved", "relevant")],
    )
    micro_p, micro_r = ratio(F.col("found").cast("double"), F.col("retrieved")), ratio(F.col("found").cast("double"), F.col("relevant"), 1.0)
    return sums.withColumns({"micro_p": F.round(micro_p, 6), "micro_r": F.round(micro_r, 6), "micro_f": F.round(f1(micro_p, micro_r), 6)}).drop("found", "retrieved", "relevant")
