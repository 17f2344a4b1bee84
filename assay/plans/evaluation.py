"""Evaluation queries.

``results`` are labelled documents: confidence is the share of letters in the text, correct is
quality 1, type is the language, difficulty a class of length, cluster the source. ``answers``
are user turns of conversations with the assistant's next turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import answer_tokens, normal_answer, numbers
from ..operators import metrics as m


def results(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("lang").alias("type"),
        F.when(F.col("n_chars") < 1500, "easy").when(F.col("n_chars") < 4000, "medium").otherwise("hard").alias("difficulty"),
        F.col("source").alias("cluster"),
        F.round(F.when(F.length("text") == 0, 0.0).otherwise(letters / F.length("text")), 4).alias("confidence"),
        (F.col("quality") == 1).alias("correct"),
        (F.col("toxic") == 1).alias("toxic"),
        "n_chars",
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    order = Window.partitionBy("conv_id").orderBy("turn")
    nexts = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"))
    return nexts.filter("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), F.col("text").alias("question"), "answer")


def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    hit = normal_answer(F.col("question")) == normal_answer(F.col("answer"))
    return answers(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("em"))


def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers(spark, sf).select("qa_id", answer_tokens(F.col("question")).alias("a"), answer_tokens(F.col("answer")).alias("b"))
    return m.bag_f1(rows, "qa_id", "a", "b").select("qa_id", F.round("f1", 6).alias("f1"))


def set_f1(spark: SparkSession, sf: str) -> DataFrame:
    """The baselines' scorer: sets of white-space tokens, 0 if either side is empty."""
    side = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))
    rows = answers(spark, sf).select("qa_id", side(F.col("question")).alias("a"), side(F.col("answer")).alias("b"))
    hits = F.size(F.array_intersect("a", "b")).cast("double")
    return rows.select("qa_id", F.round(m.f1(m.ratio(hits, F.size("a")), m.ratio(hits, F.size("b"))), 6).alias("f1"))


def entity_hallucination(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an answer's capitalised words that its question does not have."""
    caps = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]+"), F.lit(0)))
    rows = answers(spark, sf).select("qa_id", caps(F.col("question")).alias("a"), caps(F.col("answer")).alias("b"))
    return rows.select("qa_id", F.round(m.ratio(F.size(F.array_except("b", "a")).cast("double"), F.size("b")), 6).alias("rate"))


def numeric_hallucination(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an answer's numbers without one within 1% in its question."""
    values = lambda c: F.transform(numbers(c), lambda n: n.cast("double"))
    rows = answers(spark, sf).select("qa_id", values(F.col("question")).alias("a"), values(F.col("answer")).alias("b"))
    lone = F.filter("b", lambda x: ~F.exists("a", lambda y: F.abs(x - y) <= 0.01 * F.greatest(F.abs(y), F.lit(1e-9))))
    return rows.select("qa_id", F.size("b").cast("long").alias("n"), F.round(m.ratio(F.size(lone).cast("double"), F.size("b")), 6).alias("rate"))


def ece(spark: SparkSession, sf: str) -> DataFrame:
    return m.ece(results(spark, sf)).select(F.round("ece", 6).alias("ece"))


def brier(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).agg(F.round(m.brier(), 6).alias("brier"))


def abstention(spark: SparkSession, sf: str) -> DataFrame:
    return m.abstention_auroc(results(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


def risk_points(spark: SparkSession, sf: str) -> DataFrame:
    """Risk at twenty truncated shares of coverage."""
    curve = m.risk_coverage(results(spark, sf), "doc_id")
    n = curve.agg(F.max("k").alias("n"))
    points = spark.range(1, 21).select(F.col("id").alias("point")).crossJoin(n).select("point", F.floor(F.col("point") * F.col("n") / 20).alias("k"))
    return points.join(curve, "k").select("point", "k", F.round("risk", 6).alias("risk"))


def reliability(spark: SparkSession, sf: str) -> DataFrame:
    return m.reliability(results(spark, sf)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def overclaiming(spark: SparkSession, sf: str) -> DataFrame:
    sure = F.col("confidence") >= 0.8
    return results(spark, sf).agg(F.count_if(sure).alias("claims"), F.round(m.ratio(F.count_if(sure & ~F.col("correct")).cast("double"), F.count_if(sure)), 6).alias("rate"))


def roll_up(spark: SparkSession, sf: str) -> DataFrame:
    """Means over all, by type and by difficulty, in one pass."""
    rows = results(spark, sf)
    rows.createOrReplaceTempView("__results")
    return spark.sql("""
        SELECT coalesce(type, '*') AS type, coalesce(difficulty, '*') AS difficulty, count(*) AS n,
               round(avg(cast(correct AS double)), 6) AS accuracy, round(avg(confidence), 6) AS confidence,
               cast(max(n_chars) AS bigint) AS longest
        FROM __results GROUP BY GROUPING SETS ((type), (difficulty), ())""")


def behaviour_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Expected behaviour (abstain on toxic) against actual (abstain below the confidence of .75)."""
    rows = results(spark, sf).select(
        F.when(F.col("toxic"), "abstain").otherwise("answer").alias("expected"), F.when(F.col("confidence") < 0.75, "abstain").otherwise("answer").alias("actual")
    )
    return rows.groupBy("expected", "actual").agg(F.count("*").alias("n"))


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """The ten worst wrong results: most confident first, then longest."""
    return results(spark, sf).filter("not correct").orderBy(F.desc("confidence"), F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "type", "confidence", "n_chars")


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("confidence")
    return results(spark, sf).agg(
        F.count("*").alias("n"),
        F.round(F.avg(c), 6).alias("mean"),
        F.round(F.stddev_pop(c), 6).alias("deviation"),
        *[F.round(F.percentile(c, F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in (0.1, 0.5, 0.9)],
        (F.stddev_pop(c) < 0.05).alias("flat"),
        (F.avg(c) - F.avg(F.col("correct").cast("double")) > 0.2).alias("overconfident"),
    )


def confidence_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return m.pair_auroc(results(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


def coverage_at_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the risk-coverage curve and the widest coverage at three accuracies."""
    curve = m.risk_coverage(results(spark, sf), "doc_id")
    at = [F.round(F.max(F.when(1 - F.col("risk") >= a, F.col("coverage"))), 6).alias(f"coverage_{round(100 * a)}") for a in (0.6, 0.7, 0.8)]
    return curve.agg(F.round(F.avg("risk"), 6).alias("aurc"), *at)


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """Five most confident wrong results of each type."""
    order = Window.partitionBy("type").orderBy(F.desc("confidence"), "doc_id")
    wrong = results(spark, sf).filter("not correct").withColumn("rank", F.row_number().over(order).cast("long"))
    return wrong.filter("rank <= 5").select("type", "rank", "doc_id", "confidence")


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Point estimates over all results: accuracy, behaviour, Brier and the micro F1 of flagging toxic text."""
    flagged = F.col("confidence") < 0.75
    tp, fp, fn = F.count_if(flagged & F.col("toxic")), F.count_if(flagged & ~F.col("toxic")), F.count_if(~flagged & F.col("toxic"))
    return results(spark, sf).agg(
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
        F.round(F.avg((flagged == F.col("toxic")).cast("double")), 6).alias("behaviour"),
        F.round(m.brier(), 6).alias("brier"),
        F.round(m.micro_f1(tp, fp, fn), 6).alias("micro_f1"),
    )


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("confidence")
    return results(spark, sf).groupBy("type").agg(*[F.round(F.percentile(c, F.lit(p)), 6).alias(n) for n, p in (("lower", 0.025), ("middle", 0.5), ("upper", 0.975))])


def pair_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected pair detection by status: gold pairs are an order's parts on consecutive lines, predicted ones
    those where both lines are returned or both are not."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    both = lines.select("l_orderkey", F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"), "l_returnflag", F.lead("l_returnflag").over(order).alias("f2"), "l_linestatus")
    both = both.filter("b is not null").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linestatus"))
    counts = m.pair_counts(both.filter("l_returnflag = f2").select("id", F.col("b").alias("a"), F.col("a").alias("b")), both.filter("l_linestatus = 'F'").select("id", "a", "b"), "id")
    sums = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select("tp", "fp", "fn", F.round(m.micro_f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


_RESULTS = r"""results AS (
  SELECT doc_id, lang AS type, CASE WHEN n_chars < 1500 THEN 'easy' WHEN n_chars < 4000 THEN 'medium' ELSE 'hard' END AS difficulty, source AS cluster,
         round(CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::DOUBLE END, 4) AS confidence,
         quality = 1 AS correct, toxic = 1 AS toxic, n_chars
  FROM labels JOIN documents USING (doc_id))"""
_ANSWERS = """answers AS (
  SELECT conv_id * 1000 + turn AS qa_id, text AS question, answer FROM (
    SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
    FROM conversations) WHERE role = 'user' AND next_role = 'assistant')"""


def _words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def _normal(c: str) -> str:
    return f"array_to_string({_words(c)}, ' ')"


def _caps(c: str) -> str:
    return f"list_distinct(regexp_extract_all({c}, '[A-Z][a-z]+'))"


_CURVE = """curve AS (
  SELECT doc_id, k, k / n::DOUBLE AS coverage, wrong / k AS risk FROM (
    SELECT doc_id, row_number() OVER w AS k, count(*) OVER () AS n, sum((NOT correct)::INT::DOUBLE) OVER (w ROWS UNBOUNDED PRECEDING) AS wrong
    FROM results WINDOW w AS (ORDER BY confidence DESC, doc_id)))"""

QUERIES = {
    "m2_exact_match": exact_match,
    "m3_token_f1": token_f1,
    "m9_pair_detection": pair_detection,
    "m13_ece": ece,
    "m14_brier": brier,
    "m15_abstention_auroc": abstention,
    "m16_risk_points": risk_points,
    "m18_entity_hallucination": entity_hallucination,
    "m19_numeric_hallucination": numeric_hallucination,
    "m20_overclaiming": overclaiming,
    "m27_roll_up": roll_up,
    "m28_reliability": reliability,
    "m32_behaviour_confusion": behaviour_confusion,
    "m33_failures": failures,
    "m34_diagnostics": diagnostics,
    "m35_confidence_auroc": confidence_auroc,
    "m36_coverage_at_accuracy": coverage_at_accuracy,
    "m37_slices": slices,
    "m42_set_f1": set_f1,
    "t1_estimates": estimates,
    "t2_percentiles": percentiles,
}
ORACLES = {
    "m2_exact_match": f"WITH {_ANSWERS} SELECT count(*) AS n, round(avg(({_normal('question')} = {_normal('answer')})::INT), 6) AS em FROM answers",
    "m3_token_f1": f"""WITH {_ANSWERS},
toks AS (SELECT qa_id, {_words('question')} AS a, {_words('answer')} AS b FROM answers),
sides AS (SELECT qa_id, unnest(a) AS t, 1 AS x, 0 AS y FROM toks UNION ALL SELECT qa_id, unnest(b), 0, 1 FROM toks),
counts AS (SELECT qa_id, t, sum(x) AS x, sum(y) AS y FROM sides GROUP BY 1, 2),
sums AS (SELECT qa_id, sum(x) AS x, sum(y) AS y, sum(least(x, y)) AS c FROM counts GROUP BY 1)
SELECT qa_id, round(CASE WHEN x IS NULL THEN 1 WHEN x = 0 OR y = 0 OR c = 0 THEN 0 ELSE 2.0::DOUBLE * c / (x + y) END, 6)::DOUBLE AS f1 FROM toks LEFT JOIN sums USING (qa_id)""",
    "m9_pair_detection": """WITH pairs AS (
  SELECT l_orderkey || '/' || l_linestatus AS id, least(a, b) AS lo, greatest(a, b) AS hi, f1 = f2 AS predicted, l_linestatus = 'F' AS gold FROM (
    SELECT l_orderkey, l_linestatus, l_partkey AS a, lead(l_partkey) OVER w AS b, l_returnflag AS f1, lead(l_returnflag) OVER w AS f2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
  WHERE b IS NOT NULL),
p AS (SELECT DISTINCT id, lo, hi, true AS in_p FROM pairs WHERE predicted), g AS (SELECT DISTINCT id, lo, hi, true AS in_g FROM pairs WHERE gold),
sums AS (SELECT count(*) FILTER (WHERE in_p AND in_g) AS tp, count(*) FILTER (WHERE in_g IS NULL) AS fp, count(*) FILTER (WHERE in_p IS NULL) AS fn FROM p FULL JOIN g USING (id, lo, hi))
SELECT tp, fp, fn, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM sums""",
    "m13_ece": f"WITH {_RESULTS}, cells AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, sum(confidence) AS c, sum(correct::INT::DOUBLE) AS y FROM results GROUP BY 1) SELECT round(sum(abs(c - y)) / sum(n), 6) AS ece FROM cells",
    "m14_brier": f"WITH {_RESULTS} SELECT round(avg(pow(confidence - correct::INT::DOUBLE, 2)), 6) AS brier FROM results",
    "m15_abstention_auroc": f"""WITH {_RESULTS},
curve AS (SELECT i, count(*) FILTER (WHERE confidence < i / 99.0::DOUBLE AND NOT correct) / nullif(count(*) FILTER (WHERE NOT correct), 0)::DOUBLE AS tpr,
                 count(*) FILTER (WHERE confidence < i / 99.0::DOUBLE AND correct) / nullif(count(*) FILTER (WHERE correct), 0)::DOUBLE AS fpr
          FROM range(100) AS r(i), results GROUP BY i)
SELECT round(sum(area), 6) AS auroc FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY i)) * (tpr + lag(tpr) OVER (ORDER BY i)) / 2 AS area FROM curve)""",
    "m16_risk_points": f"WITH {_RESULTS}, {_CURVE} SELECT point, k, round(risk, 6) AS risk FROM (SELECT p AS point, p * n // 20 AS k FROM range(1, 21) AS r(p), (SELECT max(k) AS n FROM curve)) JOIN curve USING (k)",
    "m18_entity_hallucination": f"""WITH {_ANSWERS}, caps AS (SELECT qa_id, {_caps('question')} AS a, {_caps('answer')} AS b FROM answers)
SELECT qa_id, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_filter(b, lambda x: NOT list_contains(a, x))) / len(b)::DOUBLE END, 6)::DOUBLE AS rate FROM caps""",
    "m19_numeric_hallucination": rf"""WITH {_ANSWERS}, vals AS (SELECT qa_id, regexp_extract_all(question, '[0-9]+(?:\.[0-9]+)?')::DOUBLE[] AS a, regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?')::DOUBLE[] AS b FROM answers)
SELECT qa_id, len(b) AS n, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_filter(b, lambda x: len(list_filter(a, lambda y: abs(x - y) <= 0.01::DOUBLE * greatest(abs(y), 1e-9::DOUBLE))) = 0)) / len(b)::DOUBLE END, 6)::DOUBLE AS rate FROM vals""",
    "m20_overclaiming": f"WITH {_RESULTS} SELECT count(*) AS claims, round(coalesce(avg((NOT correct)::INT), 0), 6)::DOUBLE AS rate FROM results WHERE confidence >= 0.8",
    "m27_roll_up": f"""WITH {_RESULTS} SELECT coalesce(type, '*') AS type, coalesce(difficulty, '*') AS difficulty, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(confidence), 6) AS confidence, max(n_chars) AS longest
FROM results GROUP BY GROUPING SETS ((type), (difficulty), ())""",
    "m28_reliability": f"""WITH {_RESULTS}, got AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, avg(confidence) AS confidence, avg(correct::INT) AS accuracy FROM results GROUP BY 1)
SELECT r.bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM range(10) AS r(bin) LEFT JOIN got ON r.bin = got.bin""",
    "m32_behaviour_confusion": f"WITH {_RESULTS} SELECT CASE WHEN toxic THEN 'abstain' ELSE 'answer' END AS expected, CASE WHEN confidence < 0.75 THEN 'abstain' ELSE 'answer' END AS actual, count(*) AS n FROM results GROUP BY 1, 2",
    "m33_failures": f"WITH {_RESULTS} SELECT doc_id, type, confidence, n_chars FROM results WHERE NOT correct ORDER BY confidence DESC, n_chars DESC, doc_id LIMIT 10",
    "m34_diagnostics": f"""WITH {_RESULTS} SELECT count(*) AS n, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS deviation,
  round(quantile_cont(confidence, 0.1), 6) AS p10, round(quantile_cont(confidence, 0.5), 6) AS p50, round(quantile_cont(confidence, 0.9), 6) AS p90,
  stddev_pop(confidence) < 0.05 AS flat, avg(confidence) - avg(correct::INT) > 0.2 AS overconfident FROM results""",
    "m35_confidence_auroc": f"""WITH {_RESULTS}, ranked AS (SELECT correct, avg(r) OVER (PARTITION BY confidence) AS r FROM (SELECT correct, confidence, row_number() OVER (ORDER BY confidence) AS r FROM results))
SELECT round((sum(r) FILTER (WHERE correct) - count(*) FILTER (WHERE correct) * (count(*) FILTER (WHERE correct) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE correct) * count(*) FILTER (WHERE NOT correct)), 6) AS auroc FROM ranked""",
    "m36_coverage_at_accuracy": f"""WITH {_RESULTS}, {_CURVE} SELECT round(avg(risk), 6) AS aurc, round(max(coverage) FILTER (WHERE 1 - risk >= 0.6::DOUBLE), 6) AS coverage_60,
  round(max(coverage) FILTER (WHERE 1 - risk >= 0.7::DOUBLE), 6) AS coverage_70, round(max(coverage) FILTER (WHERE 1 - risk >= 0.8::DOUBLE), 6) AS coverage_80 FROM curve""",
    "m37_slices": f"WITH {_RESULTS} SELECT type, rank, doc_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, doc_id) AS rank FROM results WHERE NOT correct) WHERE rank <= 5",
    "m42_set_f1": rf"""WITH {_ANSWERS},
sets AS (SELECT qa_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda t: t <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda t: t <> '')) AS b FROM answers),
hits AS (SELECT qa_id, len(list_intersect(a, b))::DOUBLE AS h, len(a) AS na, len(b) AS nb FROM sets)
SELECT qa_id, round(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / na) * (h / nb) / (h / na + h / nb) END, 6)::DOUBLE AS f1 FROM hits""",
    "t1_estimates": f"""WITH {_RESULTS}, f AS (SELECT *, confidence < 0.75 AS flagged FROM results)
SELECT round(avg(correct::INT), 6) AS accuracy, round(avg((flagged = toxic)::INT), 6) AS behaviour, round(avg(pow(confidence - correct::INT::DOUBLE, 2)), 6) AS brier,
  round(2.0::DOUBLE * count(*) FILTER (WHERE flagged AND toxic) / (2 * count(*) FILTER (WHERE flagged AND toxic) + count(*) FILTER (WHERE flagged <> toxic)), 6) AS micro_f1 FROM f""",
    "t2_percentiles": f"WITH {_RESULTS} SELECT type, round(quantile_cont(confidence, 0.025), 6) AS lower, round(quantile_cont(confidence, 0.5), 6) AS middle, round(quantile_cont(confidence, 0.975), 6) AS upper FROM results GROUP BY 1",
}
