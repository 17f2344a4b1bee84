"""Queries of retrieval evaluation, detector comparison, dataset construction and report tools.

Gold documents of a benchmark item are those that hold it, exactly or nearly, by the audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit as a
from ..operators import conflict, control, evidence, retrieval, stats
from ..operators import metrics as m
from ..scratch import saved
from .evaluation import _ANSWERS, _RESULTS, answers, results
from .knowledge import _BODIES, _EXACT, _NEAR, overlap
from .retrieval import _INDEX, bm25_sql


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap(spark, sf)
    return saved(found.exact().select("item_id", "doc_id").union(found.near().select("item_id", "doc_id")).distinct().withColumnRenamed("item_id", "query_id"), "gold")  # often read twice


def hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    queries = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(_table(spark, sf, "documents"), queries, k)


def evidence_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of the first five hits of each item; all items, found or not."""
    got = hits(spark, sf, 5).groupBy("query_id").agg(F.collect_set("doc_id").alias("got"))
    want = gold(spark, sf).groupBy("query_id").agg(F.collect_set("doc_id").alias("want"))
    none = F.array().cast("array<long>")
    rows = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(got, "query_id", "left").join(want, "query_id", "left")
    p, r, f = m.set_scores(F.coalesce("got", none), F.coalesce("want", none))
    return rows.select("query_id", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    scores = m.ranking_scores(hits(spark, sf, 10), gold(spark, sf))
    return scores.select("query_id", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"), "found", "relevant")


def supporting_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The first three hits of each item as its supporting facts, and whether they and the first hit are exactly right."""
    top = hits(spark, sf, 3).groupBy("query_id").agg(F.collect_set("doc_id").alias("facts"), F.min_by("doc_id", "rank").alias("first"))
    want = gold(spark, sf).groupBy("query_id").agg(F.collect_set("doc_id").alias("want"))
    none = F.array().cast("array<long>")
    rows = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(top, "query_id", "left").join(want, "query_id", "left")
    rows = rows.withColumns({"facts": F.coalesce("facts", none), "want": F.coalesce("want", none)})
    p, r, f = m.set_scores(F.col("facts"), F.col("want"))
    joint = m.joint_em(F.coalesce(F.array_contains("want", F.col("first")), F.lit(False)), f == 1)
    return rows.select("query_id", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"), joint.alias("joint_em"))


def resolution_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring lines of an order as conflicts: what the first of a pair's lines decides, against the status of its last."""
    pair = F.concat_ws("-", F.col("l_partkey") % 50, F.col("l_suppkey") % 7)
    rows = _table(spark, sf, "lineitem").select(pair.alias("pair"), "l_returnflag", "l_linestatus", F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("seq"))
    decided = rows.select("pair", F.col("l_returnflag").alias("resolution"), "seq")
    want = rows.groupBy("pair").agg(F.max_by("l_returnflag", "seq").alias("resolution"))
    return m.resolution_accuracy(decided, want).select(F.round("accuracy", 6).alias("accuracy"))


def _evidence_ids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predicted conflicts between chunks of an item's first four hits, its gold documents as evidence (each in two spans), and gold conflicts: a document's spans, and neighbouring documents."""
    own = hits(spark, sf, 4).select("query_id", F.concat("doc_id", F.lit("_c"), F.col("rank") - 1).alias("chunk"), "rank")
    a, b = own.withColumnsRenamed({"chunk": "a", "rank": "i"}), own.withColumnsRenamed({"chunk": "b", "rank": "j"})
    predicted = a.join(b, "query_id").filter("i <= j").select("query_id", "a", "b")
    order = Window.partitionBy("query_id").orderBy("doc_id")
    docs = gold(spark, sf).withColumn("n", F.row_number().over(order))
    spans = docs.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    ids = spans.select("query_id", "doc_id", F.concat(F.lit("E"), F.col("n") * 2 + F.col("k")).alias("evidence_id"), F.col("k").alias("seq"))
    at = lambda i: F.concat(F.lit("E"), F.col("n") * 2 + i)
    inside = F.struct(at(0).alias("a"), at(1).alias("b"))
    between = F.when(F.lead("n").over(order).isNotNull(), F.struct(at(0).alias("a"), at(2).alias("b")))
    # from one row: Spark takes a union of tables dealt by one key as dealt by it too, though partitions of either may be joined differently
    want = docs.select("query_id", F.array(inside, between).alias("pairs")).select("query_id", F.explode("pairs").alias("pair")).filter("pair is not null")
    return predicted, ids, want.select("query_id", "pair.a", "pair.b")


def gold_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    predicted, ids, want = _evidence_ids(spark, sf)
    return m.restricted_counts(m.mapped_pairs(predicted, ids, want), ids, want)


def mapped_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return m.mapped_pairs(*_evidence_ids(spark, sf))


def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the first ten hits over items by length and by the number of their gold documents."""
    want = gold(spark, sf)
    many = want.groupBy("query_id").agg(F.count("*").alias("n"))
    slices = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.length("text") < 250, "short").otherwise("long").alias("length")).join(many, "query_id", "left")
    slices = slices.select("query_id", "length", F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "one").otherwise("several").alias("hops"))
    return m.retrieval_report(hits(spark, sf, 10), want, slices, ("length", "hops"))


def depth_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Macro precision and recall over items with gold at four depths, and which depth has the best F1."""
    real = gold(spark, sf)
    marked = hits(spark, sf, 10).join(real.withColumn("good", F.lit(1)), ["query_id", "doc_id"], "left")
    depths = F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k")
    per = marked.select("query_id", "rank", "good", depths).filter("rank <= k").groupBy("k", "query_id").agg(F.count("good").alias("found"), F.count("*").alias("got"))
    want = real.groupBy("query_id").agg(F.count("*").alias("want"))
    macro = per.join(want, "query_id").groupBy("k").agg(F.avg(F.col("found") / F.col("got")).alias("p"), F.avg(F.col("found") / F.col("want")).alias("r"))
    macro = macro.select(F.col("k").cast("long").alias("k"), F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(m.f1(F.col("p"), F.col("r")), 6).alias("f1"))
    best = Window.orderBy(F.desc("f1"), F.desc("p"), F.desc("r"))  # four rows
    return macro.withColumn("best", F.row_number().over(best) == 1)


def item_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Items by the length of their text and whether they have gold, with totals."""
    rows = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.length("text") < 200, "short").otherwise("long").alias("size"))
    rows = rows.join(gold(spark, sf).select("query_id").distinct().withColumn("has", F.lit(True)), "query_id", "left").fillna(False)
    return rows.cube("size", "has").agg(F.count("*").alias("n")).select(F.coalesce("size", F.lit("*")).alias("size"), F.coalesce(F.col("has").cast("string"), F.lit("*")).alias("has"), "n")


def soft_f1(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("qa_id", F.round(m.soft_f1(F.col("question"), F.col("answer")), 6).alias("f1"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """An order cites the supplier of each line; those of lines with a discount of 5% or more are required."""
    lines = _table(spark, sf, "lineitem")
    cited = F.collect_list("l_suppkey")
    by = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(cited.alias("cited"), F.collect_set(F.when(F.col("l_discount") >= 0.05, F.col("l_suppkey"))).alias("required"))
    p, r, f = m.citation_scores(F.col("cited"), F.col("required"))
    return by.select("order_id", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts of consecutive lines of an order: predicted kind is the first's return flag, gold kind the second's, gold where finished."""
    lines = _table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"), F.col("l_returnflag").alias("kind"), F.lead("l_returnflag").over(order).alias("kind2"), "l_linestatus", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("seq"))
    rows = rows.filter("b is not null and a <> b")
    g = rows.filter("l_linestatus = 'F'").select("a", "b", F.col("kind2").alias("kind"))
    return rows.select("b", "a", "kind", "seq"), g


def conflict_types(spark: SparkSession, sf: str) -> DataFrame:
    return m.type_accuracy(*_pairs(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


def false_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return m.false_rate(*_pairs(spark, sf)).select(F.round("rate", 6).alias("rate"))


def unsupported(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without any accepted line."""
    claims = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    support = _table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k"))
    return m.unsupported_rate(claims, support, "k").select(F.round("rate", 6).alias("rate"))


def detector_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two detectors of toxic text, each's counts and F1, and which gains."""
    rows = results(spark, sf).select("toxic", F.explode(F.array(F.struct(F.lit("letters").alias("detector"), (F.col("confidence") < 0.75).alias("hit")), F.struct(F.lit("length").alias("detector"), (F.col("n_chars") < 1200).alias("hit")))).alias("d"))
    tp, fp, fn = F.count_if(F.col("d.hit") & F.col("toxic")), F.count_if(F.col("d.hit") & ~F.col("toxic")), F.count_if(~F.col("d.hit") & F.col("toxic"))
    by = rows.groupBy("d.detector").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(m.micro_f1(tp, fp, fn), 6).alias("f1"))
    return by.withColumn("best", F.col("f1") == F.max("f1").over(Window.partitionBy()))  # two rows


def premise_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Refutation of toxic premises: expected where toxic, detected where the confidence is below .78."""
    want, got = F.col("toxic"), F.col("confidence") < 0.78
    tp, fp, fn = F.count_if(want & got), F.count_if(~want & got), F.count_if(want & ~got)
    return results(spark, sf).groupBy("type").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(m.ratio(tp.cast("double"), tp + fp), 6).alias("p"), F.round(m.ratio(tp.cast("double"), tp + fn, 1.0), 6).alias("r"))


def failure_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Failures by kind, and the kind that is at least twice as frequent as the other, if any."""
    sure, unsure = F.count_if(~F.col("correct") & (F.col("confidence") >= 0.78)), F.count_if(~F.col("correct") & (F.col("confidence") < 0.78))
    one = results(spark, sf).groupBy("difficulty").agg(sure.alias("sure"), unsure.alias("unsure"))
    main = F.when(F.col("sure") >= 2 * F.col("unsure"), "sure").when(F.col("unsure") >= 2 * F.col("sure"), "unsure").otherwise("mixed")
    return one.withColumn("main", main)


def grouped_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score by type with each type's own fit, that of all where a type has too few rows."""
    rows = results(spark, sf)
    fits = stats.grouped_platt(rows, "type", 50)
    table = spark.createDataFrame([(k, *v) for k, v in fits.items()], "type string, a double, b double")
    a0, b0 = fits["*"]
    own = rows.join(F.broadcast(table), "type", "left")  # a row for each type
    after = stats.sigmoid(F.coalesce("a", F.lit(a0)) * stats.logit(F.col("confidence")) + F.coalesce("b", F.lit(b0)))
    square = (after - F.col("correct").cast("double")) ** 2
    return own.groupBy("type").agg(F.count("*").alias("n"), F.round(m.brier(), 6).alias("before"), F.round(F.avg(square), 6).alias("after"))


def split_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by market segment, split by quota."""
    return stats.quota_split(_table(spark, sf, "customer"), "c_custkey", "c_mktsegment").groupBy("c_mktsegment", "split").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def pair_examples(spark: SparkSession, sf: str, negatives: int = 2) -> DataFrame:
    """Positives: parts of one brand, type and size whose prices differ by a tenth; negatives: neighbours in price of
    the same brand and type, two for each at most, in order of their keys."""
    part = _table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    x, y = part.alias("x"), part.alias("y")
    same = x.join(y, (F.col("x.p_brand") == F.col("y.p_brand")) & (F.col("x.p_type") == F.col("y.p_type")) & (F.col("x.p_size") == F.col("y.p_size")) & (F.col("x.p_partkey") < F.col("y.p_partkey")))
    good = same.filter(F.greatest("x.p_retailprice", "y.p_retailprice") / F.least("x.p_retailprice", "y.p_retailprice") > 1.05).select(F.col("x.p_partkey").alias("a"), F.col("y.p_partkey").alias("b"), F.lit(1).cast("long").alias("label"))
    order = Window.partitionBy("p_brand", "p_type").orderBy("p_retailprice", "p_partkey")
    nexts = [part.select(F.col("p_partkey").alias("a"), F.lead("p_partkey", i).over(order).alias("b"), F.col("p_size").alias("s"), F.lead("p_size", i).over(order).alias("t")) for i in range(1, negatives + 1)]
    bad = nexts[0]
    for n in nexts[1:]:
        bad = bad.unionByName(n)
    return good.unionByName(bad.filter("b is not null and s <> t").select("a", "b", F.lit(0).cast("long").alias("label")))


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """For each exact finding, up to twenty characters around its place in the normalised text."""
    items, docs = a.normalised(_table(spark, sf, "benchmark"), "item_id"), a.normalised(_table(spark, sf, "documents"), "doc_id")
    found = overlap(spark, sf).exact().join(docs, "doc_id").join(items.select("item_id", F.length("body").alias("n")), "item_id")
    low = F.greatest(F.lit(0), F.col("at") - 20)
    return found.select("item_id", "doc_id", "at", F.expr("substring(body, cast(greatest(0, at - 20) as int) + 1, cast(at - greatest(0, at - 20) + n + 20 as int))").alias("excerpt"), low.alias("low"))


def audit_items(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations flattened to (id, kind, digest) items, blank ones left out."""
    turns = _table(spark, sf, "conversations").filter(F.trim("text") != "")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("item"), F.when(F.col("role") == "user", "question").otherwise("answer").alias("kind"), F.md5("text").alias("digest"))


def requested_order(spark: SparkSession, sf: str) -> DataFrame:
    """A report cut to the ids that another table asks for, in that table's order."""
    asked = _table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.row_number().over(Window.partitionBy().orderBy("doc_id")).cast("long").alias("place"))
    return results(spark, sf).join(asked, "doc_id").select("place", "doc_id", "type", "confidence")


def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as evidence: relevance clamped to one, quality of .3 or more."""
    docs = _table(spark, sf, "documents").select("doc_id", "source")
    rows = hits(spark, sf, 5).join(docs, "doc_id")
    quality = evidence.combined(evidence.credibility(F.col("source")), F.lit(0.5), evidence.clamp(F.col("score") / 100))
    return rows.select("query_id", "doc_id", F.round(quality, 10).alias("quality")).filter("quality >= 0.3")


def final_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Five signals of a result fused, capped at .4 where toxic."""
    rows = results(spark, sf)
    parts = [F.col("confidence"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0), F.when(F.col("toxic"), 0.0).otherwise(1.0), F.when(F.col("difficulty") == "easy", 1.0).otherwise(0.5), F.lit(0.5)]
    raw = control.fused(parts)
    capped = F.when(F.col("toxic"), F.least(raw, F.lit(0.4))).otherwise(raw)
    return rows.select("doc_id", F.round(capped, 8).alias("confidence"), F.when(F.col("toxic") & (raw > 0.4), F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("caps")).withColumn("caps", F.array_join("caps", ","))


def repaired_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of an order's claims after repair by its verdict."""
    status = F.when(F.col("l_returnflag") == "R", "refuted").when(F.col("l_returnflag") == "A", "supported").otherwise("not_enough_info")
    rows = _table(spark, sf, "lineitem").select("l_orderkey", status.alias("status"), (1 - F.col("l_discount")).alias("confidence"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(control.repaired(F.col("confidence"), F.col("status"))), 6).alias("confidence"))


def claim_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of documents with a negation, a broad or a narrow marker."""
    lines = _table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    low = F.lower("line")
    flags = lines.select("doc_id", low.rlike(r"(^|[^a-z])(not|no|never|cannot|false)([^a-z]|$)").alias("negated"), conflict.any_of(low, conflict.BROAD).alias("broad"), conflict.any_of(low, conflict.NARROW).alias("narrow"))
    return flags.groupBy("negated", "broad", "narrow").agg(F.count("*").alias("n"))


_GOLD = f"{_NEAR}, {_EXACT}, gold AS (SELECT item_id AS query_id, doc_id FROM exact UNION SELECT item_id, doc_id FROM near WHERE score >= 0.85)"
_PAIRS = """rows_ AS (SELECT l_partkey AS a, lead(l_partkey) OVER w AS b, l_returnflag AS kind, lead(l_returnflag) OVER w AS kind2, l_linestatus, l_orderkey, l_linenumber, l_suppkey, l_quantity
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
pairs AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, * FROM rows_ WHERE b IS NOT NULL AND a <> b),
gold AS (SELECT lo, hi, kind2 AS kind FROM pairs WHERE l_linestatus = 'F')"""
_SOFT = r"regexp_extract_all(lower({0}), '[0-9]+(?:\.[0-9]+)?%?|[a-z]+(?:-[a-z]+)*')"

_EIDS = f"""{_GOLD}, {_INDEX}, {bm25_sql('hits', 4)},
docs_ AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM gold),
ids AS (SELECT query_id, doc_id, 'E' || (2 * n + k) AS evidence_id, k FROM docs_, (SELECT unnest([0, 1]) AS k)),
want AS (SELECT query_id, least('E' || 2 * n, 'E' || (2 * n + 1)) AS lo, greatest('E' || 2 * n, 'E' || (2 * n + 1)) AS hi FROM docs_
  UNION ALL SELECT query_id, least('E' || 2 * n, 'E' || (2 * n + 2)), greatest('E' || 2 * n, 'E' || (2 * n + 2)) FROM docs_ d WHERE EXISTS (SELECT 1 FROM docs_ e WHERE e.query_id = d.query_id AND e.n = d.n + 1)),
said AS (SELECT x.query_id, x.doc_id AS a, y.doc_id AS b, x.doc_id || '_c' || (x.rank - 1) AS ca, y.doc_id || '_c' || (y.rank - 1) AS cb FROM hits x JOIN hits y ON x.query_id = y.query_id AND x.rank <= y.rank),
sides AS (SELECT said.query_id, ca, cb, coalesce(i.evidence_id, ca) AS ea, coalesce(i.k, 0) AS ka, coalesce(j.evidence_id, cb) AS eb, coalesce(j.k, 0) AS kb
  FROM said LEFT JOIN ids i ON i.query_id = said.query_id AND i.doc_id = a LEFT JOIN ids j ON j.query_id = said.query_id AND j.doc_id = b),
choices AS (SELECT s.query_id, ca, cb, least(ea, eb) AS lo, greatest(ea, eb) AS hi, w.query_id IS NOT NULL AS real, ka, kb FROM sides s LEFT JOIN (SELECT DISTINCT query_id, lo, hi FROM want) w
  ON w.query_id = s.query_id AND w.lo = least(ea, eb) AND w.hi = greatest(ea, eb)),
mapped AS (SELECT DISTINCT query_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ca, cb ORDER BY real DESC, CASE WHEN real THEN 2 * ka + kb ELSE -2 * ka - kb END) AS r FROM choices) WHERE r = 1)"""

QUERIES = {
    "m4_soft_f1": soft_f1,
    "m5_evidence_scores": evidence_scores,
    "m8_citations": citations,
    "m10_conflict_types": conflict_types,
    "m12_false_conflicts": false_conflicts,
    "m17_unsupported": unsupported,
    "m21_ranking": ranking,
    "m22_item_summary": item_summary,
    "m23_depth_sweep": depth_sweep,
    "m29_failure_summary": failure_summary,
    "m31_premise_summary": premise_summary,
    "m40_detector_comparison": detector_comparison,
    "k4_grouped_calibration": grouped_calibration,
    "g3_split_quotas": split_quotas,
    "g4_pair_examples": pair_examples,
    "a5_excerpts": excerpts,
    "a6_audit_items": audit_items,
    "p3_requested_order": requested_order,
    "e1_quality_filter": quality_filter,
    "u18_repaired_answers": repaired_answers,
    "m6_supporting_facts": supporting_facts,
    "m11_resolutions": resolution_accuracy,
    "m22_retrieval_report": retrieval_report,
    "m24_gold_conflicts": gold_conflicts,
    "m25_mapped_conflicts": mapped_conflicts,
    "u22_final_confidence": final_confidence,
    "x7_claim_contrasts": claim_contrasts,
}
ORACLES = {
    "m4_soft_f1": rf"""WITH {_ANSWERS},
t AS (SELECT qa_id, regexp_replace(lower(question), '[^\p{{L}}\p{{N}}]', '', 'g') AS p, regexp_replace(lower(answer), '[^\p{{L}}\p{{N}}]', '', 'g') AS r, {_SOFT.format('question')} AS a, {_SOFT.format('answer')} AS b FROM answers),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS c FROM t)
SELECT qa_id, round(CASE WHEN p = '' AND r = '' THEN 1 WHEN p = '' OR r = '' THEN 0 WHEN contains(p, r) THEN 1 WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN c = 0 THEN 0 ELSE 2.0::DOUBLE * c / (len(a) + len(b)) END, 6)::DOUBLE AS f1 FROM c""",
    "m5_evidence_scores": f"""WITH {_INDEX}, {bm25_sql('hits', 5)}, {_GOLD},
s AS (SELECT item_id AS query_id, (SELECT count(*) FROM hits h WHERE h.query_id = item_id) AS got, (SELECT count(*) FROM gold g WHERE g.query_id = item_id) AS want,
  (SELECT count(*) FROM hits h JOIN gold g USING (query_id, doc_id) WHERE h.query_id = item_id) AS found FROM benchmark),
q AS (SELECT query_id, CASE WHEN got = 0 THEN 0 ELSE found / got::DOUBLE END AS p, CASE WHEN want = 0 THEN 1 ELSE found / want::DOUBLE END AS r FROM s)
SELECT query_id, round(p, 6)::DOUBLE AS p, round(r, 6)::DOUBLE AS r, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM q""",
    "m8_citations": """WITH o AS (SELECT l_orderkey AS order_id, list(l_suppkey) AS c, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_discount >= 0.05), []) AS r FROM lineitem GROUP BY 1),
s AS (SELECT order_id, len(list_filter(c, lambda x: list_contains(r, x))) / len(c)::DOUBLE AS p, CASE WHEN len(r) = 0 THEN 1 ELSE len(list_filter(r, lambda x: list_contains(c, x))) / len(r)::DOUBLE END AS r FROM o)
SELECT order_id, round(p, 6) AS p, round(r, 6)::DOUBLE AS r, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM s""",
    "m10_conflict_types": f"""WITH {_PAIRS}, said AS (SELECT lo, hi, kind AS said FROM (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS r FROM pairs) WHERE r = 1)
SELECT round(coalesce(avg(coalesce(said = kind, false)::INT), 1), 6)::DOUBLE AS accuracy FROM gold LEFT JOIN said USING (lo, hi)""",
    "m12_false_conflicts": f"WITH {_PAIRS} SELECT round(avg((g.lo IS NULL)::INT), 6) AS rate FROM (SELECT DISTINCT lo, hi FROM pairs) p LEFT JOIN (SELECT DISTINCT lo, hi FROM gold) g ON p.lo = g.lo AND p.hi = g.hi",
    "m17_unsupported": "SELECT round(avg((s.k IS NULL)::INT), 6) AS rate FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A') s ON o_orderkey = s.k",
    "m21_ranking": f"""WITH {_INDEX}, {bm25_sql('hits', 10)}, {_GOLD},
marked AS (SELECT h.query_id, rank, g.doc_id IS NOT NULL AS good FROM hits h LEFT JOIN gold g USING (query_id, doc_id)),
per AS (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE good), 0) AS rr, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (WHERE good), 0) AS dcg, count(*) AS retrieved, count(*) FILTER (WHERE good) AS found FROM marked GROUP BY 1),
every AS (SELECT query_id, coalesce(rr, 0) AS rr, coalesce(dcg, 0) AS dcg, coalesce(retrieved, 0) AS retrieved, coalesce(found, 0) AS found, coalesce(relevant, 0) AS relevant FROM per FULL JOIN (SELECT query_id, count(*) AS relevant FROM gold GROUP BY 1) USING (query_id)),
ideal AS (SELECT *, coalesce(list_sum(list_transform(range(1, least(relevant, retrieved) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 0) AS ideal FROM every)
SELECT query_id, round(rr, 6)::DOUBLE AS rr, round(CASE WHEN relevant = 0 THEN 1 WHEN ideal = 0 THEN 0 ELSE dcg / ideal END, 6)::DOUBLE AS ndcg, found, relevant FROM ideal""",
    "m22_item_summary": f"""WITH {_GOLD}, s AS (SELECT CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS size, (item_id IN (SELECT query_id FROM gold))::VARCHAR AS has FROM benchmark)
SELECT coalesce(size, '*') AS size, coalesce(has, '*') AS has, count(*) AS n FROM s GROUP BY CUBE (size, has)""",
    "m23_depth_sweep": f"""WITH {_INDEX}, {bm25_sql('hits', 10)}, {_GOLD},
per AS (SELECT k, query_id, count(g.doc_id) AS found, count(*) AS got FROM hits h LEFT JOIN gold g USING (query_id, doc_id), (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rank <= k GROUP BY 1, 2),
macro AS (SELECT k, avg(found / got::DOUBLE) AS p, avg(found / want::DOUBLE) AS r FROM per JOIN (SELECT query_id, count(*) AS want FROM gold GROUP BY 1) USING (query_id) GROUP BY 1),
done AS (SELECT k::BIGINT AS k, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM macro)
SELECT *, row_number() OVER (ORDER BY f1 DESC, p DESC, r DESC) = 1 AS best FROM done""",
    "m29_failure_summary": f"""WITH {_RESULTS}, c AS (SELECT difficulty, count(*) FILTER (WHERE NOT correct AND confidence >= 0.78) AS sure, count(*) FILTER (WHERE NOT correct AND confidence < 0.78) AS unsure FROM results GROUP BY 1)
SELECT *, CASE WHEN sure >= 2 * unsure THEN 'sure' WHEN unsure >= 2 * sure THEN 'unsure' ELSE 'mixed' END AS main FROM c""",
    "m31_premise_summary": f"""WITH {_RESULTS}, c AS (SELECT type, count(*) FILTER (WHERE toxic AND confidence < 0.78) AS tp, count(*) FILTER (WHERE NOT toxic AND confidence < 0.78) AS fp, count(*) FILTER (WHERE toxic AND confidence >= 0.78) AS fn FROM results GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6)::DOUBLE AS p, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn)::DOUBLE END, 6)::DOUBLE AS r FROM c""",
    "m40_detector_comparison": f"""WITH {_RESULTS}, d AS (SELECT 'letters' AS detector, confidence < 0.75 AS hit, toxic FROM results UNION ALL SELECT 'length', n_chars < 1200, toxic FROM results),
c AS (SELECT detector, count(*) FILTER (WHERE hit AND toxic) AS tp, count(*) FILTER (WHERE hit AND NOT toxic) AS fp, count(*) FILTER (WHERE NOT hit AND toxic) AS fn FROM d GROUP BY 1),
f AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6)::DOUBLE AS f1 FROM c) SELECT *, f1 = max(f1) OVER () AS best FROM f""",
    "g3_split_quotas": """WITH o AS (SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1(c_custkey::VARCHAR)) - 1) / (count(*) OVER (PARTITION BY c_mktsegment))::DOUBLE AS p FROM customer)
SELECT c_mktsegment, CASE WHEN p < 0.15::DOUBLE THEN 'validation' WHEN p < 0.15::DOUBLE + 0.15::DOUBLE THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(c_custkey) AS first FROM o GROUP BY 1, 2""",
    "g4_pair_examples": """SELECT x.p_partkey AS a, y.p_partkey AS b, 1::BIGINT AS label FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey
  WHERE greatest(x.p_retailprice, y.p_retailprice) / least(x.p_retailprice, y.p_retailprice) > 1.05::DOUBLE
UNION ALL SELECT a, b, 0 FROM (SELECT p_partkey AS a, p_size AS s, lead(p_partkey, 1) OVER w AS b, lead(p_size, 1) OVER w AS t FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey)
  UNION ALL SELECT p_partkey, p_size, lead(p_partkey, 2) OVER w, lead(p_size, 2) OVER w FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey)) WHERE b IS NOT NULL AND s <> t""",
    "a5_excerpts": f"""WITH {_BODIES}, {_EXACT} SELECT item_id, doc_id, e.at, substring(d.body, (greatest(0, e.at - 20) + 1)::BIGINT, (e.at - greatest(0, e.at - 20) + length(i.body) + 20)::BIGINT) AS excerpt, greatest(0, e.at - 20)::BIGINT AS low
FROM exact e JOIN docs d USING (doc_id) JOIN items i USING (item_id)""",
    "a6_audit_items": "SELECT conv_id || ':' || turn AS item, CASE WHEN role = 'user' THEN 'question' ELSE 'answer' END AS kind, md5(text) AS digest FROM conversations WHERE trim(text) <> ''",
    "p3_requested_order": f"WITH {_RESULTS} SELECT place, doc_id, type, confidence FROM results JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM labels WHERE toxic = 1) USING (doc_id)",
    "e1_quality_filter": f"""WITH {_INDEX}, {bm25_sql('hits', 5)}, q AS (SELECT query_id, doc_id, round(0.4::DOUBLE * (CASE WHEN regexp_matches(lower(source), '{evidence.HIGH}') THEN 0.9 WHEN regexp_matches(lower(source), '{evidence.MEDIUM}') THEN 0.7 ELSE 0.5 END)::DOUBLE
  + 0.3::DOUBLE * 0.5::DOUBLE + 0.3::DOUBLE * greatest(0, least(1, score / 100)), 10) AS quality FROM hits JOIN documents USING (doc_id)) SELECT * FROM q WHERE quality >= 0.3""",
    "m6_supporting_facts": f"""WITH {_GOLD}, {_INDEX}, {bm25_sql('hits', 3)},
top AS (SELECT query_id, list(DISTINCT doc_id) AS facts, min_by(doc_id, rank) AS first FROM hits GROUP BY 1), want AS (SELECT query_id, list(doc_id) AS want FROM gold GROUP BY 1),
every AS (SELECT item_id AS query_id, coalesce(facts, []) AS facts, coalesce(want, []) AS want, first FROM benchmark LEFT JOIN top ON item_id = top.query_id LEFT JOIN want ON item_id = want.query_id),
scored AS (SELECT *, CASE WHEN len(facts) = 0 THEN 0.0 ELSE len(list_intersect(facts, want)) / len(facts)::DOUBLE END::DOUBLE AS p, CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(facts, want)) / len(want)::DOUBLE END::DOUBLE AS r FROM every),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END::DOUBLE AS f1 FROM scored)
SELECT query_id, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, CASE WHEN coalesce(list_contains(want, first), false) AND f1 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS joint_em FROM f""",
    "m11_resolutions": """WITH rows_ AS (SELECT (l_partkey % 50) || '-' || (l_suppkey % 7) AS pair, l_returnflag AS flag, row_number() OVER (PARTITION BY l_partkey % 50, l_suppkey % 7 ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS r,
  row_number() OVER (PARTITION BY l_partkey % 50, l_suppkey % 7 ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS back FROM lineitem)
SELECT round(avg((x.flag = y.flag)::INT), 6) AS accuracy FROM (SELECT * FROM rows_ WHERE r = 1) x JOIN (SELECT * FROM rows_ WHERE back = 1) y USING (pair)""",
    "m22_retrieval_report": f"""WITH {_GOLD}, {_INDEX}, {bm25_sql('hits', 10)},
marked AS (SELECT query_id, rank, g.doc_id IS NOT NULL AS good FROM hits LEFT JOIN gold g USING (query_id, doc_id)),
by_query AS (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE good), 0) AS rr, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (WHERE good), 0) AS dcg, count(*) AS retrieved, count(*) FILTER (WHERE good) AS found FROM marked GROUP BY 1),
wants AS (SELECT query_id, count(*) AS relevant FROM gold GROUP BY 1),
joined AS (SELECT query_id, coalesce(rr, 0) AS rr, coalesce(dcg, 0) AS dcg, coalesce(retrieved, 0) AS retrieved, coalesce(found, 0) AS found, coalesce(relevant, 0) AS relevant FROM by_query FULL JOIN wants USING (query_id)),
per AS (SELECT *, CASE WHEN retrieved = 0 THEN 0.0 ELSE found / retrieved::DOUBLE END::DOUBLE AS p, CASE WHEN relevant = 0 THEN 1.0 ELSE found / relevant::DOUBLE END::DOUBLE AS r,
  CASE WHEN relevant = 0 THEN 1.0 WHEN least(relevant, retrieved) = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, least(relevant, retrieved) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) END::DOUBLE AS ndcg,
  CASE WHEN length(text) < 250 THEN 'short' ELSE 'long' END AS length, CASE relevant WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS hops FROM joined JOIN benchmark ON item_id = query_id),
sums AS (SELECT length, hops, count(*) AS queries, round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r, round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS macro_f, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
  sum(found) AS found, sum(retrieved) AS retrieved, sum(relevant) AS relevant FROM per GROUP BY GROUPING SETS ((length), (hops), ())),
micro AS (SELECT *, CASE WHEN retrieved = 0 THEN 0.0 ELSE found / retrieved::DOUBLE END::DOUBLE AS mp, CASE WHEN relevant = 0 THEN 1.0 ELSE found / relevant::DOUBLE END::DOUBLE AS mr FROM sums)
SELECT length, hops, queries, macro_p, macro_r, macro_f, mrr, ndcg, round(mp, 6) AS micro_p, round(mr, 6) AS micro_r, round(CASE WHEN mp + mr = 0 THEN 0.0 ELSE 2 * mp * mr / (mp + mr) END, 6)::DOUBLE AS micro_f FROM micro""",
    "m24_gold_conflicts": f"""WITH {_EIDS},
scored AS (SELECT query_id, lo, hi, lo IN (SELECT evidence_id FROM ids i WHERE i.query_id = mapped.query_id) AND hi IN (SELECT evidence_id FROM ids i WHERE i.query_id = mapped.query_id)
  AND (lo <> hi OR EXISTS (SELECT 1 FROM want w WHERE w.query_id = mapped.query_id AND w.lo = mapped.lo AND w.hi = mapped.hi)) AS ok FROM mapped),
both_ AS (SELECT query_id, s.ok AS ok, s.query_id IS NOT NULL AS said, w.query_id IS NOT NULL AS real FROM scored s FULL JOIN (SELECT DISTINCT query_id, lo, hi FROM want) w USING (query_id, lo, hi))
SELECT query_id, count(*) FILTER (WHERE ok AND real) AS tp, count(*) FILTER (WHERE ok AND NOT real) AS fp, count(*) FILTER (WHERE real AND NOT coalesce(ok, false)) AS fn, count(*) FILTER (WHERE NOT ok) AS extraneous FROM both_ GROUP BY 1""",
    "m25_mapped_conflicts": f"WITH {_EIDS} SELECT query_id, lo, hi FROM mapped",
    "u18_repaired_answers": """SELECT status, count(*) AS n, round(avg((1 - l_discount) * f), 6) AS confidence FROM (SELECT l_discount, CASE l_returnflag WHEN 'R' THEN 'refuted' WHEN 'A' THEN 'supported' ELSE 'not_enough_info' END AS status,
  (CASE l_returnflag WHEN 'R' THEN 0.3 WHEN 'A' THEN 1.0 ELSE 0.6 END)::DOUBLE AS f FROM lineitem) GROUP BY 1""",
    "u22_final_confidence": f"""WITH {_RESULTS}, r AS (SELECT doc_id, toxic, greatest(0, least(1, 0.34::DOUBLE * confidence + 0.24::DOUBLE * least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) + 0.18::DOUBLE * (NOT toxic)::INT + 0.14::DOUBLE * (CASE WHEN difficulty = 'easy' THEN 1.0 ELSE 0.5 END)::DOUBLE + 0.10::DOUBLE * 0.5::DOUBLE)) AS raw FROM results)
SELECT doc_id, round(CASE WHEN toxic THEN least(raw, 0.4) ELSE raw END, 8)::DOUBLE AS confidence, CASE WHEN toxic AND raw > 0.4::DOUBLE THEN 'toxic' ELSE '' END AS caps FROM r""",
    "x7_claim_contrasts": """SELECT regexp_matches(low, '(^|[^a-z])(not|no|never|cannot|false)([^a-z]|$)') AS negated, contains(low, 'all ') AS broad, contains(low, 'only ') OR contains(low, 'some ') AS narrow, count(*) AS n
FROM (SELECT lower(unnest(string_split(text, chr(10)))) AS low FROM documents) GROUP BY 1, 2, 3""",
}
