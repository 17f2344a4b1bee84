"""Queries of reranking, iterative retrieval, behaviour, annotation and dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import control, scorers, stats
from ..operators import metrics as m
from .benchmarking import hits
from .evaluation import _RESULTS, results
from .retrieval import _INDEX, bm25_sql

ABSTAINS = r"(cannot|unknown|no evidence|not enough|unclear)"
CORRECTS = r"(actually|in fact|not true|false)"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs_and_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _table(spark, sf, "documents"), _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = _docs_and_items(spark, sf)
    return scorers.rerank(scorers.with_texts(hits(spark, sf, 20), docs, items).withColumn("model_score", scorers.overlap()), 5)


def dynamic(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = _docs_and_items(spark, sf)
    return scorers.dynamic(docs, items)


def policy_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Depth by the kind of item: two for short ones, four for those with a digit, five for the rest."""
    _, items = _docs_and_items(spark, sf)
    depth = F.when(F.length("query") < 150, 2).when(F.col("query").rlike("[0-9]"), 4).otherwise(5)
    return hits(spark, sf, 5).join(items.select("query_id", depth.cast("long").alias("depth")), "query_id").filter("rank <= depth").groupBy("depth").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("items"))


def behaviours(spark: SparkSession, sf: str) -> DataFrame:
    """What an assistant's turn does: abstain, correct a premise, or answer; the first that applies."""
    low = F.lower("text")
    kind = F.when(low.rlike(ABSTAINS), "abstain").when(low.rlike(CORRECTS), "correct_premise").otherwise("answer")
    return _table(spark, sf, "conversations").filter("role = 'assistant'").groupBy(kind.alias("behaviour")).agg(F.count("*").alias("n"))


def set_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Macro and micro precision and recall by order status: retrieved are an order's accepted lines, relevant those of 25 or more."""
    lines = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 25)).alias("hit"), F.count_if(F.col("l_returnflag") == "A").alias("got"), F.count_if(F.col("l_quantity") >= 25).alias("want")
    )
    rows = _table(spark, sf, "orders").join(lines, "o_orderkey")
    hit = F.col("hit").cast("double")
    return rows.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"),
        F.round(F.avg(m.ratio(hit, F.col("got"))), 6).alias("macro_p"),
        F.round(F.avg(m.ratio(hit, F.col("want"), 1.0)), 6).alias("macro_r"),
        F.round(m.ratio(F.sum(hit), F.sum("got")), 6).alias("micro_p"),
        F.round(m.ratio(F.sum(hit), F.sum("want"), 1.0), 6).alias("micro_r"),
    )


def cap_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """How often each cap of the confidence applies and how sure those results were."""
    caps = F.array_compact(F.array(F.when(F.col("toxic"), "toxic"), F.when(F.col("n_chars") < 500, "short"), F.when(F.col("difficulty") == "hard", "hard")))
    rows = results(spark, sf).select("confidence", "correct", F.explode_outer(caps).alias("cap"))
    return rows.groupBy(F.coalesce("cap", F.lit("none")).alias("cap")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def composite(spark: SparkSession, sf: str) -> DataFrame:
    """Five shares of a type's results as one score, weighted .25, .30, .20, .15 and .10."""
    share = lambda c: F.avg(c.cast("double"))
    parts = [share(F.col("correct")), share(~F.col("toxic")), F.avg("confidence"), share(F.col("difficulty") == "easy"), share(F.col("n_chars") < 10000)]
    return results(spark, sf).groupBy("type").agg(F.round(control.overall(*parts), 6).alias("score"))


def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score and accuracy of both halves of the hash split and of all."""
    split = stats.hash_split(results(spark, sf), "doc_id", "type", 0.5)
    return split.rollup("part").agg(F.count("*").alias("n"), F.round(m.brier(), 6).alias("brier"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")).withColumn("part", F.coalesce("part", F.lit("all")))


def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by source: texts, distinct ones, and how many occur in another source too."""
    docs = _table(spark, sf, "documents").select("source", F.md5("text").alias("digest"))
    spread = docs.groupBy("digest").agg(F.countDistinct("source").alias("sources"))
    return docs.join(spread, "digest").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("texts"), F.count_if(F.col("sources") > 1).alias("shared"))


def difficulty_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose difficulty breaks a rule: hard but short of words, easy but toxic."""
    rows = results(spark, sf)
    found = rows.filter("difficulty = 'hard' and confidence < 0.7").select("doc_id", F.lit("hard_low").alias("rule")).unionByName(rows.filter("difficulty = 'easy' and toxic").select("doc_id", F.lit("easy_toxic").alias("rule")))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Two annotators' calls on each text (letters, length), gold where they agree and else the label: how often gold overrides one."""
    rows = results(spark, sf).select("type", (F.col("confidence") >= 0.79).alias("a"), (F.col("n_chars") >= 1200).alias("b"), "correct")
    rows = rows.withColumn("gold", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("correct")))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreed"), F.count_if(F.col("a") != F.col("gold")).alias("over_a"), F.count_if(F.col("b") != F.col("gold")).alias("over_b"))


def numbers_with_units(spark: SparkSession, sf: str) -> DataFrame:
    """Part names and sizes as measured numbers: size in its class, the price in whole hundreds."""
    part = _table(spark, sf, "part").select(F.format_string("%d mm", "p_size").alias("s"), F.format_string("%.1f usd", "p_retailprice").alias("p"))
    parsed = part.select(F.explode(F.array("s", "p")).alias("raw")).select(F.expr("try_cast(regexp_extract(raw, '^([0-9.]+)', 1) as double)").alias("value"), F.regexp_extract("raw", " ([a-z]+)$", 1).alias("unit"))
    return parsed.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


def _cited_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each order that cites the suppliers of returned lines; its claims rest on all, its evidence holds those with little discount."""
    sid = F.concat(F.lit("S"), "l_suppkey")
    rows = _table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("o"), sid.alias("sid"), (F.col("l_returnflag") == "R").alias("cites"), (F.col("l_discount") < 0.05).alias("here"))
    by = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("o", "sid", "cites", "here"))).alias("rows"))
    ids = lambda keep: F.transform(F.filter("rows", keep), lambda x: x["sid"])
    cites = F.array_join(F.transform(ids(lambda x: x["cites"]), lambda e: F.concat(F.lit(" ["), e, F.lit("]"))), "")
    answer = F.concat(F.lit("Order "), "l_orderkey", F.lit(" was shipped"), cites)
    return by.select("l_orderkey", answer.alias("answer"), ids(lambda x: F.lit(True)).alias("supports"), F.array_distinct(ids(lambda x: x["here"])).alias("available"))


def citation_footer(spark: SparkSession, sf: str) -> DataFrame:
    return _cited_answers(spark, sf).select("l_orderkey", control.with_citations(F.col("answer"), F.col("supports"), F.col("available")).alias("answer"))


def citation_sync(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cited_answers(spark, sf).select("l_orderkey", control.synced(F.col("answer"), F.col("supports"), F.col("available")).alias("s"))
    joined = lambda c: F.array_join(f"s.{c}", " ").alias(c)
    return rows.select("l_orderkey", joined("support"), joined("dropped"), joined("added_support"), joined("added_citations"))


def conflict_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one brand, type and size whose prices differ: the answer names both where it does not speak of a conflict."""
    part = _table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("entity"), F.format_string("%.2f", "p_retailprice").alias("price"))
    ends = part.groupBy("entity").agg(F.min(F.struct("p_partkey", "price")).alias("a"), F.max(F.struct("p_partkey", "price")).alias("b"))
    differ = F.col("a.price") != F.col("b.price")
    answer = F.when(F.col("a.p_partkey") % 2 == 0, F.lit("价格存在争议")).otherwise(F.concat(F.lit("it costs "), "a.price"))
    side = lambda x: (F.when(differ, F.concat(F.lit("P"), f"{x}.p_partkey")), F.concat("entity", F.lit(" costs "), f"{x}.price"))
    (s, sc), (t, tc) = side("a"), side("b")
    return ends.select("entity", control.acknowledged(answer, s, sc, t, tc).alias("answer"))


def anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's first user turn as its question, put first where later turns have left it out."""
    turns = _table(spark, sf, "conversations").filter("role = 'user'")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.min("turn").alias("turn0"), F.count("*").alias("turns"))
    again = turns.join(first, "conv_id").filter("turn > turn0").groupBy("conv_id").agg(F.max(F.contains("text", F.col("question"))).alias("again"))
    return first.join(again, "conv_id", "left").select("conv_id", "turns", (~F.coalesce("again", F.lit(False))).alias("anchored"))


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Settings by user as a table of last values: the newest value of each key."""
    events = _table(spark, sf, "events")
    order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return last.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "value")))).alias("m")).select("user_id", F.size("m").cast("long").alias("settings"), F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


_SYS = f"{_RESULTS}, s AS (SELECT type, confidence >= 0.79 AS a, n_chars >= 1200 AS b, correct FROM results), g AS (SELECT *, CASE WHEN a = b THEN a ELSE correct END AS gold FROM s)"
_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"

_FIRSTS = "list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN list_position({0}, {0}[i]) = i THEN {0}[i] END), lambda e: e IS NOT NULL)"
_CITED = f"""by_order AS (SELECT l_orderkey, list('S' || l_suppkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS every,
  coalesce(list('S' || l_suppkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) FILTER (WHERE l_returnflag = 'R'), []) AS cites,
  coalesce(list('S' || l_suppkey) FILTER (WHERE l_discount < 0.05), []) AS here FROM lineitem GROUP BY 1),
answers AS (SELECT l_orderkey, every, here, {_FIRSTS.format('every')} AS uniq, {_FIRSTS.format('cites')} AS cited, 'Order ' || l_orderkey || ' was shipped' || array_to_string(list_transform(cites, lambda e: ' [' || e || ']'), '') AS answer FROM by_order)"""

QUERIES = {
    "r10_rerank": rerank,
    "r21_dynamic": dynamic,
    "r25_policy_by_type": policy_by_type,
    "m26_behaviours": behaviours,
    "m30_set_summaries": set_summaries,
    "m38_cap_diagnostics": cap_diagnostics,
    "m39_composite": composite,
    "k5_calibration_report": calibration_report,
    "g5_dataset_summary": dataset_summary,
    "g7_difficulty_rules": difficulty_rules,
    "p6_annotations": annotations,
    "x14_numbers_with_units": numbers_with_units,
    "u6_anchored": anchored,
    "u14_citation_footer": citation_footer,
    "u14_conflict_notes": conflict_notes,
    "u21_citation_sync": citation_sync,
    "s18_upsert": upsert,
}
ORACLES = {
    "r10_rerank": f"""WITH {_INDEX}, {bm25_sql('hits', 20)},
t AS (SELECT query_id, h.doc_id, {_TOK.format('b.text')} AS q, {_TOK.format('d.text')} AS c FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
s AS (SELECT query_id, doc_id, round(len(list_intersect(q, c)) / len(q)::DOUBLE, 6) AS score FROM t)
SELECT query_id, place, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 5""",
    "r25_policy_by_type": f"""WITH {_INDEX}, {bm25_sql('hits', 5)}, need AS (SELECT item_id AS query_id, (CASE WHEN length(text) < 150 THEN 2 WHEN regexp_matches(text, '[0-9]') THEN 4 ELSE 5 END)::BIGINT AS depth FROM benchmark)
SELECT depth, count(*) AS n, count(DISTINCT query_id) AS items FROM hits JOIN need USING (query_id) WHERE rank <= depth GROUP BY 1""",
    "m26_behaviours": f"SELECT CASE WHEN regexp_matches(lower(text), '{ABSTAINS}') THEN 'abstain' WHEN regexp_matches(lower(text), '{CORRECTS}') THEN 'correct_premise' ELSE 'answer' END AS behaviour, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "m30_set_summaries": """WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity >= 25) AS hit, count(*) FILTER (WHERE l_returnflag = 'A') AS got, count(*) FILTER (WHERE l_quantity >= 25) AS want FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS n, round(avg(CASE WHEN got = 0 THEN 0 ELSE hit / got::DOUBLE END), 6) AS macro_p, round(avg(CASE WHEN want = 0 THEN 1 ELSE hit / want::DOUBLE END), 6) AS macro_r,
  round(sum(hit)::DOUBLE / sum(got), 6) AS micro_p, round(sum(hit)::DOUBLE / sum(want), 6) AS micro_r FROM orders JOIN l USING (o_orderkey) GROUP BY 1""",
    "m38_cap_diagnostics": f"""WITH {_RESULTS}, c AS (SELECT confidence, correct, unnest(CASE WHEN toxic OR n_chars < 500 OR difficulty = 'hard' THEN list_filter([CASE WHEN toxic THEN 'toxic' END, CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN difficulty = 'hard' THEN 'hard' END], lambda x: x IS NOT NULL) ELSE ['none'] END) AS cap FROM results)
SELECT cap, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy FROM c GROUP BY 1""",
    "m39_composite": f"WITH {_RESULTS} SELECT type, round(0.25::DOUBLE * avg(correct::INT) + 0.30::DOUBLE * avg((NOT toxic)::INT) + 0.20::DOUBLE * avg(confidence) + 0.15::DOUBLE * avg((difficulty = 'easy')::INT) + 0.10::DOUBLE * avg((n_chars < 10000)::INT), 6) AS score FROM results GROUP BY 1",
    "k5_calibration_report": f"""WITH {_RESULTS}, o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY sha256('1729:' || doc_id)) AS r, count(*) OVER (PARTITION BY type) AS n FROM results),
p AS (SELECT *, CASE WHEN r <= greatest(1, least(n - 1, round(n * 0.5::DOUBLE)::BIGINT)) THEN 'calibration' ELSE 'holdout' END AS part FROM o)
SELECT coalesce(part, 'all') AS part, count(*) AS n, round(avg(pow(confidence - correct::INT::DOUBLE, 2)), 6) AS brier, round(avg(correct::INT), 6) AS accuracy FROM p GROUP BY ROLLUP (part)""",
    "g5_dataset_summary": "WITH d AS (SELECT source, md5(text) AS digest FROM documents), s AS (SELECT digest, count(DISTINCT source) AS sources FROM d GROUP BY 1) SELECT source, count(*) AS n, count(DISTINCT digest) AS texts, count(*) FILTER (WHERE sources > 1) AS shared FROM d JOIN s USING (digest) GROUP BY 1",
    "g7_difficulty_rules": f"WITH {_RESULTS}, f AS (SELECT doc_id, 'hard_low' AS rule FROM results WHERE difficulty = 'hard' AND confidence < 0.7 UNION ALL SELECT doc_id, 'easy_toxic' FROM results WHERE difficulty = 'easy' AND toxic) SELECT rule, count(*) AS n, min(doc_id) AS first FROM f GROUP BY 1",
    "p6_annotations": f"WITH {_SYS} SELECT type, count(*) AS n, count(*) FILTER (WHERE a = b) AS agreed, count(*) FILTER (WHERE a <> gold) AS over_a, count(*) FILTER (WHERE b <> gold) AS over_b FROM g GROUP BY 1",
    "x14_numbers_with_units": "SELECT 'mm' AS unit, count(*) AS n, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS most FROM part UNION ALL SELECT 'usd', count(*), round(min(p_retailprice), 1), round(max(p_retailprice), 1) FROM part",
    "u14_citation_footer": f"""WITH {_CITED} SELECT l_orderkey, CASE WHEN len(m) = 0 THEN answer ELSE answer || chr(10) || '{control.FOOTER}' || array_to_string(list_transform(m, lambda e: '[' || e || ']'), ' ') END AS answer
FROM (SELECT *, list_filter(uniq, lambda e: list_contains(here, e) AND NOT list_contains(cited, e)) AS m FROM answers)""",
    "u14_conflict_notes": f"""WITH p AS (SELECT p_partkey AS k, p_brand || ' ' || p_type || ' ' || p_size AS entity, printf('%.2f', p_retailprice) AS price FROM part),
e AS (SELECT entity, min(k) AS ka, min_by(price, k) AS pa, max(k) AS kb, max_by(price, k) AS pb FROM p GROUP BY 1)
SELECT entity, CASE WHEN ka % 2 = 0 THEN '价格存在争议' WHEN pa = pb THEN 'it costs ' || pa ELSE '{control.CONFLICT_NOTE[0]}' || 'P' || ka || '{control.CONFLICT_NOTE[1]}' || (entity || ' costs ' || pa)[1:80] || '{control.CONFLICT_NOTE[2]}' || 'P' || kb ||
  '{control.CONFLICT_NOTE[3]}' || (entity || ' costs ' || pb)[1:80] || '{control.CONFLICT_NOTE[4]}' || 'it costs ' || pa END AS answer FROM e""",
    "u21_citation_sync": f"""WITH {_CITED} SELECT l_orderkey, array_to_string(list_concat(kept, list_filter(valid, lambda e: NOT list_contains(kept, e))), ' ') AS support, array_to_string(list_filter(every, lambda e: NOT list_contains(here, e)), ' ') AS dropped,
  array_to_string(list_filter(valid, lambda e: NOT list_contains(kept, e)), ' ') AS added_support, array_to_string(list_filter(kept, lambda e: NOT list_contains(cited, e)), ' ') AS added_citations
FROM (SELECT *, list_filter(uniq, lambda e: list_contains(here, e)) AS kept, list_filter(cited, lambda e: list_contains(here, e)) AS valid FROM answers)""",
    "u6_anchored": """WITH t AS (SELECT * FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, min_by(text, turn) AS question, min(turn) AS turn0, count(*) AS turns FROM t GROUP BY 1),
a AS (SELECT conv_id, bool_or(contains(text, question)) AS again FROM t JOIN f USING (conv_id) WHERE turn > turn0 GROUP BY 1) SELECT conv_id, turns, NOT coalesce(again, false) AS anchored FROM f LEFT JOIN a USING (conv_id)""",
    "s18_upsert": "SELECT user_id, count(*) AS settings, round(sum(value), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1",
}
