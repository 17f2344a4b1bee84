"""Queries of plans, of sentences that answer, of rounds of annotation, and of stored results scored again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..operators import annotation, planning, rescoring, sentences
from ..operators.metrics import bag_f1
from ..scratch import saved
from .benchmarking import hits
from .evaluation import _ANSWERS, _words, answers
from .retrieval import _INDEX, bm25_sql

LONG = r"[\p{L}\p{N}_]{7,}"
#: A step is covered by so many documents.
ENOUGH = 5


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    """A plan for each item: by its first long words, or itself where it has only one of them."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LONG), F.lit(0))), 1, planning.KEYWORDS)
    items = _table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), words.alias("words"))
    return planning.decomposed(items, F.col("question"), F.col("words"), F.size("words") <= 1, F.lit(False))


def plan_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of each item's plan, revised by what the documents say, and their levels."""
    plans = _plans(spark, sf)
    asked = plans.filter(F.size("words") > 1).select("item_id", F.posexplode("words").alias("place", "word"))
    docs = _table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    bad = _table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    found = docs.join(asked, "word").join(bad, "doc_id", "left")
    tally = found.groupBy("item_id", "place", "lang").agg(F.count("*").alias("n"), F.count("bad").alias("told"), F.sum("bad").alias("bad"))
    tally = asked.select("item_id", "place").join(tally, ["item_id", "place"], "left")
    by_lang = tally.groupBy("item_id", "lang").agg(F.sum("n").alias("n"))
    langs = by_lang.groupBy("item_id").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.collect_set("lang").alias("langs"))
    by_step = tally.groupBy("item_id", "place").agg(F.least(F.coalesce(F.sum("n"), F.lit(0)), F.lit(ENOUGH)).alias("n"), F.sum("told").alias("told"), F.sum("bad").alias("bad"))
    report = by_step.groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"] / ENOUGH).alias("coverage"),
        (1 - F.sum("n") / (ENOUGH * F.count("*"))).alias("retrieval"),
        F.coalesce(F.sum("bad") / F.nullif(F.sum("told"), F.lit(0)), F.lit(0.0)).alias("source"),
    )
    report = report.join(langs, "item_id").withColumn("conflict", F.coalesce(1 - F.col("most") / F.col("all"), F.lit(0.0)))
    rows = plans.join(report, "item_id", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = planning.covered(rows, F.coalesce("coverage", F.array().cast("array<double>")))
    rows = planning.revised(rows, part("retrieval"), part("conflict"), part("source"), F.col("langs"))
    steps = saved(planning.steps_of(rows, "item_id"), "steps")
    placed = steps.join(planning.levels(steps, "item_id"), ["item_id", "id"])
    return placed.select("item_id", "place", "id", "level", "evidence", "status", F.round("coverage", 6).alias("coverage"), F.array_join("deps", ",").alias("deps"), F.md5("question").alias("question"))


def ranked_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The three best sentences for each item, of the five documents that BM25 ranks first."""
    items = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    texts = _table(spark, sf, "documents").select("doc_id", F.lit("").alias("title"), "text")
    found = sentences.ranked(items, hits(spark, sf, 5).join(texts, "doc_id"), 3)
    return found.select("query_id", "rank", "doc_id", "score", F.md5("sentence").alias("digest"))


ANNOTATORS = ["ann", "ben", "cy"]


def _round(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled documents as items that three annotators label by what the tables say, some of them against the rules, and an adjudicator those of even id."""
    rows = _table(spark, sf, "labels").join(_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    k = F.col("doc_id")
    ids = F.array(F.concat(k, F.lit(":a")), F.concat(k, F.lit(":b")))
    kind = lambda i: F.get(F.array(*map(F.lit, annotation.KINDS)), F.pmod(i, F.lit(6)).cast("int"))
    labels = None
    for name, told, present, of in (("ann", F.lit(True), F.col("toxic") == 1, k), ("ben", F.lit(True), F.col("quality") == 0, k + F.pmod("n_chars", F.lit(2))), ("cy", k % 3 != 0, (F.col("toxic") == 1) | (F.col("n_chars") < 300), k)):
        pair = F.when(present, F.when((k % 25 == 7) & (name == F.lit("ann")), F.slice(ids, 1, 1)).otherwise(ids))
        said = F.when(present, F.when((k % 25 == 9) & (name == F.lit("ben")), "bogus").otherwise(kind(of))).otherwise(annotation.NONE)
        own = rows.filter(told).select(k.alias("item_id"), F.lit(name).alias("annotator_id"), present.alias("present"), said.alias("kind"), pair.alias("pair"))
        labels = own if labels is None else labels.unionByName(own)
    rulings = rows.filter(k % 2 == 0).select(k.alias("item_id"), F.lit("dee").alias("annotator_id"), (F.col("toxic") == 1).alias("present"), F.when(F.col("toxic") == 1, kind(k)).otherwise(annotation.NONE).alias("kind"), F.when(F.col("toxic") == 1, ids).alias("pair"))
    return labels, rulings, rows.select(k.alias("item_id"), ids.alias("ids"))


def annotation_states(spark: SparkSession, sf: str) -> DataFrame:
    """Where items stand, and which labels break a rule."""
    labels, rulings, evidence = _round(spark, sf)
    told = annotation.states(labels, rulings, evidence).groupBy("state", F.coalesce("final", F.lit("")).alias("final"), "labels").agg(F.count("*").alias("n"))
    broken = annotation.judged(labels, evidence).select("annotator_id", F.explode("broken").alias("rule")).groupBy("annotator_id", "rule").agg(F.count("*").alias("n"))
    return told.unionByName(broken.select(F.col("annotator_id").alias("state"), F.col("rule").alias("final"), F.lit(0).cast("long").alias("labels"), "n"))


def annotation_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Cohen's kappa of each two annotators over their labels that break no rule."""
    labels, _, evidence = _round(spark, sf)
    good = annotation.judged(labels, evidence).filter(F.size("broken") == 0).withColumn("answer", annotation.answer())
    found = annotation.agreement(good, ANNOTATORS)
    return found.select("a", "b", "items", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def rescored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of conversations stored with the scores of an older metric, which counted articles as words; some failed, some of their questions have changed since."""
    pairs = saved(answers(spark, sf), "answers")
    k = F.col("qa_id")
    sign = rescoring.signature(F.col("question"))
    old = bag_f1(pairs.select("qa_id", tokens(F.col("answer")).alias("a"), tokens(F.col("question")).alias("b")), "qa_id", "a", "b")
    stored = pairs.join(old, "qa_id").select(
        k.alias("row_id"), F.when(k % 40 == 3, -k - 1).otherwise(k).alias("question_id"), F.when(k % 10 == 1, "older").otherwise(sign).alias("signature"), F.col("answer").alias("predicted"),
        F.when(k % 5 == 0, "abstain").otherwise("answer").alias("behaviour"), F.when(k % 20 == 2, "timeout").alias("error"), F.lit("1").alias("version"),
        (F.lower("answer") == F.lower("question")).cast("double").alias("em"), "f1", (F.col("f1") > rescoring.CORRECT).alias("correct"),
    )
    questions = pairs.select(k.alias("question_id"), sign.alias("signature"), F.col("question").alias("truth"), F.when(k % 15 == 0, "unanswerable").otherwise("single").alias("kind"))
    return rescoring.changes(rescoring.rescored(stored, questions))


_ROUND = f"""rows AS (SELECT doc_id AS k, toxic = 1 AS toxic, quality = 0 AS bad, n_chars FROM labels JOIN documents USING (doc_id)),
said AS (
  SELECT k, 'ann' AS who, toxic AS present, k % 6 AS i, toxic AND k % 25 = 7 AS one, false AS bogus FROM rows
  UNION ALL SELECT k, 'ben', bad, (k + n_chars % 2) % 6, false, bad AND k % 25 = 9 FROM rows
  UNION ALL SELECT k, 'cy', toxic OR n_chars < 300, k % 6, false, false FROM rows WHERE k % 3 <> 0),
good AS (SELECT k, who, CASE WHEN present THEN {list(annotation.KINDS)}[i + 1] ELSE 'none' END AS answer FROM said WHERE NOT one AND NOT bogus)"""

QUERIES = {
    "u3_plan_levels": plan_levels,
    "u20_sentences": ranked_sentences,
    "p6_annotation_states": annotation_states,
    "p6_annotation_agreement": annotation_agreement,
    "p1_rescored": rescored_runs,
}
_BAG = """, {0}s AS (SELECT qa_id, unnest(a) AS t, 1 AS x, 0 AS y FROM {0}t UNION ALL SELECT qa_id, unnest(b), 0, 1 FROM {0}t),
{0}c AS (SELECT qa_id, t, sum(x) AS x, sum(y) AS y FROM {0}s GROUP BY 1, 2), {0}z AS (SELECT qa_id, sum(x) AS x, sum(y) AS y, sum(least(x, y)) AS c FROM {0}c GROUP BY 1),
{0}f AS (SELECT qa_id, CASE WHEN x IS NULL THEN 1 WHEN x = 0 OR y = 0 OR c = 0 THEN 0 ELSE 2.0::DOUBLE * c / (x + y) END::DOUBLE AS f1 FROM {0}t LEFT JOIN {0}z USING (qa_id))"""
ORACLES = {
    "p1_rescored": f"""WITH {_ANSWERS},
ot AS (SELECT qa_id, regexp_extract_all(lower(answer), '{TOKEN}') AS a, regexp_extract_all(lower(question), '{TOKEN}') AS b FROM answers){_BAG.format('o')},
nt AS (SELECT qa_id, {_words('answer')} AS a, {_words('question')} AS b FROM answers){_BAG.format('n')},
r AS (SELECT qa_id AS k, ofs.f1 AS old_f1, nfs.f1 AS new_f1, (lower(answer) = lower(question))::INT::DOUBLE AS old_em, (array_to_string(a, ' ') = array_to_string(b, ' '))::INT::DOUBLE AS new_em,
  CASE WHEN qa_id % 20 = 2 THEN 'error' WHEN qa_id % 40 = 3 THEN 'orphan' WHEN qa_id % 10 = 1 THEN 'stale' END AS left_
  FROM answers JOIN of ofs USING (qa_id) JOIN nf nfs USING (qa_id) JOIN nt USING (qa_id)),
q AS (SELECT *, old_f1 > 0.3 AS was, (k % 15 = 0 AND k % 5 = 0) OR new_f1 > 0.3 AS now FROM r),
w AS (SELECT coalesce(left_, CASE WHEN abs(old_f1 - new_f1) > 1e-9 OR old_em <> new_em OR was <> now THEN 'changed' ELSE 'same' END) AS state, CASE WHEN left_ IS NULL THEN '2' ELSE '1' END AS version,
  old_f1, CASE WHEN left_ IS NULL THEN new_f1 ELSE old_f1 END AS f1, old_em, CASE WHEN left_ IS NULL THEN new_em ELSE old_em END AS em, was, CASE WHEN left_ IS NULL THEN now ELSE was END AS now FROM q)
SELECT state, version, count(*) AS n, round(avg(old_f1), 6) AS old_f1, round(avg(f1), 6) AS f1, round(avg(old_em), 6) AS old_em, round(avg(em), 6) AS em, count(*) FILTER (WHERE now AND NOT was) AS righted,
  count(*) FILTER (WHERE was AND NOT now) AS wronged FROM w GROUP BY 1, 2""",
    "u20_sentences": rf"""WITH {_INDEX}, {bm25_sql('hits', 5)},
terms AS (SELECT item_id AS query_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: length(t) >= 2), lambda t: lower(t))) AS ts FROM benchmark),
said AS (SELECT query_id, h.rank AS of_, doc_id, u.i AS place, u.s AS s FROM hits h JOIN (SELECT doc_id, unnest(list_transform(range(1, len(p) + 1), lambda i: {{'i': i, 's': regexp_replace(p[i], '^\s+|\s+$', '', 'g')}})) AS u
  FROM (SELECT doc_id, regexp_extract_all(text, '[^{sentences.ENDS}]*[{sentences.ENDS}]|[^{sentences.ENDS}]+') AS p FROM documents)) USING (doc_id) WHERE u.s <> ''),
scored AS (SELECT *, len(list_filter(ts, lambda t: contains(lower(s), t))) + CASE WHEN regexp_matches(s, '[0-9]') THEN 0.25 ELSE 0 END + CASE WHEN list_bool_or(list_transform({list(sentences.APPROXIMATE)}, lambda w: contains(lower(s), w))) THEN 0.25 ELSE 0 END AS score FROM said JOIN terms USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, of_, doc_id, place)::INT AS rank FROM scored WHERE score > 0)
SELECT query_id, rank, doc_id, score::DOUBLE AS score, md5(s) AS digest FROM ranked WHERE rank <= 3""",
    "p6_annotation_states": f"""WITH {_ROUND},
tally AS (SELECT k, count(*) AS n, min(answer) AS low, max(answer) AS high FROM good GROUP BY 1),
told AS (SELECT k, coalesce(n, 0) AS labels, CASE WHEN coalesce(n, 0) < 2 THEN 'open' WHEN k % 2 = 0 THEN 'adjudicated' WHEN low = high THEN 'agreed' ELSE 'disputed' END AS state, low,
  CASE WHEN toxic THEN {list(annotation.KINDS)}[k % 6 + 1] ELSE 'none' END AS ruling FROM rows LEFT JOIN tally USING (k))
SELECT state, CASE state WHEN 'adjudicated' THEN ruling WHEN 'agreed' THEN low ELSE '' END AS final, labels, count(*) AS n FROM told GROUP BY 1, 2, 3
UNION ALL SELECT who, CASE WHEN one THEN 'pair_of_two' ELSE 'kind_of_conflict' END, 0, count(*) FROM said WHERE one OR bogus GROUP BY 1, 2""",
    "p6_annotation_agreement": f"""WITH {_ROUND},
both_ AS (SELECT x.who AS a, y.who AS b, x.answer AS p, y.answer AS q FROM good x JOIN good y ON x.k = y.k AND x.who < y.who),
seen AS (SELECT a, b, count(*) AS items, count(*) FILTER (WHERE p = q) / count(*)::DOUBLE AS observed FROM both_ GROUP BY 1, 2),
ps AS (SELECT a, b, p AS v, count(*) AS n FROM both_ GROUP BY 1, 2, 3), qs AS (SELECT a, b, q AS v, count(*) AS m FROM both_ GROUP BY 1, 2, 3),
chance AS (SELECT a, b, sum(n * m)::DOUBLE AS c FROM ps JOIN qs USING (a, b, v) GROUP BY 1, 2)
SELECT a, b, items, round(observed, 6) AS observed, round(c / (items * items), 6) AS expected, round((observed - c / (items * items)) / (1 - c / (items * items)), 6) AS kappa FROM seen JOIN chance USING (a, b)""",
    "u3_plan_levels": f"""WITH RECURSIVE
items AS (SELECT item_id, text, w[1:5] AS w FROM (SELECT item_id, text, list_filter(w0, lambda x, i: list_position(w0, x) = i) AS w FROM (SELECT item_id, text, regexp_extract_all(lower(text), '{LONG}') AS w0 FROM benchmark))),
words AS (SELECT item_id, len(w) AS k, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'place': i - 1, 'word': w[i]}}), recursive := true) FROM items WHERE len(w) > 1),
docs AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS word FROM documents),
found AS (SELECT item_id, place, lang, 1 - quality AS bad FROM docs JOIN words USING (word) LEFT JOIN labels USING (doc_id)),
cover AS (SELECT item_id, place, any_value(k) AS k, any_value(words.word) AS word, least(count(found.lang), {ENOUGH}) AS n FROM words LEFT JOIN found USING (item_id, place) GROUP BY 1, 2),
sure AS (SELECT item_id, any_value(k) AS k, 1 - sum(n) / ({ENOUGH} * count(*))::DOUBLE AS retrieval FROM cover GROUP BY 1),
langs AS (SELECT item_id, 1 - max(n) / sum(n)::DOUBLE AS conflict, list_sort(list(lang)) AS langs FROM (SELECT item_id, lang, count(*) AS n FROM found GROUP BY 1, 2) GROUP BY 1),
bad AS (SELECT item_id, sum(bad) / nullif(count(bad), 0)::DOUBLE AS source FROM found GROUP BY 1),
base AS (
  SELECT item_id, 0 AS place, 'general' AS evidence, 0.0::DOUBLE AS coverage, text AS question, []::BIGINT[] AS deps, 'pending' AS status FROM items WHERE len(w) <= 1
  UNION ALL SELECT item_id, place, 'general', n / {ENOUGH}.0::DOUBLE, '{planning.ABOUT[0].replace("'", "''")}' || word || '{planning.ABOUT[1].replace("'", "''")}', [],
    CASE WHEN n >= 4 THEN 'resolved' WHEN retrieval > 0.5 AND n < 2.5 THEN 'in_progress' ELSE 'pending' END FROM cover JOIN sure USING (item_id)
  UNION ALL SELECT item_id, len(w), 'synthesis', 0.0::DOUBLE, text, range(len(w)), CASE WHEN retrieval > 0.5 THEN 'in_progress' ELSE 'pending' END FROM items JOIN sure USING (item_id)),
resolve AS (SELECT item_id, unnest(list_transform(range(1, len(langs) + 1), lambda i: {{'r': i - 1, 'lang': langs[i]}}), recursive := true) FROM langs WHERE conflict > 0.5),
open_ AS (SELECT item_id, list_sort(list(place::BIGINT) FILTER (WHERE status <> 'resolved')) AS places, max(place) + 1 AS size FROM base GROUP BY 1),
asked AS (SELECT * FROM base
  UNION ALL SELECT item_id, size + r, 'general', 0.0::DOUBLE, '{planning.RESOLVE[0]}' || lang || '{planning.RESOLVE[1]}', list_concat(places, range(size, size + r)), 'pending' FROM resolve JOIN open_ USING (item_id) WHERE size + r < {planning.MOST}),
all_ AS (SELECT * FROM asked
  UNION ALL SELECT item_id, n, 'empirical_study', 0.0::DOUBLE, '{planning.VERIFY}', range(least(n, 3)), 'pending' FROM (SELECT item_id, count(*) AS n FROM asked GROUP BY 1) JOIN bad USING (item_id) WHERE source > 0.5 AND n < {planning.MOST}),
edges AS (SELECT item_id, place, unnest(deps) AS dep FROM all_),
lv AS (SELECT item_id, place, 0 AS level FROM all_ WHERE len(deps) = 0 UNION SELECT e.item_id, e.place, level + 1 FROM edges e JOIN lv ON e.item_id = lv.item_id AND e.dep = lv.place),
top AS (SELECT item_id, place, max(level) AS level FROM lv GROUP BY 1, 2)
SELECT item_id, place::INT AS place, 'sq' || place AS id, level::INT AS level, evidence, status, round(coverage, 6) AS coverage, array_to_string(list_transform(deps, lambda d: 'sq' || d), ',') AS deps, md5(trim(question)) AS question FROM all_ JOIN top USING (item_id, place)""",
}
