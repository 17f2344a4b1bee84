"""Queries of texts alike and of where they match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import names
from ..operators import anchors, audit, similarity
from ..scratch import saved
from .knowledge import _NEAR, overlap

ENDS = r"[.!?\n]+"
LEAST_CHARS = 10


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _claims(rows: DataFrame, key: str) -> DataFrame:
    """(id, key, claim): the sentences of texts, in lower case; the id is the text's and the sentence's place."""
    parts = F.transform(F.split(F.lower("text"), ENDS), F.trim)
    claims = rows.select(key, F.posexplode(parts).alias("place", "claim")).filter(F.length("claim") >= LEAST_CHARS)
    return claims.select(F.concat_ws("#", key, "place").alias("id"), key, "claim")


def _support(spark: SparkSession, sf: str, pairs) -> DataFrame:
    items, docs = _claims(_table(spark, sf, "benchmark"), "item_id"), _claims(_table(spark, sf, "documents"), "doc_id")
    found = pairs(items, "id", "claim", docs).withColumn("doc_id", F.split("b", "#")[0])
    return found.groupBy(F.col("a").alias("claim_id")).agg(F.count("*").alias("claims"), F.countDistinct("doc_id").alias("documents"), F.round(F.max("similarity"), 6).alias("best"), F.round(F.min("similarity"), 6).alias("least"))


def support(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of items that claims of documents support, by the bigrams of both, whatever entities they name."""
    return _support(spark, sf, similarity.sets_alike)


def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The same by matching blocks as well."""
    return _support(spark, sf, similarity.alike)


def near_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """For each near finding, where in the document most of the item's grams lie, and the text there."""
    items, docs = audit.normalised(_table(spark, sf, "benchmark"), "item_id"), _table(spark, sf, "documents").select("doc_id", "text")
    pairs = saved(overlap(spark, sf).near().select("item_id", "doc_id"), "near")
    return audit.near_excerpts(pairs, items, docs)


def script_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names in documents by language, hyphens and digits taken as spaces."""
    found = _table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(names(F.regexp_replace("text", "[-0-9]", " "))).alias("name"))
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("name").alias("names"), F.max("name").alias("last"))


def title_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """How often documents mention the titles of pages, the longest title where several begin, whole words only; a title is a page's heading's first two words."""
    heading = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    titles = _table(spark, sf, "pages").select(F.array_join(F.slice(F.regexp_extract_all(heading, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, 2), " ").alias("name")).filter(F.length("name") >= 8)
    found = anchors.mentions(_table(spark, sf, "documents"), "doc_id", "text", titles)
    return found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.min("start").alias("first"))


_GRAMS = "list_distinct(list_transform(range(1, length(claim)), lambda i: claim[i:i + 1]))"
_CLAIMS = f"""items AS (SELECT item_id || '#' || (u.i - 1) AS id, u.t AS claim FROM (SELECT item_id, unnest(list_transform(range(1, len(p) + 1), lambda i: {{'i': i, 't': trim(p[i])}})) AS u
  FROM (SELECT item_id, regexp_split_to_array(lower(text), '{ENDS}') AS p FROM benchmark)) WHERE length(u.t) >= {LEAST_CHARS}),
claims AS (SELECT doc_id, trim(unnest(regexp_split_to_array(lower(text), '{ENDS}'))) AS claim FROM documents),
ig AS (SELECT id, {_GRAMS} AS g FROM items), dg AS (SELECT claim, any_value({_GRAMS}) AS g FROM claims WHERE length(claim) >= {LEAST_CHARS} GROUP BY 1)"""

QUERIES = {
    "j18_support": support,
    "j6_text_similarity": text_similarity,
    "a5_near_excerpts": near_excerpts,
    "x1_script_names": script_names,
    "x17_title_mentions": title_mentions,
}
ORACLES = {
    "x1_script_names": r"""WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(list_distinct(list_concat(
  list_filter(regexp_extract_all(regexp_replace(text, '[-0-9]', ' ', 'g'), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[A-Z][a-z]+')), list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda t: regexp_full_match(t, '[A-Z]{2,}'))))) AS name FROM documents)
SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS documents, count(DISTINCT name) AS names, max(name) AS last FROM t GROUP BY 1""",
    "a5_near_excerpts": rf"""WITH {_NEAR},
pairs AS (SELECT item_id, doc_id FROM near WHERE score >= 0.85),
asked AS (SELECT item_id, greatest(length(body), 13) AS win, g FROM items JOIN ig USING (item_id) WHERE item_id IN (SELECT item_id FROM pairs)),
found AS (SELECT doc_id, unnest(list_transform(range(0, length(body) - 12), lambda i: {{'pos': i, 'gram': substring(body, i + 1, 13)}}), recursive := true) FROM docs WHERE doc_id IN (SELECT doc_id FROM pairs)),
hits AS (SELECT item_id, doc_id, pos, win FROM pairs JOIN (SELECT item_id, win, unnest(g) AS gram FROM asked) USING (item_id) JOIN found USING (doc_id, gram)),
sized AS (SELECT *, count(*) OVER w AS n, min(pos) OVER w AS low FROM hits WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY pos RANGE BETWEEN win PRECEDING AND CURRENT ROW)),
best AS (SELECT item_id, doc_id, arg_min({{'n': n, 'low': low, 'last': pos, 'win': win}}, (-n * 1000000000 + pos)) AS b FROM sized GROUP BY 1, 2),
placed AS (SELECT item_id, doc_id, coalesce(b.n, 0) AS hits, coalesce(b.low, 0) AS low, coalesce(least(length(body), greatest(b.low + b.win, b.last + 13)), length(body)) AS high FROM pairs LEFT JOIN best USING (item_id, doc_id) JOIN docs USING (doc_id)),
texts AS (SELECT doc_id, text, list_filter(range(0, length(text)), lambda i: regexp_matches(text[i + 1], '[\p{{L}}\p{{N}}]')) AS places FROM documents WHERE doc_id IN (SELECT doc_id FROM pairs)),
own AS (SELECT item_id, doc_id, hits, text, places[low + 1] AS s, places[high] + 1 AS e, length(text) AS size FROM placed JOIN texts USING (doc_id)),
cut AS (SELECT *, greatest(0, least(size, greatest(0, s - greatest(0, floor((160 - (e - s)) / 2)::BIGINT)) + 160) - 160) AS lo, least(size, greatest(0, s - greatest(0, floor((160 - (e - s)) / 2)::BIGINT)) + 160) AS hi FROM own)
SELECT item_id, doc_id, hits::INT AS hits, s::INT AS start, e::INT AS "end", CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, lo + 1, hi - lo), '\s+', ' ', 'g')) || CASE WHEN hi < size THEN '…' ELSE '' END AS excerpt FROM cut""",
    "j18_support": f"""WITH {_CLAIMS},
both_ AS (SELECT id, claim, len(list_intersect(ig.g, dg.g)) AS n, len(ig.g) + len(dg.g) AS m FROM ig JOIN dg ON len(ig.g) <= len(dg.g) / 0.84 AND len(dg.g) <= len(ig.g) / 0.84)
SELECT id AS claim_id, count(*) AS claims, count(DISTINCT doc_id) AS documents, round(max(n / (m - n)::DOUBLE), 6) AS best, round(min(n / (m - n)::DOUBLE), 6) AS least
FROM both_ JOIN claims USING (claim) WHERE n / (m - n)::DOUBLE >= 0.85::DOUBLE GROUP BY 1""",
}
