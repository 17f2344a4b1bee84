"""Queries of chunking, evidence, claims, conflicts, audit and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import alnum, numbers, squeezed, years
from ..operators import audit as a
from ..operators import chunking, conflict, evidence, graph, slots

AS_OF = 2024


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# chunking


def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_table(spark, sf, "documents")).select("chunk_id", "doc_id", "chunk_index", F.md5("text").alias("digest"))


def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_table(spark, sf, "documents"), strategy="sentence").select("chunk_id", "doc_id", "chunk_index", F.length("text").alias("n"))


def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_table(spark, sf, "documents"), strategy="paragraph").select("chunk_id", "doc_id", "chunk_index", F.length("text").alias("n"))


def heading_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their heading tags as markdown headings."""
    body = F.regexp_replace(F.regexp_replace("html", r"<h([1-3])[^>]*>", "\n# "), "<[^>]*>", " ")
    pages = _table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), body.alias("text"))
    return chunking.chunk(pages, strategy="heading").select("chunk_id", "doc_id", "chunk_index", F.length("text").alias("n"))


# evidence


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as evidence: priority as source, order date, relevance from the price."""
    source = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 5 == 0, " nature").when(F.col("o_orderkey") % 5 == 1, " blog").otherwise(""))
    rows = _table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        source.alias("source"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.round(evidence.clamp(F.col("o_totalprice") / 500000), 8).alias("relevance"),
        F.col("o_custkey").alias("topic"),
    )
    return rows.withColumns({"credibility": evidence.credibility(F.col("source")), "recency": F.round(evidence.recency(F.col("date"), AS_OF), 6)})


def credibility(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.max("credibility").alias("credibility"))


def recency(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("recency"), 6).alias("recency"))


def quality(spark: SparkSession, sf: str) -> DataFrame:
    score = F.round(evidence.combined(F.col("credibility"), F.col("recency"), F.col("relevance")), 9)
    return _evidence(spark, sf).select("id", score.alias("score")).filter("score >= 0.3")


def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return evidence.exact_dedup(docs, "text", "n_chars", "doc_id").select("doc_id", "n_chars")


def semantic_dedup(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return evidence.greedy_dedup(vectors, evidence.cosine_pairs(vectors, 0.92), "id", "label").select("id", "label")


def graph_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Edges join an order with the customer's next one: support if both have the same status, conflict if not."""
    orders = _table(spark, sf, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(order).alias("b"), (F.col("o_orderstatus") == F.lead("o_orderstatus").over(order)).alias("support"), F.round(F.col("o_totalprice") / 500000, 8).alias("confidence"))
    scored = evidence.graph_scores(_evidence(spark, sf), edges.filter("b is not null"))
    return scored.select("id", F.round("support", 6).alias("support"), F.round("conflict", 9).alias("conflict"), F.round("score", 9).alias("score"))


def ranked_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The three best pieces of evidence for each topic."""
    score = F.round(evidence.combined(F.col("credibility"), F.col("recency"), F.col("relevance")), 9)
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "id")
    rows = _evidence(spark, sf).withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.filter("rank <= 3").select("topic", "rank", "id", "score")


def claim_slots(spark: SparkSession, sf: str) -> DataFrame:
    score = F.round(evidence.combined(F.col("credibility"), F.col("recency"), F.col("relevance")), 9)
    rows = _evidence(spark, sf).select("topic", "id", score.alias("score"), (F.col("relevance") > 0.9).alias("conflict"))
    return evidence.claim_slots(rows, "topic", "id", "conflict").select("topic", "id", "score")


# claims and conflicts


def _part_claims(spark: SparkSession, sf: str) -> DataFrame:
    """A price claim for each part; the entity is its brand, type and size."""
    entity = F.concat_ws(" ", "p_brand", "p_type", F.concat(F.lit("size"), F.col("p_size")))
    claim = F.concat(F.lit("the "), entity, F.lit(" retail price rate is "), F.format_string("%.2f", "p_retailprice"))
    price = F.format_string("%.2f", "p_retailprice")
    return _table(spark, sf, "part").select(
        F.col("p_partkey").alias("claim_id"), F.col("p_partkey").alias("evidence_id"), claim.alias("claim"), F.array(entity).alias("entities"), F.array(price).alias("numbers")
    )


def numeric_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    edges = conflict.detect(_part_claims(spark, sf), types=("numeric_conflict",))
    return edges.select("source_id", "target_id", (F.round(F.col("confidence") * 1e6) / 1e6).alias("confidence"), "severity")  # rounded once, in binary, as the SQL does


def _sales_claims(spark: SparkSession, sf: str) -> DataFrame:
    """What each nation's suppliers sold in each quarter, as three accounts tell it: by return flag."""
    t = lambda name: _table(spark, sf, name)
    sold = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    sold = sold.groupBy("n_name", "l_returnflag", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.sum("l_quantity").cast("long").alias("n"))
    name = F.initcap(F.translate(F.lower("n_name"), "_0123456789", " abcdefghij"))  # a name has no number in it
    claim = F.concat(F.lit("In Q"), "q", F.lit(" "), "y", F.lit(", sales of "), name, F.lit(" were "), F.format_number("n", 0))  # with commas, so that no quantity reads as a year
    rows = sold.select(F.concat_ws("-", "n_name", "y", "q", "l_returnflag").alias("claim_id"), F.col("l_returnflag").alias("evidence_id"), claim.alias("claim"), F.array(name).alias("entities"))
    return rows.withColumn("numbers", slots.number_tokens(F.col("claim")))


def fact_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of one nation's sales that differ: only those of one quarter of one year are of one fact."""
    edges = conflict.detect(_sales_claims(spark, sf), types=("numeric_conflict",))
    return edges.select("source_id", "target_id", F.round(F.round("confidence", 9), 6).alias("confidence"), "severity")


def time_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Time keys and quantities of the sales claims: a year or the number of a quarter is no quantity."""
    profiles = slots.profiled(_sales_claims(spark, sf)).select(F.explode("time_keys").alias("time_key"), F.size("quantities").alias("quantities"), F.size("attributes").alias("attributes"))
    return profiles.groupBy("time_key").agg(F.count("*").alias("n"), F.sum("quantities").alias("quantities"), F.sum("attributes").alias("attributes"))


def conflict_summary(spark: SparkSession, sf: str) -> DataFrame:
    return conflict.summed(_part_claims(spark, sf)).select("conflict_type", "severity", "n", F.round("confidence", 6).alias("confidence"))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of documents as claims, by their class."""
    docs = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = conflict.extract(docs, "doc_id", "text")
    return found.groupBy("claim_type", "verifiable", "support_type").agg(F.count("*").alias("n"), F.countDistinct("evidence_id").alias("documents"), F.sum(F.size("entities")).alias("entities"))


def claim_types(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each line of a document, looked at whole."""
    lines = _table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(conflict.claim_type(F.col("line")).alias("claim_type")).agg(F.count("*").alias("n"))


def number_features(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf, "documents").select("doc_id", F.size(numbers(text)).cast("long").alias("numbers"), F.size(F.regexp_extract_all(text, F.lit(r"[A-Z]{2,}"), F.lit(0))).cast("long").alias("acronyms"))


def year_features(spark: SparkSession, sf: str) -> DataFrame:
    found = _table(spark, sf, "documents").select("doc_id", F.explode(years(F.col("text"))).alias("year"))
    return found.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def newest_claim(spark: SparkSession, sf: str) -> DataFrame:
    """One order for each customer and status: best source, then newest, then most relevant."""
    rows = _evidence(spark, sf).join(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind")), "id")
    order = Window.partitionBy("topic", "kind").orderBy(F.desc("credibility"), F.desc("date"), F.desc("relevance"), "id")
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("topic", "kind", "id", "date")


# audit and graphs


def overlap(spark: SparkSession, sf: str) -> a.Overlap:
    return a.Overlap(a.normalised(_table(spark, sf, "benchmark"), "item_id"), _table(spark, sf, "documents").select("doc_id", "text"), body=alnum(F.col("text")))


def audit_exact(spark: SparkSession, sf: str) -> DataFrame:
    return overlap(spark, sf).exact()


def audit_near(spark: SparkSession, sf: str) -> DataFrame:
    return overlap(spark, sf).near().select("item_id", "doc_id", "shared", "score")


def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty worst findings of both kinds."""
    found = overlap(spark, sf)
    both = found.exact().select(F.lit("exact").alias("kind"), "item_id", "doc_id", F.lit(1.0).alias("score"))
    both = both.unionByName(found.near().select(F.lit("near").alias("kind"), "item_id", "doc_id", "score"))
    return both.orderBy(F.desc("score"), "kind", "item_id", "doc_id").limit(20)


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    near = overlap(spark, sf).near()
    return near.groupBy((F.col("score") >= 0.99).alias("high")).agg(F.count("*").alias("pairs"), F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a line of 60 characters or more are linked through the first that has it."""
    lines = _table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 60)
    keyed = lines.select("doc_id", F.md5("line").alias("line")).distinct()
    first = keyed.groupBy("line").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, "line").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()


def components(spark: SparkSession, sf: str) -> DataFrame:
    parts = graph.components(_links(spark, sf))
    return graph.labelled(parts, _table(spark, sf, "documents"), "doc_id").select("doc_id", "component")


def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return components(spark, sf).groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("components"))


def near_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that are alike: Jaccard index of 13-grams of at least .5."""
    items = a.normalised(_table(spark, sf, "benchmark"), "item_id")
    pairs = a.shared_grams(items, items.select(F.col("item_id").alias("doc_id"), "body")).filter("item_id < doc_id")
    score = F.round(F.col("shared") / (F.col("item_grams") + F.col("doc_grams") - F.col("shared")), 6)
    return pairs.select(F.col("item_id").alias("a"), F.col("doc_id").alias("b"), score.alias("score")).filter("score >= 0.5")


def split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that occur in more than one split; a document's split is its id modulo three."""
    docs = _table(spark, sf, "documents").select("doc_id", F.md5(squeezed(F.col("text"))).alias("digest"), (F.col("doc_id") % 3).alias("split"))
    return docs.groupBy("digest").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("splits > 1")


_ALNUM = r"regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')"


def _grams(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) >= {n} THEN list_distinct(list_transform(range(1, length({c}) - {n - 2}), lambda i: substring({c}, i, {n}))) WHEN {c} = '' THEN [] ELSE [{c}] END"


_BODIES = f"items AS (SELECT item_id, {_ALNUM} AS body FROM benchmark), docs AS (SELECT doc_id, {_ALNUM} AS body FROM documents)"
_NEAR = f"""{_BODIES},
ig AS (SELECT item_id, {_grams('body', 13)} AS g FROM items), dg AS (SELECT doc_id, {_grams('body', 13)} AS g FROM docs),
il AS (SELECT item_id, unnest(g) AS gram FROM ig), dl AS (SELECT doc_id, unnest(g) AS gram, len(g) AS dn FROM dg),
near AS (SELECT item_id, doc_id, shared, round(greatest(shared / (len(g) + dn - shared)::DOUBLE, shared / len(g)::DOUBLE), 6) AS score
  FROM (SELECT item_id, doc_id, count(*) AS shared, max(dn) AS dn FROM dl JOIN il USING (gram) GROUP BY 1, 2) JOIN ig USING (item_id))"""
_EXACT = "exact AS (SELECT item_id, doc_id, instr(docs.body, items.body) - 1 AS at FROM items, docs WHERE length(items.body) >= 8 AND instr(docs.body, items.body) > 0)"
_EVIDENCE = f"""evidence AS (
  SELECT *, CASE WHEN regexp_matches(lower(source), '{evidence.HIGH}') THEN 0.9 WHEN regexp_matches(lower(source), '{evidence.MEDIUM}') THEN 0.7 ELSE 0.5 END::DOUBLE AS credibility,
    round(greatest(0, least(1, greatest(0.5::DOUBLE, 1.0::DOUBLE - ({AS_OF} - year(date::DATE)) * 0.1::DOUBLE))), 6) AS recency
  FROM (SELECT o_orderkey AS id, o_orderpriority || CASE o_orderkey % 5 WHEN 0 THEN ' nature' WHEN 1 THEN ' blog' ELSE '' END AS source,
          strftime(o_orderdate, '%Y-%m-%d') AS date, round(greatest(0, least(1, o_totalprice / 500000)), 8) AS relevance, o_custkey AS topic, o_orderstatus AS kind FROM orders))"""
_SCORE = "round(0.4::DOUBLE * credibility + 0.3::DOUBLE * recency + 0.3::DOUBLE * relevance, 9)"
_FIXED = r"""
bodies AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
windows AS (SELECT doc_id, text, list_transform(range(0, length(text), 448), lambda i: substring(text, i + 1, 512)) AS ws FROM bodies),
folded AS (SELECT doc_id, CASE WHEN length(text) < 50 THEN CASE WHEN trim(text, ' ') = '' THEN [] ELSE [trim(text, ' ')] END
    WHEN length(ws[-1]) < 50 THEN list_append(ws[1:len(ws) - 2], ws[-2] || chr(10) || ws[-1]) ELSE ws END AS cs FROM windows)"""
_CLAIMS = """claims AS (SELECT p_partkey AS id, p_brand || ' ' || p_type || ' size' || p_size AS entity, p_retailprice AS v FROM part),
ratios AS (SELECT x.id AS source_id, y.id AS target_id, greatest(x.v, y.v) / least(x.v, y.v) AS ratio FROM claims x JOIN claims y ON x.entity = y.entity AND x.id < y.id
  WHERE floor(x.v) NOT BETWEEN 1800 AND 2099 AND floor(y.v) NOT BETWEEN 1800 AND 2099)"""
_SOLD = """sold AS (SELECT n_name || '-' || y || '-' || q || '-' || flag AS id, n_name AS nation, y, q, n FROM (
  SELECT n_name, l_returnflag AS flag, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(l_quantity)::BIGINT AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4))"""
_LINKS = """keyed AS (SELECT DISTINCT doc_id, md5(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 60),
firsts AS (SELECT line, min(doc_id) AS a FROM keyed GROUP BY 1 HAVING count(*) > 1),
links AS (SELECT DISTINCT a, doc_id AS b FROM keyed JOIN firsts USING (line) WHERE doc_id <> a),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN both_ways ON a = id WHERE root < b),
parts AS (SELECT id AS doc_id, min(root) AS component FROM reach GROUP BY 1)"""


def _any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_TYPE = f"""CASE WHEN regexp_matches(line, '[0-9]') AND {_any('low', conflict.NUMERICAL)} THEN 'numerical'
  WHEN (regexp_matches(line, '(^|[^0-9])(19|20)[0-9][0-9]([^0-9]|$)') OR regexp_matches(line, '\\b({conflict.MONTHS})\\b') OR regexp_matches(line, '(?i)\\b({conflict.RELATIVE})\\b')) AND {_any('low', conflict.TEMPORAL)} THEN 'temporal'
  WHEN {_any('low', conflict.CAUSAL)} THEN 'causal' WHEN {_any('low', conflict.DEFINITIONAL)} THEN 'definitional'
  WHEN {_any('low', conflict.UNCERTAIN)} THEN 'uncertainty' WHEN {_any('low', conflict.COMPARATIVE)} THEN 'comparative' ELSE 'factual' END"""

QUERIES = {
    "c3_fixed_chunks": fixed_chunks,
    "c4_sentence_chunks": sentence_chunks,
    "c5_paragraph_chunks": paragraph_chunks,
    "c6_heading_chunks": heading_chunks,
    "e2_credibility": credibility,
    "e3_recency": recency,
    "e4_quality": quality,
    "e6_exact_dedup": exact_dedup,
    "e7_semantic_dedup": semantic_dedup,
    "e8_ranked_evidence": ranked_evidence,
    "e9_graph_scores": graph_scores,
    "e13_claim_slots": claim_slots,
    "x1_number_features": number_features,
    "x2_claims": claims,
    "x8_claim_types": claim_types,
    "x9_years": year_features,
    "x13_time_keys": time_keys,
    "j5_fact_slots": fact_slots,
    "j8_numeric_conflicts": numeric_conflicts,
    "j22_conflict_summary": conflict_summary,
    "j27_newest_claim": newest_claim,
    "a1_audit_summary": audit_summary,
    "a2_audit_exact": audit_exact,
    "a3_audit_near": audit_near,
    "a4_audit_report": audit_report,
    "g1_components": components,
    "g1_component_sizes": component_sizes,
    "g6_near_questions": near_questions,
    "k9_split_leaks": split_leaks,
}
ORACLES = {
    "c3_fixed_chunks": f"WITH {_FIXED} SELECT doc_id || '_c' || c.i AS chunk_id, doc_id, c.i AS chunk_index, md5(c.t) AS digest FROM (SELECT doc_id, unnest(list_transform(range(1, len(cs) + 1), lambda i: {{'i': i - 1, 't': cs[i]}})) AS c FROM folded)",
    "e2_credibility": f"WITH {_EVIDENCE} SELECT source, count(*) AS n, max(credibility) AS credibility FROM evidence GROUP BY 1",
    "e3_recency": f"WITH {_EVIDENCE} SELECT date[1:4] AS year, count(*) AS n, round(avg(recency), 6) AS recency FROM evidence GROUP BY 1",
    "e4_quality": f"WITH {_EVIDENCE} SELECT id, {_SCORE} AS score FROM evidence WHERE {_SCORE} >= 0.3::DOUBLE",
    "e6_exact_dedup": r"SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY coalesce(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 'null ' || doc_id) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1",
    "e8_ranked_evidence": f"WITH {_EVIDENCE} SELECT topic, rank, id, score FROM (SELECT topic, id, {_SCORE} AS score, row_number() OVER (PARTITION BY topic ORDER BY {_SCORE} DESC, id) AS rank FROM evidence) WHERE rank <= 3",
    "e9_graph_scores": f"""WITH {_EVIDENCE},
edges AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, o_orderstatus = lead(o_orderstatus) OVER w AS support, round(o_totalprice / 500000, 8) AS confidence FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
ends AS (SELECT a AS id, support, confidence FROM edges WHERE b IS NOT NULL UNION ALL SELECT b, support, confidence FROM edges WHERE b IS NOT NULL),
per AS (SELECT id, avg(support::INT) AS s, avg(confidence) FILTER (WHERE NOT support) AS c FROM ends GROUP BY 1)
SELECT id, round(coalesce(s, 0.5), 6) AS support, round(coalesce(c, 0.0), 9) AS conflict,
  round(greatest(0, least(1, 0.3::DOUBLE * credibility + 0.2::DOUBLE * recency + 0.3::DOUBLE * relevance + 0.1::DOUBLE * coalesce(s, 0.5) - 0.1::DOUBLE * coalesce(c, 0.0))), 9) AS score FROM evidence LEFT JOIN per USING (id)""",
    "e13_claim_slots": f"WITH {_EVIDENCE} SELECT topic, id, score FROM (SELECT topic, id, relevance, {_SCORE} AS score, row_number() OVER (PARTITION BY topic ORDER BY {_SCORE} DESC, id) AS r FROM evidence) WHERE r <= 6 OR relevance > 0.9",
    "x1_number_features": r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS numbers, len(regexp_extract_all(text, '[A-Z]{2,}')) AS acronyms FROM documents",
    "x8_claim_types": f"SELECT {_TYPE} AS claim_type, count(*) AS n FROM (SELECT line, lower(line) AS low FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1",
    "x9_years": r"SELECT year, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS year FROM documents) WHERE regexp_full_match(year, '(19|20)[0-9]{2}') GROUP BY 1",
    "j8_numeric_conflicts": f"WITH {_CLAIMS} SELECT source_id, target_id, round(least(0.9::DOUBLE, 0.5::DOUBLE + (ratio - 1.1::DOUBLE) / 2), 6) AS confidence, CASE WHEN ratio > 1.5::DOUBLE THEN 'high' ELSE 'medium' END AS severity FROM ratios WHERE ratio > 1.1::DOUBLE",
    "j5_fact_slots": f"WITH {_SOLD} SELECT x.id AS source_id, y.id AS target_id, least(900000, (1000000 * greatest(x.n, y.n) + least(x.n, y.n)) // (2 * least(x.n, y.n)) - 50000) / 1000000.0::DOUBLE AS confidence, CASE WHEN greatest(x.n, y.n) / least(x.n, y.n)::DOUBLE > 1.5::DOUBLE THEN 'high' ELSE 'medium' END AS severity FROM sold x JOIN sold y ON x.nation = y.nation AND x.y = y.y AND x.q = y.q AND x.id < y.id WHERE x.n NOT BETWEEN 1800 AND 2099 AND y.n NOT BETWEEN 1800 AND 2099 AND NOT (x.n BETWEEN 1 AND 4 AND x.n = x.q) AND NOT (y.n BETWEEN 1 AND 4 AND y.n = y.q) AND greatest(x.n, y.n) / least(x.n, y.n)::DOUBLE > 1.1::DOUBLE",
    "x13_time_keys": f"WITH {_SOLD} SELECT time_key, count(*) AS n, sum((n NOT BETWEEN 1800 AND 2099 AND NOT (n BETWEEN 1 AND 4 AND n = q))::INT)::BIGINT AS quantities, count(*) AS attributes FROM (SELECT n, q, unnest(['year:' || y, 'quarter:' || q]) AS time_key FROM sold) GROUP BY 1",
    "j27_newest_claim": f"WITH {_EVIDENCE} SELECT topic, kind, id, date FROM (SELECT *, row_number() OVER (PARTITION BY topic, kind ORDER BY credibility DESC, date DESC, relevance DESC, id) AS r FROM evidence) WHERE r = 1",
    "a1_audit_summary": f"WITH {_NEAR} SELECT score >= 0.99 AS high, count(*) AS pairs, count(DISTINCT item_id) AS items, count(DISTINCT doc_id) AS documents FROM near WHERE score >= 0.85 GROUP BY 1",
    "a2_audit_exact": f"WITH {_BODIES}, {_EXACT} SELECT * FROM exact",
    "a3_audit_near": f"WITH {_NEAR} SELECT * FROM near WHERE score >= 0.85",
    "a4_audit_report": f"""WITH {_NEAR}, {_EXACT}, found AS (SELECT 'exact' AS kind, item_id, doc_id, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT 'near', item_id, doc_id, score FROM near WHERE score >= 0.85)
SELECT * FROM found ORDER BY score DESC, kind, item_id, doc_id LIMIT 20""",
    "g1_components": f"WITH RECURSIVE {_LINKS} SELECT doc_id, component FROM parts",
    "g1_component_sizes": f"WITH RECURSIVE {_LINKS} SELECT n, count(*) AS components FROM (SELECT count(*) AS n FROM parts GROUP BY component) GROUP BY 1",
    "g6_near_questions": f"""WITH {_BODIES}, g AS (SELECT item_id, {_grams('body', 13)} AS g FROM items), l AS (SELECT item_id, unnest(g) AS gram, len(g) AS n FROM g)
SELECT a, b, score FROM (SELECT x.item_id AS a, y.item_id AS b, round(count(*) / (max(x.n) + max(y.n) - count(*))::DOUBLE, 6) AS score FROM l x JOIN l y ON x.gram = y.gram AND x.item_id < y.item_id GROUP BY 1, 2) WHERE score >= 0.5""",
    "k9_split_leaks": r"SELECT digest, count(DISTINCT split) AS splits, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, doc_id % 3 AS split, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1",
}
