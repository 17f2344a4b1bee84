"""Retrieval queries over documents, benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..operators import retrieval as r

#: Query vectors of dense search; the query set is a feature of the search, every row is searched.


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vector of each benchmark item: the query set is the benchmark's, however many vectors there are."""
    return _vectors(spark, sf).join(_items(spark, sf).select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return r.lengths(_docs(spark, sf), "doc_id", F.col("text"))


def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    index = r.idf(r.frequencies(docs, F.col("text")), docs)
    return index.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    return r.bm25(_docs(spark, sf), _items(spark, sf), k)


def dense(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return r.dense(_vectors(spark, sf), _query_vectors(spark, sf), k)


def flat_inner_product(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Inner product of vectors normalised beforehand: the same order as cosine."""
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / r.norm(v))
    vectors = _vectors(spark, sf).withColumn("v", unit("v"))
    queries = _query_vectors(spark, sf).withColumn("q", unit("q"))
    scores = vectors.crossJoin(queries).select("query_id", "doc_id", F.round(r.dot("v", "q"), r.DIGITS).alias("score"))
    return r.top(scores, "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")


def hybrid(spark: SparkSession, sf: str, k: int = 10, depth: int = 100) -> DataFrame:
    """BM25 over texts and cosine over vectors, both to the same depth, fused .3 to .7."""
    sparse = r.bm25(_docs(spark, sf), _items(spark, sf), depth)
    return r.fused([(sparse, 0.3), (r.dense(_vectors(spark, sf), _query_vectors(spark, sf), depth), 0.7)], k)


def rrf(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Fusion of the cosine ranking and the ranking by inner product of raw vectors."""
    vectors, queries = _vectors(spark, sf), _query_vectors(spark, sf)
    cosine = r.dense(vectors, queries, 100)
    raw = vectors.crossJoin(queries).select("query_id", "doc_id", F.round(r.dot("v", "q"), r.DIGITS).alias("score"))
    return r.fused([(cosine, 0.3), (r.top(raw, "query_id", "score", "doc_id", 100), 0.7)], k)


def recall_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Two BM25 anchors stay before the list reranked by document length."""
    docs = _docs(spark, sf)
    base = r.bm25(docs, _items(spark, sf), 20)
    again = base.join(docs.select("doc_id", "n_chars"), "doc_id")
    order = Window.partitionBy("query_id").orderBy("n_chars", "doc_id")
    again = again.withColumn("rank", F.row_number().over(order).cast("long"))
    return r.guarded(base, again.select("query_id", "doc_id", "rank"), 2, 10)


def evidence_rerank(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    hits = r.bm25(docs, _items(spark, sf), 20).join(docs.select("doc_id", "source"), "doc_id")
    credibility = F.when(F.col("source").rlike("1$"), 0.9).when(F.col("source").rlike("[2-5]$"), 0.7)
    scored = hits.withColumn("blend", F.round(r.evidence_score(F.col("score") / 100, credibility), r.DIGITS))
    return r.top(scored, "query_id", "blend", "doc_id", 5, "place").select("query_id", "place", "doc_id", "blend")


def title_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A document's first 80 characters are its title."""
    docs, items = _docs(spark, sf), _items(spark, sf)
    hits = r.bm25(docs, items, 20).join(docs.select("doc_id", F.substring("text", 1, 80).alias("title")), "doc_id").join(items, "query_id")
    return r.overlap_rerank(hits, 5)


def adaptive_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Depth by the query's length: short ones are simple."""
    items = _items(spark, sf)
    words = F.size(tokens(F.col("query")))
    depth = r.policy_k("complexity_adaptive", F.when(words < 25, "low").when(words < 40, "medium").otherwise("high"))
    need = items.select("query_id", depth.cast("long").alias("depth"))
    return r.bm25(_docs(spark, sf), items, 10).join(need, "query_id").filter("rank <= depth").select("query_id", "rank", "doc_id", "score", "depth")


# Words that variants leave out or swap, and what counter queries add.
STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from "
    "as into through during before after above below between out off over under again further then once what which who whom this that these those it its and but or nor "
    "not so yet both either neither each every all any few more most other some such no only own same than too very just because if when where how why "
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 吗 吧 呢 啊 什么 怎么 哪些 哪个 为什么 如何"
).split()
NO_KEYWORDS = (
    "a an the is are was were be been being have has had do does did will would should could might must can what which who when where why how and or but in on at to for "
    "of with by from as about"
).split()
SYNONYMS = {
    "impact": "effect", "cause": "reason", "improve": "enhance", "reduce": "decrease", "relationship": "connection", "mechanism": "process", "result": "outcome",
    "important": "significant", "problem": "issue", "compare": "contrast", "影响": "效果", "原因": "因素", "提升": "增强", "减少": "降低", "关系": "联系", "机制": "原理", "结果": "结论",
    "重要": "关键", "问题": "挑战", "比较": "对比", "发展": "进展",
}
COMPACT = {"中美欧": ("中国", "美国", "欧盟")}
AFFIXES = ("{} 不实", "{} 错误", "{} 辟谣", "{} not", "{} false", "{} 不同观点", "最新 {}", "更新 {}", "{} latest")
MOST_VARIANTS, MOST_COUNTERS = 5, 8


def keywords(question: F.Column) -> F.Column:
    """Capitalised words and longer words that are no stop words, ten at most, sorted."""
    plain = F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    found = F.array_union(
        F.filter(plain, lambda t: t.rlike("^[A-Z][a-z]+$")),
        F.filter(F.transform(plain, F.lower), lambda t: t.rlike("^[a-z]+$") & (F.length(t) > 3) & ~t.isin(NO_KEYWORDS)),
    )
    return F.slice(F.array_sort(found), 1, 10)


def question_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("query_id", F.array_join(keywords(F.col("query")), " ").alias("keywords"))


def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    """At most five distinct forms of a query: as given, with compact names spelled out, without stop words, with one synonym, its names, its keywords in order."""
    q = F.col("query")
    words = F.filter(F.split(F.replace(q, F.lit("?"), F.lit("")), r"\s+"), lambda w: w != "")
    joined = lambda a: F.array_join(a, " ")
    synonyms = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    place = F.array_position(F.transform(words, lambda w: F.map_contains_key(synonyms, F.lower(w))), F.lit(True))
    forms = F.array(
        q,
        *[F.when(F.contains(q, F.lit(name)), F.replace(q, F.lit(name), F.lit(part))) for name, parts in COMPACT.items() for part in parts],
        joined(F.filter(words, lambda w: ~F.lower(w).isin(STOP))),
        joined(F.transform(words, lambda w, i: F.when(i + 1 == place, F.try_element_at(synonyms, F.lower(w))).otherwise(w))),
        joined(F.regexp_extract_all(q, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"), F.lit(0))),
        joined(keywords(q)),
    )
    distinct = F.slice(F.filter(F.array_distinct(forms), lambda v: v.isNotNull() & (v != "")), 1, MOST_VARIANTS)
    return _items(spark, sf).select("query_id", F.posexplode(distinct).alias("ord", "variant")).withColumn("ord", F.col("ord").cast("long"))


def counter_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Nine forms that look for what speaks against a query, of which the last is cut."""
    forms = F.array(*[F.concat(F.lit(a.split("{}")[0]), F.col("query"), F.lit(a.split("{}")[1])) for a in AFFIXES[:MOST_COUNTERS]])
    return _items(spark, sf).select("query_id", F.posexplode(forms).alias("ord", "variant")).withColumn("ord", F.col("ord").cast("long"))


def multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """All variants are searched to depth ten; a document counts where its first variant found it, and the best ten stay. What counter queries find to depth five follows, duplicates and all."""
    tier = lambda rows, n: rows.select((F.col("query_id") * 100 + n + F.col("ord")).alias("query_id"), F.col("variant").alias("query"))
    forms = tier(query_variants(spark, sf), 0).unionByName(tier(counter_queries(spark, sf), 50))
    hits = r.bm25(_docs(spark, sf), forms, 10).withColumns({"ord": F.col("query_id") % 100, "query_id": F.floor(F.col("query_id") / 100)})
    first = hits.filter("ord < 50").groupBy("query_id", "doc_id").agg(F.min_by("score", "ord").alias("score"))
    best = r.top(first, "query_id", "score", "doc_id", 10).select("query_id", F.lit("variant").alias("found_by"), F.lit(0).cast("long").alias("ord"), "rank", "doc_id", "score")
    against = hits.filter("ord >= 50 and rank <= 5").select("query_id", F.lit("counter").alias("found_by"), (F.col("ord") - 50).alias("ord"), "rank", "doc_id", "score")
    return best.unionByName(against)


def second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Up to two further documents for a query, of those its first five hits do not hold."""
    deep = r.bm25(_docs(spark, sf), _items(spark, sf), 10)
    fresh = deep.join(deep.filter("rank <= 5").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return r.top(fresh, "query_id", "score", "doc_id", 2, "place").select("query_id", "place", "doc_id", "score")


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many of its hits hold any word of a query, three being enough."""
    items = _items(spark, sf)
    hits = r.bm25(_docs(spark, sf), items, 5).join(_docs(spark, sf).select("doc_id", F.col("text").alias("content")), "doc_id").join(items, "query_id")
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    return r.coverage(F.col("words"), hits.withColumn("words", words), "query_id")


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_DOC, _QUERY = _TOKENS.format("text"), _TOKENS.format("query")
_INDEX = f"""
entries AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_DOC}) AS term FROM documents) GROUP BY 1, 2),
dls AS MATERIALIZED (SELECT doc_id, coalesce(len({_DOC}), 0) AS dl FROM documents),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
         FROM (SELECT term, count(*) AS df FROM entries GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM dls)),
idfs AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


def bm25_sql(name: str, k: int, b: float = 0.75, queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark") -> str:
    """CTE ``name`` (query_id, rank, doc_id, score) on top of _INDEX."""
    return f"""
{name}_terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_QUERY}) AS term FROM ({queries}) WHERE trim(query) <> '') GROUP BY 1, 2),
{name}_scores AS (
  SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / (SELECT avg(dl) FROM dls)))), 6) AS score
  FROM {name}_terms JOIN idfs USING (term) JOIN entries USING (term) JOIN dls USING (doc_id) GROUP BY 1, 2),
{name} AS (
  SELECT query_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_scores WHERE score > 0)
  WHERE rank <= {k})"""


_Q = "SELECT vec_id AS query_id, embedding AS q FROM embeddings SEMI JOIN benchmark ON vec_id = item_id"
_DOT = "list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i]::DOUBLE * q[i]::DOUBLE))"
_NORM = "list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))"


def _dense_sql(k: int, score: str) -> str:
    return f"""SELECT query_id, rank, doc_id, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, vec_id AS doc_id, round({score}, 6) AS score FROM (SELECT vec_id, embedding AS v FROM embeddings), ({_Q})))
WHERE rank <= {k}"""


_COSINE = f"{_DOT} / (sqrt({_NORM.format('v')}) * sqrt({_NORM.format('q')}))"
_UNIT_DOT = f"list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i]::DOUBLE / sqrt({_NORM.format('v')})) * (q[i]::DOUBLE / sqrt({_NORM.format('q')}))))"


def _fused_sql(lists: list[tuple[str, float]], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, {w}::DOUBLE / (60 + rank) AS part FROM {n}" for n, w in lists)
    return f"""SELECT query_id, rank, doc_id, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(sum(part), 8) AS score FROM ({union}) GROUP BY 1, 2)) WHERE rank <= {k}"""


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_FORMS = [
    "q",
    *[f"CASE WHEN contains(q, '{name}') THEN replace(q, '{name}', '{part}') END" for name, parts in COMPACT.items() for part in parts],
    f"array_to_string(list_filter(ws, lambda w: NOT list_contains({_LIST(STOP)}, lower(w))), ' ')",
    f"array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = place THEN coalesce(list_extract({_LIST(SYNONYMS.values())}, list_position({_LIST(SYNONYMS)}, lower(w))), w) ELSE w END), ' ')",
    "array_to_string(regexp_extract_all(q, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*'), ' ')",
    f"""array_to_string(list_sort(list_distinct(list_concat(list_filter(ts, lambda t: regexp_matches(t, '^[A-Z][a-z]+$')),
    list_filter(list_transform(ts, lambda t: lower(t)), lambda t: regexp_matches(t, '^[a-z]+$') AND length(t) > 3 AND NOT list_contains({_LIST(NO_KEYWORDS)}, t)))))[1:10], ' ')""",
]
_VARIANTS = f"""
words AS (SELECT *, list_position(list_transform(ws, lambda w: list_contains({_LIST(SYNONYMS)}, lower(w))), true) AS place FROM (
  SELECT item_id AS query_id, text AS q, list_filter(string_split_regex(replace(text, '?', ''), '\\s+'), lambda w: w <> '') AS ws, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ts FROM benchmark)),
forms AS (SELECT query_id, [{', '.join(_FORMS)}] AS fs FROM words),
kept AS (SELECT query_id, list_filter(list_transform(range(1, len(fs) + 1), lambda i: CASE WHEN fs[i] <> '' AND list_position(fs, fs[i]) = i THEN fs[i] END), lambda f: f IS NOT NULL)[1:{MOST_VARIANTS}] AS fs FROM forms),
variants AS (SELECT query_id, u.ord, u.variant FROM (SELECT query_id, unnest(list_transform(range(1, len(fs) + 1), lambda i: {{'ord': i - 1, 'variant': fs[i]}})) AS u FROM kept))"""
_COUNTERS = (
    "counters AS (SELECT item_id AS query_id, ord, pre || text || post AS variant FROM benchmark, ("
    + " UNION ALL ".join(f"SELECT {i}::BIGINT AS ord, '{a.split('{}')[0]}' AS pre, '{a.split('{}')[1]}' AS post" for i, a in enumerate(AFFIXES[:MOST_COUNTERS]))
    + "))"
)

QUERIES = {
    "r2_token_counts": token_counts,
    "r3_bm25_index": bm25_index,
    "r4_bm25": bm25,
    "r6_dense": dense,
    "r7_flat_inner_product": flat_inner_product,
    "r8_hybrid": hybrid,
    "r9_rrf": rrf,
    "r13_recall_guard": recall_guard,
    "r14_evidence_rerank": evidence_rerank,
    "r17_query_variants": query_variants,
    "x18_question_keywords": question_keywords,
    "r18_counter_queries": counter_queries,
    "r19_multi_query": multi_query,
    "r20_adaptive_depth": adaptive_depth,
    "r22_second_pass": second_pass,
    "r23_coverage": coverage,
    "r26_title_overlap": title_overlap,
}
ORACLES = {
    "r2_token_counts": f"SELECT doc_id, coalesce(len({_DOC}), 0)::BIGINT AS dl FROM documents",
    "r3_bm25_index": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "r4_bm25": f"WITH {_INDEX}, {bm25_sql('hits', 5)} SELECT * FROM hits",
    "r6_dense": _dense_sql(10, _COSINE),
    "r7_flat_inner_product": _dense_sql(10, _UNIT_DOT),
    "r8_hybrid": f"WITH {_INDEX}, {bm25_sql('s', 100)}, d AS ({_dense_sql(100, _COSINE)}) {_fused_sql([('s', 0.3), ('d', 0.7)], 10)}",
    "r9_rrf": f"WITH c AS ({_dense_sql(100, _COSINE)}), d AS ({_dense_sql(100, _DOT)}) {_fused_sql([('c', 0.3), ('d', 0.7)], 10)}",
    "r13_recall_guard": f"""WITH {_INDEX}, {bm25_sql('hits', 20)},
again AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id) AS rank FROM hits JOIN documents USING (doc_id)),
front AS (SELECT query_id, doc_id, 0 AS tier, rank FROM hits WHERE rank <= 2),
every AS (SELECT * FROM front UNION ALL SELECT query_id, doc_id, 1, rank FROM again ANTI JOIN front USING (query_id, doc_id))
SELECT query_id, doc_id, place, tier::BIGINT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, doc_id) AS place FROM every) WHERE place <= 10""",
    "r14_evidence_rerank": f"""WITH {_INDEX}, {bm25_sql('hits', 20)},
scored AS (SELECT query_id, doc_id, round(0.7::DOUBLE * (1 / (1 + exp(-(score / 100)))) + 0.2::DOUBLE * (CASE WHEN regexp_matches(source, '1$') THEN 0.9 WHEN regexp_matches(source, '[2-5]$') THEN 0.7 ELSE 0.5 END)::DOUBLE + 0.1::DOUBLE * 0.5::DOUBLE, 6) AS blend FROM hits JOIN documents USING (doc_id))
SELECT query_id, place, doc_id, blend FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, doc_id) AS place FROM scored) WHERE place <= 5""",
    "r17_query_variants": f"WITH {_VARIANTS} SELECT query_id, ord, variant FROM variants",
    "x18_question_keywords": f"WITH {_VARIANTS} SELECT query_id, {_FORMS[-1]} AS keywords FROM words",
    "r18_counter_queries": f"WITH {_COUNTERS} SELECT query_id, ord, variant FROM counters",
    "r19_multi_query": f"""WITH {_VARIANTS}, {_COUNTERS}, asked AS (SELECT query_id * 100 + ord AS query_id, variant AS query FROM variants UNION ALL SELECT query_id * 100 + 50 + ord, variant FROM counters),
{_INDEX}, {bm25_sql('hits', 10, queries='SELECT * FROM asked')},
firsts AS (SELECT query_id // 100 AS query_id, doc_id, min_by(score, query_id % 100) AS score FROM hits WHERE query_id % 100 < 50 GROUP BY query_id // 100, doc_id)
SELECT query_id, 'variant' AS found_by, 0::BIGINT AS ord, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM firsts) WHERE rank <= 10
UNION ALL SELECT query_id // 100, 'counter', query_id % 100 - 50, rank, doc_id, score FROM hits WHERE query_id % 100 >= 50 AND rank <= 5""",
    "r20_adaptive_depth": f"""WITH {_INDEX}, {bm25_sql('hits', 10)},
need AS (SELECT item_id AS query_id, (CASE WHEN n < 25 THEN 2 WHEN n < 40 THEN 4 ELSE 5 END)::BIGINT AS depth FROM (SELECT item_id, len({_DOC}) AS n FROM benchmark))
SELECT query_id, rank, doc_id, score, depth FROM hits JOIN need USING (query_id) WHERE rank <= depth""",
    "r22_second_pass": f"""WITH {_INDEX}, {bm25_sql('hits', 10)}
SELECT query_id, place, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM hits WHERE rank > 5) WHERE place <= 2""",
    "r23_coverage": f"""WITH {_INDEX}, {bm25_sql('hits', 5)},
words AS (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM benchmark)
SELECT query_id, least(1.0, count(*) FILTER (WHERE len(list_filter(ws, lambda w: contains(lower(text), w))) > 0) / 3.0)::DOUBLE AS coverage
FROM hits JOIN documents USING (doc_id) JOIN words USING (query_id) GROUP BY 1""",
    "r26_title_overlap": f"""WITH {_INDEX}, {bm25_sql('hits', 20)},
scored AS (SELECT query_id, h.doc_id, round(score + 0.5::DOUBLE * len(list_distinct(list_intersect(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+'), regexp_extract_all(lower(d.text[1:80]), '[\\p{{L}}\\p{{N}}_]+')))), 6) AS reranked
  FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id)
SELECT query_id, rank, doc_id, reranked FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, doc_id) AS rank FROM scored) WHERE rank <= 5""",
}
