"""Scores of models as functions that are handed in, and the plans around them.

A scorer takes a pandas frame and returns a score for each row; it runs in tasks, on Arrow
batches, and is built there once. Without a model, ``overlap`` stands in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import bm25, check_k, dense, evidence_score, fused, guarded, top

Scorer = Callable[[pd.DataFrame], pd.Series]
_MAKERS: dict[str, Callable[[], Scorer]] = {}


def register(name: str, make: Callable[[], Scorer]) -> None:
    """``make`` is called once in each task, so that a model is loaded where it is used."""
    _MAKERS[name] = make


def scored(rows: DataFrame, make: Callable[[], Scorer] | str, column: str = "model_score") -> DataFrame:
    """``rows`` with the scorer's score; null and not-a-number are 0."""
    build = _MAKERS[make] if isinstance(make, str) else make
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{column}` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = build()
        for part in batches:
            yield part.assign(**{column: score(part).astype(float).fillna(0.0)})

    return rows.mapInPandas(run, schema)


def overlap() -> F.Column:
    """Share of the query's distinct tokens that the content has: a score without a model."""
    asked = F.array_distinct(tokens(F.col("query")))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tokens(F.col("content")))) / F.size(asked))


def probability(score: F.Column) -> F.Column:
    """A logit as a probability."""
    return F.coalesce(1 / (1 + F.exp(-F.nanvl(score, F.lit(None)))), F.lit(0.0))


def rerank(hits: DataFrame, k: int, score: str = "model_score") -> DataFrame:
    """The k best of each query's hits (query_id, doc_id, score) by a model's score, rounded, ties by document."""
    check_k(k)
    return top(hits.withColumn("again", F.round(score, 6)), "query_id", "again", "doc_id", k, "place").select("query_id", "place", "doc_id", F.col("again").alias("score"))


def with_texts(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    return hits.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").join(queries, "query_id")


def retriever(config: dict) -> Callable[[dict[str, DataFrame], int], DataFrame]:
    """A plan from its settings: ``kind`` bm25, dense or hybrid, with the suffix ``_rerank`` for a second stage.

    The returned function takes docs, queries and, for dense, vectors and query_vectors. A hybrid without
    vectors is sparse only.
    """
    kind = config.get("kind", "bm25")
    base, again = kind.removesuffix("_rerank"), kind.endswith("_rerank")
    if base not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown retriever {kind!r}")
    depth, width = config.get("fetch_k", 100), config.get("candidate_k", 20)

    def run(tables: dict[str, DataFrame], k: int) -> DataFrame:
        n = max(k, width) if again else k
        has = "vectors" in tables and "query_vectors" in tables
        if base == "dense":
            hits = dense(tables["vectors"], tables["query_vectors"], n)
        elif base == "hybrid" and has:
            sparse = bm25(tables["docs"], tables["queries"], depth)
            hits = fused([(sparse, config.get("sparse_weight", 0.3)), (dense(tables["vectors"], tables["query_vectors"], depth), config.get("dense_weight", 0.7))], n)
        else:
            hits = bm25(tables["docs"], tables["queries"], n)
        if not again:
            return hits
        texts = with_texts(hits, tables["docs"], tables["queries"])
        model = scored(texts, config["scorer"]) if "scorer" in config else texts.withColumn("model_score", overlap())
        if config.get("evidence_aware"):
            model = model.withColumn("model_score", evidence_score(F.col("model_score")))
        best = rerank(model, n).select("query_id", F.col("place").alias("rank"), "doc_id", "score")
        if keep := config.get("preserve", 0):
            return guarded(hits, best, keep, k).select("query_id", F.col("place").alias("rank"), "doc_id")
        return best.filter(F.col("rank") <= k)

    return run


def refined(questions: DataFrame) -> DataFrame:
    """(query_id, query): a question cut to its words that no evidence holds yet, sorted; the question itself if all are held.

    ``questions`` (query_id, query, held), held being the words found so far.
    """
    words = F.array_sort(F.array_distinct(F.filter(tokens(F.col("query")), lambda w: F.length(w) > 3)))
    left = F.array_except(words, F.coalesce("held", F.array().cast("array<string>")))
    return questions.select("query_id", F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(F.col("query")).alias("query"))


def dynamic(docs: DataFrame, queries: DataFrame, rounds: int = 5, k: int = 10, enough: float = 0.8) -> DataFrame:
    """(query_id, doc_id, round): retrieve, look what is covered, refine what is not, again.

    A query is resolved when the share of its words that its documents hold reaches ``enough``. There are at most
    ``rounds``, each one plan over all open queries; none is made when no query is open.
    """
    from ..scratch import saved

    found, open_ = None, queries.select("query_id", "query", F.col("query").alias("asked"))
    for n in range(rounds):
        hits = bm25(docs, open_.select("query_id", F.col("asked").alias("query")), k).select("query_id", "doc_id")
        if found is not None:
            hits = hits.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        fresh = hits.withColumn("round", F.lit(n).cast("long"))
        found = saved(fresh if found is None else found.unionByName(fresh), "found")
        words = F.array_distinct(F.filter(tokens(F.col("query")), lambda w: F.length(w) > 3))
        texts = with_texts(found, docs, queries).select("query_id", "query", F.array_intersect(words, tokens(F.col("content"))).alias("w"))
        held = texts.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("held"))  # words of one query
        state = queries.join(held, "query_id", "left")
        share = F.coalesce(F.size("held"), F.lit(0)) / F.greatest(F.lit(1), F.size(words))
        rest = state.filter(share < enough)
        open_ = saved(refined(rest).withColumnRenamed("query", "asked").join(queries, "query_id"), "open")
        if open_.isEmpty():
            break
    return found
