"""Model stand-ins, reranking and iterative retrieval."""

import pytest
from pyspark.sql import functions as F

from assay.operators import retrieval, scorers


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(1, "red apples grow on trees"), (2, "green apples are sour"), (3, "trees grow slowly in winter"), (4, "winter is cold"), (5, None)]
    return {"docs": spark.createDataFrame(docs, "doc_id long, text string"), "queries": spark.createDataFrame([(1, "apples trees winter")], "query_id long, query string")}


def test_scorer_runs_on_batches(spark):
    scorers.register("length", lambda: lambda part: part["content"].str.len().where(part["content"] != "x"))
    rows = spark.createDataFrame([("abc",), ("x",)], "content string")
    assert sorted(r["model_score"] for r in scorers.scored(rows, "length").collect()) == [0.0, 3.0]


def test_reranked_by_a_model(tables):
    config = {"kind": "bm25_rerank", "candidate_k": 4, "scorer": lambda: lambda part: -part["doc_id"]}
    got = scorers.retriever(config)(tables, 2).orderBy("rank").collect()
    base = {r["doc_id"] for r in retrieval.bm25(tables["docs"], tables["queries"], 4).collect()}
    assert [r["doc_id"] for r in got] == sorted(base)[:2]


def test_anchor_is_preserved(tables):
    first = retrieval.bm25(tables["docs"], tables["queries"], 1).first()["doc_id"]
    config = {"kind": "bm25_rerank", "preserve": 1, "scorer": lambda: lambda part: (part["doc_id"] != first).astype(float)}
    assert scorers.retriever(config)(tables, 2).orderBy("rank").first()["doc_id"] == first


def test_hybrid_without_vectors_is_sparse(tables):
    got = scorers.retriever({"kind": "hybrid"})(tables, 3).collect()
    assert sorted(map(str, got)) == sorted(map(str, retrieval.bm25(tables["docs"], tables["queries"], 3).collect()))
    with pytest.raises(ValueError, match="unknown retriever"):
        scorers.retriever({"kind": "other"})


def test_dynamic_finds_what_the_first_round_left(tables):
    got = scorers.dynamic(tables["docs"], tables["queries"], rounds=3, k=1).collect()
    assert len({r["doc_id"] for r in got}) == len(got) >= 2 and min(r["round"] for r in got) == 0


def test_refined_question_asks_for_the_rest(spark):
    rows = spark.createDataFrame([(1, "winter apples trees", ["trees"]), (2, "winter", ["winter"]), (3, "winter", None)], "query_id long, query string, held array<string>")
    assert {r["query_id"]: r["query"] for r in scorers.refined(rows).collect()} == {1: "apples winter", 2: "winter", 3: "winter"}


def test_probability(spark):
    rows = spark.createDataFrame([(0.0,), (float("nan"),), (None,)], "s double")
    assert [r["p"] for r in rows.select(scorers.probability(F.col("s")).alias("p")).collect()] == [0.5, 0.0, 0.0]
