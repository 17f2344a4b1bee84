"""A sparse index as Parquet tables: postings, lengths and term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import asked_terms, check_k, idf, lengths, postings, scored
from ..scratch import saved

TABLES = ("postings", "lengths", "terms")


def save(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Postings are laid out by term, so a search reads the row groups of its terms only."""
    entries, dl = saved(postings(docs, id_col, F.col(text)), "postings"), lengths(docs, id_col, F.col(text))
    entries.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    dl.write.mode("overwrite").parquet(f"{path}/lengths")
    spark = docs.sparkSession
    counts = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
    idf(counts, spark.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/terms")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def search(index: dict[str, DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """BM25 over a saved index, as over the documents themselves."""
    check_k(k)
    asked = asked_terms(queries).join(index["terms"], "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    average = index["lengths"].agg(F.avg("dl")).first()[0] or 1.0
    wanted = index["postings"].join(asked.select("term").distinct(), "term", "left_semi")
    rows = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("found")).join(index["lengths"], "doc_id")  # the query's terms of a document
    return scored(rows.select("doc_id", "dl", F.col("found.term").alias("terms"), F.col("found.tf").alias("tfs")), asked, average, k)
