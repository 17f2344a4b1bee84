"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame,
which ``run`` writes as Parquet and reads again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import langid, mixing, packing, pii, simhash
from assay.llm.common import saved, table, with_row_id

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose words agree less than this on its language is rejected, as is one without letters.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; ``lang`` becomes the predicted one."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    told = langid.predict(docs, model, keep=list(COLUMNS))
    told = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id."""
    rows = with_row_id(docs, "doc_id", *COLUMNS)
    groups = simhash.near_duplicates(rows.select(F.col("rid").alias("doc_id"), "text"))
    dropped = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("rid"))
    return rows.join(dropped, "rid", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with confirmed personal data masked."""
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = with_row_id(docs, "doc_id", *COLUMNS)
    mixed = mixing.mix(rows.select(F.col("rid").alias("doc_id"), "source", "text"))
    taken = mixed.filter("times > 0").select(F.col("doc_id").alias("rid"), "times")
    return rows.join(taken, "rid").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]
#: A hash-based fingerprint of shingles and a learned vocabulary are beyond DuckDB's SQL; the tests hold
#: each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
