"""Readers of public question sets in their published JSON forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEVER = "id long, claim string, label string"
HOTPOT = "_id string, question string, answer string, context array<array<string>>, supporting_facts array<array<string>>"


def fever(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEVER).json(path).select(F.col("id").cast("string").alias("question_id"), "claim", F.lower("label").alias("label"))


def hotpot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, documents): a document for each (title, sentences) pair of a context."""
    rows = spark.read.schema(HOTPOT).option("multiLine", True).json(path)
    questions = rows.select(F.col("_id").alias("question_id"), "question", "answer", F.transform("supporting_facts", lambda f: f[0]).alias("titles"))
    pairs = rows.select(F.col("_id").alias("question_id"), F.posexplode("context").alias("i", "pair"))
    sentences = F.from_json(F.col("pair")[1], "array<string>")
    docs = pairs.select("question_id", F.concat_ws("_", "question_id", "i").alias("doc_id"), F.col("pair")[0].alias("title"), F.array_join(sentences, " ").alias("text"))
    return questions, docs
