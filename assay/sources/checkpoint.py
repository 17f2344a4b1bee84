"""Append-only results, the last write of an id being the one that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """``rows`` carry ``seq``, which grows with every append, and ``signature`` of the run they belong to."""
    rows.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, key: str, signature: str) -> DataFrame:
    """The newest row of each id of this run; rows of other runs are stale."""
    rows = spark.read.parquet(path).filter(F.col("signature") == signature)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "seq").alias("row"))
    return newest.select(key, "row.*")


def todo(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.filter("error is null").select(key), key, "left_anti")


def repaired(rows: DataFrame, target: str) -> DataFrame:
    """Rows without an error, written to a new place: the old one is the backup."""
    rows.filter("error is null").write.parquet(target)
    return rows.sparkSession.read.parquet(target)


def signature(parts: DataFrame) -> str:
    """Digest of a run's inputs (name, value): sorted, so the order they come in does not count."""
    listed = parts.agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))).alias("l"))  # settings, a few rows
    return listed.select(F.sha2(F.array_join("l", "\n"), 256).alias("s")).first()["s"]
