"""Queries of nested texts and of stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.leaves import leaves
from ..scratch import scratch
from ..sources import index
from ..sources.history import DELETE, PUT, History
from ..sources.quarantine import json_lines
from ..sources.vectors import Index, save
from . import retrieval
from .retrieval import _docs, _items, _query_vectors, _vectors


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def json_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of conversations told as nested JSON, a turn each; every tenth turn's is cut off and so is one raw text."""
    lines = F.split("text", "\n")
    turn = F.struct(F.col("turn").alias("n"), F.struct(F.col("role").alias("as"), F.array(F.struct(F.length("text").alias("chars"), lines.alias("lines"))).alias("said")).alias("by"), F.array(F.array("role", F.lit(" ")), F.array("role")).alias("roles"))
    rows = _table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.when((F.col("conv_id") + F.col("turn")) % 10 == 7, F.lit('{"cut": "')).otherwise(F.lit("")).alias("before"), F.to_json(turn).alias("turn"))
    found = leaves(rows.select("id", F.concat("before", "turn").alias("turn")), "id", "turn")
    path = F.when(F.col("path").isNull(), "raw").otherwise(F.regexp_replace("path", r"lines\[[0-9]+\]", "lines[]"))
    return found.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("turns"), F.min("text").alias("first"), F.sum(F.length("text")).alias("chars"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as operations on a table of conversations: a short one deletes, any other is put. Three commits, the first two compacted."""
    op = F.when(F.length("text") < 100, DELETE).otherwise(PUT)
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("digest"), op.alias("op"))
    table = History(spark, f"{scratch(spark)}/history-{uuid.uuid4().hex}", "conv_id long, turn long, role string, digest string", "conv_id", "turn")
    for first, last in ((0, 1), (2, 3), (4, None)):
        table.apply(rows.filter((F.col("turn") >= first) & (F.lit(True) if last is None else F.col("turn") <= last)), "turn")
        if last == 3:
            table.compact()
    return table.state()


def saved_vectors(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """The hits of an index that has been written and opened again, over all its lists."""
    path = f"{scratch(spark)}/vectors-{uuid.uuid4().hex}"
    save(_vectors(spark, sf), path)
    return Index(spark, path).search(_query_vectors(spark, sf), k)


def saved_hybrid(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Terms and vectors from indexes that have been written and opened again, fused."""
    path = f"{scratch(spark)}/hybrid-{uuid.uuid4().hex}"
    save(_vectors(spark, sf), f"{path}/vectors")
    index.save(_docs(spark, sf), f"{path}/terms")
    queries = _items(spark, sf).join(_query_vectors(spark, sf), "query_id", "left").select("query_id", "query", "q")
    return Index(spark, f"{path}/vectors").hybrid(index.load(spark, f"{path}/terms"), queries, k)


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines, a folder a source, and read again: some lines are blank, cut off or without a text, and each problem has its line."""
    path = f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
    kind = F.pmod("doc_id", F.lit(40))
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.when(kind != 11, F.col("text")).alias("content"), F.col("lang")))
    line = F.when(kind == 7, F.expr("substring(j, 1, length(j) - 1)")).when(kind == 9, "[1]").when(kind == 13, "  ").otherwise(F.col("j"))
    rows = _table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", whole.alias("j"), kind.alias("kind"))
    laid = rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", line.alias("value"))
    laid.write.partitionBy("source").text(path, lineSep="\n")
    loaded = json_lines(spark, path, suffix=".txt")
    folder = F.regexp_extract("file", r"source=([^/]*)/", 1)
    good = loaded.documents.select(folder.alias("source"), (F.col("line") + 1).alias("line"), "doc_id", F.lit("").alias("reason"), F.length("text").cast("long").alias("chars"))
    bad = loaded.problems.select(folder.alias("source"), "line", F.lit("").alias("doc_id"), "reason", F.lit(0).cast("long").alias("chars"))
    return good.unionByName(bad)


QUERIES = {"s3_quarantine": quarantine, "s13_saved_vectors": saved_vectors, "s13_saved_hybrid": saved_hybrid, "s12_json_leaves": json_leaves, "s18_history": history}
ORACLES = {
    "s3_quarantine": """WITH d AS (SELECT coalesce(source, 'none') AS source, doc_id, text, doc_id % 40 AS kind, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS line FROM documents)
SELECT source, line, CASE WHEN kind IN (7, 9, 11) THEN '' ELSE doc_id::VARCHAR END AS doc_id, CASE kind WHEN 7 THEN 'malformed JSON' WHEN 9 THEN 'neither an object nor an array of objects' WHEN 11 THEN 'no text' ELSE '' END AS reason,
  CASE WHEN kind IN (7, 9, 11) THEN 0 ELSE length(text) END AS chars FROM d WHERE kind <> 13""",
    "s13_saved_vectors": retrieval.ORACLES["r6_dense"],
    "s13_saved_hybrid": retrieval.ORACLES["r8_hybrid"],
    "s12_json_leaves": r"""WITH t AS (SELECT conv_id || ':' || turn AS id, role, text, (conv_id + turn) % 10 = 7 AS cut, turn FROM conversations),
j AS (SELECT id, cut, to_json({'n': turn, 'by': {'as': role, 'said': [{'chars': length(text), 'lines': string_split(text, chr(10))}]}, 'roles': [[role, ' '], [role]]})::VARCHAR AS j, role, text FROM t),
l AS (SELECT id, 'raw' AS path, '{"cut": "' || j AS text FROM j WHERE cut
  UNION ALL SELECT id, unnest(['$.by.as', '$.roles[0][0]', '$.roles[1][0]']), role FROM j WHERE NOT cut
  UNION ALL SELECT id, '$.by.said[0].lines[]', unnest(string_split(text, chr(10))) FROM j WHERE NOT cut)
SELECT path, count(*) AS n, count(DISTINCT id) AS turns, min(text) AS first, sum(length(text))::BIGINT AS chars FROM l WHERE trim(text) <> '' GROUP BY 1""",
    "s18_history": "SELECT conv_id, turn, role, digest FROM (SELECT conv_id, turn, role, md5(text) AS digest, length(text) < 100 AS gone, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1 AND NOT gone",
}
