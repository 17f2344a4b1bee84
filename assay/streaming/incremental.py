"""Incremental ingestion with Structured Streaming: each micro-batch is appended, nothing is rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, conflict
from ..operators.retrieval import postings


def index_stream(docs: DataFrame, target: str, checkpoint: str, **chunk_options) -> StreamingQuery:
    """Chunk a stream of documents (doc_id, text) and append chunks and their postings below ``target``.

    A batch that is run again overwrites its own folder only, so every document is indexed once.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk(batch, **chunk_options)
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        postings(chunks, "chunk_id", F.col("text")).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conflict_stream(claims: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Grow the conflict graph: new claims meet each other and all earlier ones, edges are never doubled."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["claim_id"])
        old = [spark.read.parquet(f"{target}/claims/batch={n}") for n in range(number)]
        known = fresh.limit(0)
        for o in old:
            known = known.unionByName(o)
        fresh = fresh.join(known.select("claim_id"), "claim_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/claims/batch={number}")
        fresh = spark.read.parquet(f"{target}/claims/batch={number}")
        edges = spark.createDataFrame([], "source_id string, target_id string, conflict_type string")
        conflict.grow(known, fresh, edges).write.mode("overwrite").parquet(f"{target}/edges/batch={number}")

    return claims.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(events: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The newest event of each key as a stream in update mode; state older than the watermark is let go."""
    rows = events.withWatermark(time, delay)
    fields = [c for c in events.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), time).alias("last")).select(*keys, "last.*")
