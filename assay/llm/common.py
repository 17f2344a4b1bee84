"""What the operators of this package share: reading, scratch tables, row ids, word rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import saved

#: A word is a maximal run of bytes other than these six.
SPACES = b" \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: Rows of an Arrow batch of texts: texts are long, and a worker holds a batch in several forms at once.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over rows with texts; from then on the session hands Python at most BATCH_ROWS rows at once."""
    conf = rows.sparkSession.conf
    if int(conf.get(_BATCH)) > BATCH_ROWS:
        conf.set(_BATCH, BATCH_ROWS)
    return rows.mapInArrow(work, schema)


def with_row_id(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """``columns`` with a unique long ``rid``: the key itself where it is unique and never null.

    Otherwise a numbered copy is written, so that every later read sees the same numbers.
    """
    kept = docs.select(F.col(key).cast("long").alias(key), *[c for c in columns if c != key])
    seen = kept.groupBy(key).count().agg(F.max("count").alias("most"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    if (seen["most"] or 0) <= 1 and not seen["nulls"]:
        return kept.withColumn("rid", F.col(key))
    return saved(kept.withColumn("rid", F.monotonically_increasing_id()), "numbered")


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``most``; one oversized item stands alone."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
