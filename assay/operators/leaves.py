"""String leaves of nested JSON: one row a string, under the path that leads to it.

Objects and arrays are descended level by level: what a level holds is exploded as VARIANT values inside the JVM, strings are leaves, objects and
arrays are the next level. So the number of passes is the depth of the deepest value, and no value is looked into twice. Numbers, booleans and nulls are
no text. A text that is no JSON (or has a member twice) is one leaf itself, without a path; what follows a
value is not read. Blank leaves are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved

ROOT = "$"


def _typed(rows: DataFrame) -> DataFrame:
    kind = F.schema_of_variant("value")
    return rows.withColumn("kind", F.when(kind == "STRING", "string").when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), "inner"))


def leaves(rows: DataFrame, key: str, text: str, deepest: int | None = None) -> DataFrame:
    """(key, path, text) of the string leaves of ``rows``; paths look like ``$.a[0].b``. With ``deepest``, only so many levels are descended."""
    parsed = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("whole"), F.try_parse_json(text).alias("value"))
    raw = parsed.filter("value is null").select("key", F.lit(None).cast("string").alias("path"), F.col("whole").alias("text"))
    level = _typed(parsed.filter("value is not null").select("key", F.lit(ROOT).alias("path"), "value"))
    found, depth = [raw], 0
    while True:
        level = saved(level.filter("kind is not null"), "level")
        found.append(level.filter("kind = 'string'").select("key", "path", F.expr("variant_get(value, '$', 'string')").alias("text")))
        inner = level.filter("kind = 'inner'")
        if depth == deepest or inner.isEmpty():
            break
        level, depth = _typed(_inside(inner)), depth + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.filter(F.trim("text") != "").withColumnRenamed("key", key)


def _inside(rows: DataFrame) -> DataFrame:
    """The members of objects and arrays."""
    spark = rows.sparkSession
    members = rows.select("key", F.col("path").alias("above"), F.col("value").alias("outer_value")).lateralJoin(spark.tvf.variant_explode(F.col("outer_value").outer()).withColumnsRenamed({"key": "name", "value": "member"}))
    step = F.when(F.col("name").isNotNull(), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
    return members.select("key", F.concat("above", step).alias("path"), F.col("member").alias("value"))


def file_leaves(lines: DataFrame, deepest: int | None = None) -> DataFrame:
    """(source_id, text) of files given as (name, line, text), line null for whole files: ``name:line:path`` or, of raw text, ``name:line``."""
    keyed = lines.select(F.concat_ws(":", "name", "line").alias("source"), "text")
    found = leaves(keyed, "source", "text", deepest)
    return found.select(F.concat_ws(":", "source", "path").alias("source_id"), "text")
