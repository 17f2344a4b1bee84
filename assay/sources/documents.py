"""Readers of documents: by suffix, with field aliases and everything else as metadata."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import markdown_sections

SUFFIXES = (".jsonl", ".json", ".txt", ".md")
#: doc_id, title, text, source, metadata
ALIASES = {"doc_id": ("doc_id", "id"), "title": ("title",), "text": ("content", "text"), "source": ("source",)}


def _stem() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def _text(spark: SparkSession, path: str, pattern: str | None, whole: bool = False) -> DataFrame:
    """Lines or whole files of ``path``; with ``pattern``, of the files below it that have such a name."""
    reader = spark.read
    return (reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern) if pattern else reader).text(path, wholetext=whole)


def from_members(rows: DataFrame, fallback: str = "fallback") -> DataFrame:
    """Documents from ``rows`` (members MAP<STRING,STRING>, fallback): aliases are read in order, the rest is metadata.

    A document without a string text is an error that names its fallback id.
    """
    known = [n for names in ALIASES.values() for n in names]
    pick = lambda names: F.coalesce(*[F.element_at("members", n) for n in names])
    text = pick(ALIASES["text"])
    checked = F.when(text.isNull(), F.raise_error(F.concat(F.lit("no text in "), F.col(fallback)))).otherwise(text)
    return rows.select(
        F.coalesce(pick(ALIASES["doc_id"]), F.col(fallback)).alias("doc_id"),
        F.coalesce(pick(ALIASES["title"]), F.lit("")).alias("title"),
        checked.alias("text"),
        F.coalesce(pick(ALIASES["source"]), F.lit("")).alias("source"),
        F.map_filter("members", lambda k, v: ~k.isin(*known)).alias("metadata"),
    )


def read_jsonl(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One document a line; blank lines are skipped, a malformed one stops the read. Lines without an id are numbered, equal ones apart."""
    lines = _text(spark, path, pattern).select("value", _stem().alias("stem")).filter(F.trim("value") != "")
    lines = lines.withColumn("fallback", F.concat_ws("_", "stem", F.monotonically_increasing_id()))
    parsed = lines.withColumn("members", F.from_json("value", "map<string,string>"))
    broken = F.col("members").isNull() | (F.size("members") == 0)
    checked = parsed.withColumn("members", F.when(broken, F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 80)))).otherwise(F.col("members")))
    return from_members(checked)


def read_json(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """An object or an array of objects in each file."""
    files = _text(spark, path, pattern, True).select("value", _stem().alias("stem"))
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    rows = files.select("stem", F.posexplode(F.from_json(listed, "array<map<string,string>>")).alias("i", "members"))
    return from_members(rows.withColumn("fallback", F.concat_ws("_", "stem", "i")))


def read_text(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Each file is one document."""
    files = _text(spark, path, pattern, True).select(_stem().alias("stem"), "value")
    return files.select(F.col("stem").alias("doc_id"), F.col("stem").alias("title"), F.col("value").alias("text"), F.lit("").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))


def read_markdown(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    files = _text(spark, path, pattern, True).select(_stem().alias("stem"), "value")
    sections = markdown_sections(files, "stem", "value")
    return sections.select("doc_id", "title", "text", F.lit("").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))


READERS = {".jsonl": read_jsonl, ".json": read_json, ".txt": read_text, ".md": read_markdown}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file or glob, by its suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or 'a path without suffix'}; one of {', '.join(SUFFIXES)}")
    return READERS[suffix](spark, path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All readable files below a folder, one scan for each suffix, so any store will do and no file name passes through the driver's Python."""
    out = None
    for suffix, reader in READERS.items():
        part = reader(spark, path, f"*{suffix}")
        out = part if out is None else out.unionByName(part)
    return out


def checked_ids(docs: DataFrame) -> DataFrame:
    """``docs`` if every id is non-blank and unique and every text is non-blank, else an error on use."""
    bad = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.length(F.trim("text"))).alias("least"))
    bad = bad.filter("n > 1 or least = 0 or least is null or trim(doc_id) = '' or doc_id is null")
    found = bad.limit(1).collect()
    if found:
        raise ValueError(f"doubled or blank document {found[0]['doc_id']!r}")
    return docs


def write_split(rows: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Write JSON lines by split; (split, n, digest), the digest being the sum of the row digests, to which equal rows add each."""
    rows.write.partitionBy(split).json(path)
    line = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != split])), 256)
    counts = rows.select(split, line.alias("d"))
    return counts.groupBy(split).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("d", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))
