"""Loading a folder that goes on after what it can't read: documents, and problems with their file and line.

Lines of files are numbered without a sort and without reading a file in one piece: rows of a split are in order, so a line's number is its place in its split
and the lines of the file's splits before, which is a sum over a row a split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.chunking import markdown_sections
from .documents import ALIASES

PROBLEM = "file string, line long, reason string, excerpt string"
MALFORMED, ROOT, NO_TEXT, ENCODING = "malformed JSON", "neither an object nor an array of objects", "no text", "not UTF-8"
SHOWN = 80
_MEMBERS = "map<string,string>"
_KNOWN = [n for names in ALIASES.values() for n in names]


@dataclass
class Loaded:
    """``documents`` (doc_id, title, text, source, metadata, file, line) and ``problems`` (file, line from 1 or null, reason, excerpt)."""

    documents: DataFrame
    problems: DataFrame


def _reader(spark: SparkSession, suffix: str, recursive: bool):
    return spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{suffix}")


def _stem(file: str = "file") -> Column:
    return F.regexp_extract(file, r"([^/]*?)(\.[^./]*)?$", 1)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (a text source's value) as (file, line from 0, value)."""
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("row"))
    splits = placed.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")
    offsets = splits.select("file", "start", (before - F.col("first")).alias("offset"))
    return placed.join(offsets, ["file", "start"]).select("file", (F.col("row") + F.col("offset")).alias("line"), "value")


def _document(members: str, fallback: Column) -> dict[str, Column]:
    pick = lambda names: F.coalesce(*[F.element_at(members, n) for n in names])
    return {
        "doc_id": F.coalesce(pick(ALIASES["doc_id"]), fallback),
        "title": F.coalesce(pick(ALIASES["title"]), F.lit("")),
        "text": pick(ALIASES["text"]),
        "source": F.coalesce(pick(ALIASES["source"]), F.lit("")),
        "metadata": F.map_filter(members, lambda k, v: ~k.isin(*_KNOWN)),
    }


def _parted(rows: DataFrame) -> Loaded:
    """``rows`` (file, line, shown, reason, members, fallback): those with a reason are problems, so are those without a text."""
    told = rows.withColumns(_document("members", F.col("fallback"))).withColumn("reason", F.coalesce("reason", F.when(F.col("text").isNull(), NO_TEXT)))
    problems = told.filter("reason is not null").select("file", (F.col("line") + 1).alias("line"), "reason", F.substring("shown", 1, SHOWN).alias("excerpt"))
    return Loaded(told.filter("reason is null").select("doc_id", "title", "text", "source", "metadata", "file", "line"), problems)


def json_lines(spark: SparkSession, folder: str, recursive: bool = True, suffix: str = ".jsonl") -> Loaded:
    """A document a line; blank lines are counted and skipped. A line without an id is named by its file and number."""
    lines = numbered_lines(_reader(spark, suffix, recursive).text(folder)).filter(F.trim("value") != "")
    broken = F.when(~F.is_valid_utf8("value"), ENCODING).when(F.try_parse_json("value").isNull(), MALFORMED).when(~F.ltrim("value").startswith("{"), ROOT)
    rows = lines.select("file", "line", F.col("value").alias("shown"), broken.alias("reason"), F.from_json("value", _MEMBERS).alias("members"), F.concat_ws("_", _stem(), "line").alias("fallback"))
    return _parted(rows)


def json_files(spark: SparkSession, folder: str, recursive: bool = True) -> Loaded:
    """An object or an array of objects in each file."""
    files = _reader(spark, ".json", recursive).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    ok = kind.startswith("OBJECT") | kind.startswith("ARRAY<OBJECT") | (kind == "ARRAY<VOID>")
    broken = F.when(~F.is_valid_utf8("value"), ENCODING).when(kind.isNull(), MALFORMED).when(~ok, ROOT)
    listed = F.when(kind.startswith("OBJECT"), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
    whole = files.select("file", F.col("value").alias("shown"), broken.alias("reason"), F.when(broken.isNull(), listed).alias("listed"))
    bad = whole.filter("reason is not null").select("file", F.lit(None).cast("long").alias("line"), "shown", "reason", F.lit(None).cast(_MEMBERS).alias("members"), F.lit("").alias("fallback"))
    good = whole.filter("reason is null").select("file", "shown", "reason", F.posexplode(F.from_json("listed", f"array<{_MEMBERS}>")).alias("i", "members"))
    rows = good.select("file", F.lit(None).cast("long").alias("line"), "shown", "reason", "members", F.concat_ws("_", _stem(), "i").alias("fallback"))
    return _parted(rows.unionByName(bad))


def texts(spark: SparkSession, folder: str, suffix: str, recursive: bool = True) -> Loaded:
    """Whole files, or their sections under headings."""
    files = _reader(spark, suffix, recursive).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    files = files.select("file", _stem().alias("stem"), "value", F.is_valid_utf8("value").alias("valid"))
    problems = files.filter("not valid").select("file", F.lit(None).cast("long").alias("line"), F.lit(ENCODING).alias("reason"), F.lit("").alias("excerpt"))
    good = files.filter("valid")
    if suffix == ".md":
        parts = markdown_sections(good.select(F.struct("file", "stem").alias("stem"), "value").withColumns({"file": F.col("stem.file"), "stem": F.col("stem.stem")}), "stem", "value")
        named = parts.select("doc_id", "title", "text", F.lit(None).cast("string").alias("file"))
    else:
        named = good.select(F.col("stem").alias("doc_id"), F.col("stem").alias("title"), F.col("value").alias("text"), "file")
    rows = named.select("doc_id", "title", "text", F.lit("").alias("source"), F.create_map().cast(_MEMBERS).alias("metadata"), "file", F.lit(None).cast("long").alias("line"))
    return Loaded(rows, problems)


def load(spark: SparkSession, folder: str, recursive: bool = True, good_lines: bool = False) -> Loaded:
    """All readable files below a folder. A file with a problem gives no document, unless ``good_lines`` keeps what of it can be read."""
    parts = [json_lines(spark, folder, recursive), json_files(spark, folder, recursive), texts(spark, folder, ".txt", recursive), texts(spark, folder, ".md", recursive)]
    documents, problems = parts[0].documents, parts[0].problems
    for p in parts[1:]:
        documents, problems = documents.unionByName(p.documents), problems.unionByName(p.problems)
    if not good_lines:
        documents = documents.join(problems.select("file").distinct(), "file", "left_anti").select(*documents.columns)
    return Loaded(documents, problems)
