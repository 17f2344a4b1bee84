"""Chunking of documents: fixed windows, sentences, paragraphs, headings, and merging of small chunks.

All folds are ordered higher-order functions inside the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

STRATEGIES = ("fixed", "sentence", "paragraph", "heading")


def check(size: int, overlap: int, least: int, strategy: str) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if least < 0:
        raise ValueError("least must not be negative")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")


def fixed(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, one each ``size - overlap``; a look-ahead takes them in one pass."""
    stride = size - overlap
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{stride}}}"), F.lit(1))


def packed(parts: Column, size: int, glue: str, oversized, overlap: int = 0) -> Column:
    """Neighbouring parts joined by ``glue`` while they fit into ``size``.

    With ``overlap`` a chunk begins with the last parts of the one before, as many as fit into that many characters. A part
    longer than ``size`` ends the chunk and becomes the chunks that ``oversized`` makes of it; nothing overlaps it.
    """
    texts = F.array().cast("array<string>")
    joined = lambda ps: F.array_join(ps, glue)
    closed = lambda s: F.when(F.size(s["open"]) == 0, s["done"]).otherwise(F.concat(s["done"], F.array(joined(s["open"]))))

    def tail(ps: Column) -> Column:
        """The last parts that together fit into the overlap."""
        if not overlap:
            return texts
        start = F.struct(texts.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def back(t: Column, p: Column) -> Column:
            n = t["n"] + F.length(p) + F.when(F.size(t["kept"]) > 0, 1).otherwise(0)
            on = t["on"] & (n <= overlap)
            return F.struct(F.when(on, F.concat(F.array(p), t["kept"])).otherwise(t["kept"]).alias("kept"), F.when(on, n).otherwise(t["n"]).alias("n"), on.alias("on"))

        return F.aggregate(F.reverse(ps), start, back, lambda t: t["kept"])

    def step(s: Column, p: Column) -> Column:
        long = F.length(p) > size
        length = F.length(joined(s["open"]))
        full = (F.size(s["open"]) > 0) & (length + len(glue) + F.length(p) > size)
        done = F.when(long, F.concat(closed(s), oversized(p))).when(full, closed(s)).otherwise(s["done"])
        opened = F.when(long, texts).when(full, F.concat(tail(s["open"]), F.array(p))).otherwise(F.concat(s["open"], F.array(p)))
        return F.struct(done.alias("done"), opened.alias("open"))

    return F.aggregate(parts, F.struct(texts.alias("done"), texts.alias("open")), step, closed)


def sentences(text: Column) -> Column:
    """Parts that end after a full stop, an exclamation or a question mark, Latin or Chinese."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？.!?])\s*"), stripped), lambda p: p != "")


def by_sentence(text: Column, size: int, overlap: int) -> Column:
    """Sentences of a text, packed; a longer one becomes fixed windows."""
    return packed(sentences(text), size, " ", lambda p: fixed(p, size, overlap), overlap)


def oversized(text: Column, size: int, overlap: int) -> Column:
    """A part that is too long: by sentences where it has several, else by fixed windows."""
    return F.when(F.size(sentences(text)) > 1, by_sentence(text, size, overlap)).otherwise(fixed(text, size, overlap))


def split(text: Column, strategy: str, size: int, overlap: int) -> Column:
    if strategy == "fixed":
        return fixed(text, size, overlap)
    if strategy == "sentence":
        return by_sentence(text, size, overlap)
    blank = r"\n\s*\n" if strategy == "paragraph" else r"\n(?=#{1,4}\s)"
    parts = F.filter(F.transform(F.split(text, blank), stripped), lambda p: p != "")
    if strategy == "heading":
        return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > size, oversized(p, size, overlap)).otherwise(F.array(p))))
    return packed(parts, size, "\n\n", lambda p: oversized(p, size, overlap))


def merged(chunks: Column, least: int) -> Column:
    """A chunk shorter than ``least`` joins its predecessor by a line break; leading ones wait for the next."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    line = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n"), b))

    def step(s: Column, c: Column) -> Column:
        small, some = F.length(c) < least, F.size(s["done"]) > 0
        grown = F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(F.concat(F.element_at(s["done"], -1), F.lit("\n"), c)))
        done = F.when(small & some, grown).when(small, s["done"]).otherwise(F.concat(s["done"], F.array(line(s["held"], c))))
        return F.struct(done.alias("done"), F.when(small & ~some, line(s["held"], c)).otherwise(F.lit("")).alias("held"))

    return F.aggregate(chunks, empty, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 64, strategy: str = "fixed", least: int = 50) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text). A document shorter than ``least`` is one stripped chunk.

    With fixed windows the last one may lie inside its predecessor and is then appended to it, text and
    all; this is kept on purpose.
    """
    check(size, overlap, least, strategy)
    body = F.coalesce(F.col(text), F.lit(""))
    pieces = F.when(F.length(body) < least, F.filter(F.array(F.trim(body)), lambda p: p != "")).otherwise(merged(split(body, strategy, size, overlap), least))
    rows = docs.select(F.col(key).alias("doc_id"), F.posexplode(pieces).alias("chunk_index", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_c"), F.col("chunk_index")).alias("chunk_id"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def document_of(chunk_id: Column) -> Column:
    """The document of a chunk id: all before the last ``_c``."""
    return F.regexp_replace(chunk_id, r"_c[^_]*$", "")


def markdown_sections(docs: DataFrame, stem: str, text: str) -> DataFrame:
    """(doc_id, title, text): sections that begin with a heading of level 1 to 3."""
    parts = docs.select(stem, F.posexplode(F.split(text, r"\n(?=#{1,3}\s)")).alias("i", "part"))
    title = F.trim(F.regexp_extract("part", r"^#{1,3}\s+([^\n]*)", 1))
    return parts.filter(F.trim("part") != "").select(F.concat(F.col(stem), F.lit("_s"), "i").alias("doc_id"), title.alias("title"), F.trim("part").alias("text"))
