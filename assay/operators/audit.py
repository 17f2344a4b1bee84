"""Overlap of benchmark items with reference texts: exact containment and shared n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import alnum, ngrams
from ..scratch import saved
from .retrieval import batched

LEAST_CHARS, N, THRESHOLD = 8, 13, 0.85
BITS = 1 << 22
#: Characters that a task looks at together.
PIECE = 1 << 18


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """64 bits of every window of ``n`` code points, from those of windows of powers of two."""
    h = (codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    factor, size, out, done, bits = 0x94D049BB133111EB, 1, None, 0, n
    while bits:
        if bits & 1:
            out = h if out is None else out[: len(h) - done] * np.uint64(factor) + h[done:]
            done += size
        bits >>= 1
        if bits:
            h = h[:-size] * np.uint64(factor) + h[size:]
            factor, size = factor * factor % (1 << 64), 2 * size
    out = out[: max(0, len(codes) - n + 1)]
    return out ^ (out >> np.uint64(32))


def _windows(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, code points, hashes of the windows that begin at each) of texts without nulls, some whole texts at a time; windows may reach into the next text."""
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")))
        codes = np.frombuffer("".join(texts.slice(low, high - low).to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(codes) >= n:
            yield np.arange(low, high), codes, _hashed(codes, n)
        low = high


def _inside(sizes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places ``at`` in joined texts those whose window is inside one text, and the texts."""
    ends = np.cumsum(sizes)
    row = np.searchsorted(ends, at, "right")
    keep = at + n <= ends[row]
    return at[keep], row[keep]


class Filter:
    """A one-hash filter of ``BITS`` bits over grams of ``n`` characters, half a megabyte whatever their number. It only spares
    work: what it lets through by chance the join drops, and a full one lets all through."""

    def __init__(self, grams: DataFrame, n: int):
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, hashes in _windows(batch.column(0), n):  # of grams one after the other
                    yield pa.RecordBatch.from_arrays([pa.array((hashes[::n] % np.uint64(BITS)).astype(np.int64))], ["bit"])

        bits = grams.filter(F.length("gram") == n).select("gram").mapInArrow(places, "bit long")
        words = bits.select(F.floor(F.col("bit") / 64).alias("at"), F.pmod("bit", F.lit(64)).cast("int").alias("bit"))
        words = words.groupBy("at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("word"))
        self.bits, self.n = np.zeros(BITS // 64, np.int64), n
        for r in words.collect():  # at most BITS / 64 rows
            self.bits[r["at"]] = r["word"]


def _found(references: DataFrame, filters: list[Filter], whole: int) -> DataFrame:
    """(doc_id, gram, size): grams of each of ``references`` (doc_id, body) that a filter lets through, each once a row, by one pass over the texts. One of less than ``whole`` characters is a gram itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(f.n, np.unpackbits(f.bits.view(np.uint8), bitorder="little").view(bool)) for f in filters]
        for batch in batches:
            lengths = pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64)
            brief = pa.array((lengths > 0) & (lengths < whole))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(brief), batch.column(1).filter(brief), pa.array(np.full(pc.sum(brief).as_py() or 0, whole, np.int32))], ["doc_id", "gram", "size"])
            for n, table in tables:
                for rows, codes, hashes in _windows(batch.column(1), n):
                    at, row = _inside(lengths[rows], np.flatnonzero(table[(hashes % np.uint64(BITS)).astype(np.int64)]), n)
                    text = codes[at[:, None] + np.arange(n)].tobytes().decode("utf-32-le", "surrogatepass")
                    grams = pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string())
                    own = pa.table({"row": pa.array(rows[row]), "gram": grams}).group_by(["row", "gram"]).aggregate([]).combine_chunks()
                    out = pa.table({"doc_id": batch.column(0).take(own["row"].combine_chunks()), "gram": own["gram"], "size": np.full(len(own), n, np.int32)})
                    yield from out.to_batches()

    filters = [f for f in filters if f.bits.any()]
    kind = references.schema["doc_id"].dataType.simpleString()
    return batched(references.filter("body is not null")).mapInArrow(work, f"doc_id {kind}, gram string, size int")


class Overlap:
    """The grams of ``items`` (item_id, body) that each of ``references`` (doc_id, body) has, found in one pass and kept for exact and near findings alike. Bodies are normalised.

    ``body`` makes that of a reference from its other columns: then it is made once, and again only of references that exact findings look at.
    """

    def __init__(self, items: DataFrame, references: DataFrame, n: int = N, least: int = LEAST_CHARS, body: Column | str = "body"):
        self.body = F.col(body) if isinstance(body, str) else body
        self.items, self.references, self.n, self.least = items, references, n, least
        self.own = items.select("item_id", ngrams(F.col("body"), n).alias("grams"))
        self.grams = self.own.select("item_id", F.explode("grams").alias("gram"))
        wanted = items.filter(F.length("body") >= least)
        head = lambda size: F.substring("body", 1, size).alias("gram")
        short = wanted.filter(F.length("body") < n).select("item_id", head(least), F.lit(least).alias("size"))
        self.heads = wanted.filter(F.length("body") >= n).select("item_id", head(n), F.lit(n).alias("size")).unionByName(short)
        filters = [Filter(self.grams, n), *([Filter(short, least)] if least < n else [])]
        self.found = saved(_found(references.select("doc_id", self.body.alias("body")), filters, n), "grams")

    def shared(self) -> DataFrame:
        """(item_id, doc_id, shared, item_grams) of pairs with a common gram."""
        pairs = self.found.filter(F.col("size") == self.n).join(self.grams, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
        return pairs.join(self.own.select("item_id", F.size("grams").cast("long").alias("item_grams")), "item_id")

    def near(self, threshold: float = THRESHOLD) -> DataFrame:
        """Pairs whose Jaccard index or share of the item's grams reaches the threshold; the index is never the larger."""
        return self.shared().withColumn("score", F.round(F.col("shared") / F.col("item_grams"), 6)).filter(F.col("score") >= threshold)

    def exact(self) -> DataFrame:
        """(item_id, doc_id, at): items of at least ``least`` characters inside a reference, and the first offset.

        A reference that contains an item has the item's first characters among its grams, so an
        equi-join on that head finds every candidate: ``n`` characters, or ``least`` of shorter items.
        """
        found = self.found.join(self.heads, ["gram", "size"]).select("item_id", "doc_id")
        hits = found.join(self.items.select("item_id", F.col("body").alias("item")), "item_id").join(self.references, "doc_id").withColumn("body", self.body)
        return hits.withColumn("at", F.instr("body", F.col("item")).cast("long") - 1).filter("at >= 0").select("item_id", "doc_id", "at")


def shared_grams(items: DataFrame, references: DataFrame, n: int = N) -> DataFrame:
    """(item_id, doc_id, shared, item_grams, doc_grams) of pairs with a common gram."""
    sizes = references.select("doc_id", F.size(ngrams(F.col("body"), n)).cast("long").alias("n")).groupBy("doc_id").agg(F.max("n").alias("doc_grams"))
    return Overlap(items, references, n).shared().join(sizes, "doc_id")


def near(items: DataFrame, references: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    return Overlap(items, references, n).near(threshold)


def exact(items: DataFrame, references: DataFrame, least: int = LEAST_CHARS, n: int = N) -> DataFrame:
    return Overlap(items, references, n, least).exact()


def normalised(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    return rows.select(key, alnum(F.col(text)).alias("body"))


EXCERPT = 160


def places(text: Column) -> Column:
    """Offsets of the characters that normalised text keeps."""
    return F.filter(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.substr(text, i + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]"))


def excerpt(text: Column, start: Column, end: Column, limit: int = EXCERPT) -> Column:
    """Up to ``limit`` characters around a match, white space as one, with an ellipsis on a side where text is left out."""
    size = F.length(text)
    low = F.greatest(F.lit(0), start - F.greatest(F.lit(0), F.floor((limit - (end - start)) / 2).cast("int")))
    high = F.least(size, low + limit)
    low = F.greatest(F.lit(0), high - limit)
    plain = F.trim(F.regexp_replace(F.substr(text, low + 1, high - low), r"\s+", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), plain, F.when(high < size, "…").otherwise(""))


def best_windows(pairs: DataFrame, items: DataFrame, references: DataFrame, n: int = N) -> DataFrame:
    """(item_id, doc_id, hits, low, high): where a reference has most of an item's grams within the item's length.

    ``items`` (item_id, body) and ``references`` (doc_id, body) are normalised, offsets are those of the normalised reference. Of windows with as many
    grams the first counts. ``hits`` are the grams in the window, 0 where the texts are shorter than a gram, and then the window is the whole reference.
    A window's first gram is found by a running count: the grams that begin before it are those of a merged order of beginnings and bounds.
    """
    at_every = F.regexp_extract_all("body", F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    asked = items.join(pairs.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.greatest(F.length("body"), F.lit(n)).alias("window"), F.explode(ngrams(F.col("body"), n)).alias("gram"))
    found = references.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(at_every).alias("pos", "gram"))
    hits = found.join(asked, "gram").join(pairs.select("item_id", "doc_id"), ["item_id", "doc_id"]).select("item_id", "doc_id", "pos", "window")
    pair = ["item_id", "doc_id"]
    hits = hits.withColumn("i", F.row_number().over(Window.partitionBy(*pair).orderBy("pos")) - 1)
    begins = hits.select(*pair, "pos", "window", "i", F.col("pos").alias("at"), F.lit(1).alias("hit"))
    bounds = hits.select(*pair, "pos", "window", "i", (F.col("pos") - F.col("window")).alias("at"), F.lit(0).alias("hit"))
    order = Window.partitionBy(*pair).orderBy("at", "hit").rowsBetween(Window.unboundedPreceding, 0)
    ends = begins.unionByName(bounds).withColumn("first", F.sum("hit").over(order).cast("int")).filter("hit = 0")
    best = ends.groupBy(*pair).agg(F.min(F.struct((F.col("first") - F.col("i")).alias("less"), "i", "first", "pos", "window")).alias("b"))
    best = best.select(*pair, "b.first", (1 - F.col("b.less")).alias("hits"), F.col("b.pos").alias("last"), "b.window")
    starts = hits.select(*pair, F.col("i").alias("first"), F.col("pos").alias("low"))
    sizes = references.select("doc_id", F.length("body").alias("size"))
    placed = pairs.select(*pair).join(best.join(starts, [*pair, "first"]), pair, "left").join(sizes, "doc_id")
    high = F.least("size", F.greatest(F.col("low") + F.col("window"), F.col("last") + n))
    return placed.select(*pair, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("low", F.lit(0)).alias("low"), F.coalesce(high, "size").alias("high"))


def near_excerpts(pairs: DataFrame, items: DataFrame, texts: DataFrame, n: int = N) -> DataFrame:
    """``best_windows`` of ``texts`` (doc_id, text) in their own offsets, with the excerpt around: item_id, doc_id, hits, start, end, excerpt."""
    own = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    windows = best_windows(pairs, items, normalised(own, "doc_id"), n)
    placed = windows.join(own.select("doc_id", "text", places(F.col("text")).alias("places")), "doc_id")
    start, end = F.get("places", F.col("low")), F.get("places", F.col("high") - 1) + 1
    return placed.select("item_id", "doc_id", "hits", start.alias("start"), end.alias("end"), excerpt(F.col("text"), start, end).alias("excerpt"))
