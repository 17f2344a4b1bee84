"""Names that a claim has from its surroundings: the title of its evidence, and the names of its evidence that it repeats.

``mentions`` looks for many names in texts at once: an automaton of all of them in each task, the longest name at the leftmost place, none
within another. Names are broadcast only up to BOUND bytes; beyond that, names and texts meet on the names' first words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TOKEN, names
from .conflict import times

# Endings of a title's names that say what it is about and not whom.
TOPICS = ("销量", "营收", "收入", "利润", "排放", "市场", "规模", "增长", "报告", "进展", "趋势")
BOUND = 16 << 20


def title_names(title: Column) -> Column:
    """The names of a title that its claims may take over."""
    return F.filter(names(F.coalesce(title, F.lit(""))), lambda n: ~n.rlike(f"({'|'.join(TOPICS)})$"))


def anchored(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims`` (evidence_id, claim, entities, times, span, compares) with the names and times that ``evidence`` (evidence_id, title, entities) lends them.

    A claim takes the title's names and times, and of its evidence's names those that it repeats in any case; one that is reported or corrects, or whose
    evidence compares, takes them all.
    """
    lent = evidence.select("evidence_id", title_names(F.col("title")).alias("of_title"), times(F.coalesce("title", F.lit(""))).alias("title_times"), F.coalesce("entities", F.array().cast("array<string>")).alias("of_evidence"))
    low = F.lower("claim")
    every = F.col("span").isin("reported_claim", "corrective_claim") | F.coalesce("compares", F.lit(False))
    own = F.filter("of_evidence", lambda n: every | F.contains(low, F.lower(n)))
    empty = F.array().cast("array<string>")
    rows = claims.join(lent, "evidence_id", "left")
    rows = rows.withColumn("entities", F.array_distinct(F.concat("entities", F.coalesce("of_title", empty), F.coalesce(own, empty))))
    return rows.withColumn("times", F.array_distinct(F.concat("times", F.coalesce("title_times", empty)))).select(*claims.columns)


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a place begins and ends with words."""
    inside = lambda c: c.isalnum() or c == "_"
    return not (start and inside(text[start - 1]) and inside(text[start])) and not (end < len(text) and inside(text[end]) and inside(text[end - 1]))


def _longest(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of places, leftmost first and the longest of a beginning, those that overlap none before."""
    out, last = [], 0
    for start, end in sorted(found, key=lambda p: (p[0], -p[1])):
        if start >= last:
            out.append((start, end))
            last = end
    return out


def mentions(texts: DataFrame, key: str, text: str, patterns: DataFrame, name: str = "name", bound: int = BOUND) -> DataFrame:
    """(key, name, start, end): where ``patterns`` occur in ``texts`` as whole words, in lower case; offsets are of characters."""
    wanted = patterns.select(F.lower(name).alias("name")).filter(F.trim("name") != "").distinct()
    size = wanted.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    rows = texts.select(F.col(key), F.coalesce(F.lower(text), F.lit("")).alias("text"))
    schema = f"{key} {dict(rows.dtypes)[key]}, name string, start long, end long"
    if size <= bound:
        shared = texts.sparkSession.sparkContext.broadcast([r[0] for r in wanted.collect()])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n in shared.value:
                automaton.add_word(n, len(n))
            automaton.make_automaton()
            for b in batches:
                out = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    places = [(end + 1 - n, end + 1) for end, n in automaton.iter(t)] if shared.value else []
                    out += [(k, t[a:z], a, z) for a, z in _longest([p for p in places if _whole(t, *p)])]
                yield pa.RecordBatch.from_pylist([dict(zip([key, "name", "start", "end"], r, strict=True)) for r in out], schema=pa.schema([(key, b.schema.field(0).type), ("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        return rows.mapInArrow(search, schema)
    first = F.regexp_extract("name", TOKEN, 0)
    heads = rows.select(key, "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("first"))
    both = heads.join(wanted.withColumn("first", first), "first").filter(F.contains("text", F.col("name")))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at = t.find(n)
                while at >= 0:
                    out += [(k, n, at, at + len(n))] if _whole(t, at, at + len(n)) else []
                    at = t.find(n, at + 1)
            yield pa.RecordBatch.from_pylist([dict(zip([key, "name", "start", "end"], r, strict=True)) for r in out], schema=pa.schema([(key, b.schema.field(0).type), ("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    found = both.select(key, "text", "name").mapInArrow(places, schema)
    # leftmost and longest: a place stays unless one that stays overlaps it; within a run of overlapping places that is settled in their order
    order = Window.partitionBy(key).orderBy("start", F.desc("end"))
    runs = found.withColumn("edge", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("run", F.sum((F.col("start") >= F.col("edge")).cast("int")).over(order)).groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "name"))).alias("ps"))
    kept = F.aggregate("ps", F.expr("array(cast(null as struct<start:bigint,back:bigint,name:string>))"), lambda a, p: F.when(F.coalesce(-F.element_at(a, -1)["back"], F.lit(0)) <= p["start"], F.concat(a, F.array(p))).otherwise(a))
    return runs.select(key, F.explode(F.filter(kept, lambda p: p.isNotNull())).alias("p")).select(key, "p.name", "p.start", (-F.col("p.back")).alias("end"))
