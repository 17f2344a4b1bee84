"""Phrase collocations by Toivonen mining: a sample proposes, a full pass counts, failures at the border expand.

Frequent phrases are those of 1 to ``most`` words that occur at least ``least`` times in a language; a part of a frequent phrase
is frequent. A sample of the places where phrases begin, dealt by a hash of the document's id and the place, proposes the phrases
that look frequent there. Their negative border is what is not proposed but has only proposed parts (its words without the last, and
without the first); every word that is not proposed belongs to it. A full pass counts proposed phrases and border exactly. A
frequent phrase that was not proposed is a failure: it joins the proposed ones, and a further pass counts the border that it
adds, until there is no failure. Then all frequent phrases have been counted.

The border is never written down: a task counts a phrase when both its parts are held by a filter of the proposed ones. The filter
is a bitmap of 2**16 to 2**27 bits, sized by their number, over XXH64; what it holds by chance is counted exactly like the rest,
so it costs counts but never changes a result. Within a task words are interned (``intern.Table``) and phrases are pairs of
numbers, so counts are summed before they are shuffled; phrases are grouped as texts, never as hashes.

Only A-Z are lower-cased. A null text is empty; a null language is ``und`` and one with it. Repeated rows count each. Texts and words
of any length are read whole, in parts. Without words, or without frequent phrases, the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, raw_texts, saved, table
from .intern import Table, Words, words, xxh64
from .windows import mix

MOST, LEAST, INSIDE, TOP = 5, 100, 100, 2_000
#: One place in SHARE is in the sample; a phrase is proposed that begins at SAMPLE_LEAST of them. Of phrases that occur LEAST times
#: one in 40,000 is missed so, however its occurrences lie.
SHARE, SAMPLE_LEAST = 8, 2
SALTS = 8
#: Bytes of texts whose phrases are counted together in a task.
BYTES = 1 << 21
#: XXH64 as Spark's ``xxhash64`` seeds it.
SEED = 42
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?\n\v\f\r"]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False


def _lowest(name: str) -> F.Column:
    """1 at the bit that the lowest six bits of a print name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(name).bitwiseAND(F.lit(63)).cast("int"))


class Proposed:
    """A bitmap over the prints of phrases: XXH64 of phrase and language, as Spark's ``xxhash64`` gives it. ``rows`` (at, set) is its table, in the shared folder."""

    def __init__(self, prints: DataFrame, before: Proposed | None = None):
        self.bits = before.bits if before else min(27, max(16, (32 * prints.count()).bit_length()))
        own = prints.select(F.shiftrightunsigned("print", 70 - self.bits).alias("at"), _lowest("print").alias("set"))
        own = own.unionByName(before.rows) if before else own
        self.rows = saved(own.groupBy("at").agg(F.bit_or("set").alias("set")), "bitmap")
        words = np.zeros(1 << self.bits - 6, dtype=np.uint64)
        rows = self.rows.toArrow()  # at most 2**21 rows
        words[rows["at"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
        self.shared = prints.sparkSession.sparkContext.broadcast(words)

    def lacking(self, prints: DataFrame) -> DataFrame:
        """Those of ``prints`` that the filter does not hold."""
        there = prints.withColumn("at", F.shiftrightunsigned("print", 70 - self.bits)).join(self.rows, "at", "left")
        return there.filter(F.coalesce("set", F.lit(0)).bitwiseAND(_lowest("print")) == 0).select("print")


def _holds(filter_: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints >> np.uint64(64 - (len(filter_).bit_length() - 1))
    return (filter_[at.astype(np.int64)] >> (prints & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Runs:
    """Phrases of one length in a part: where they begin, which they are, and of each distinct one where it first begins."""

    def __init__(self, part: Words, langs: np.ndarray):
        self.part, self.k, self.lang = part, 1, langs[part.text]
        slots = Table(part.data, len(part.start)).put(part.start, part.end)
        _, self.at, self.word = np.unique(slots * (int(langs.max()) + 1) + self.lang, return_index=True, return_inverse=True)
        self.ids, self.own, self.forms = np.arange(len(slots)), self.word, len(self.at)

    def longer(self, ids: np.ndarray) -> None:
        """Phrases of one word more at ``ids``, where such phrases begin within one piece."""
        part, here = self.part, np.zeros(len(self.word), dtype=np.int64)
        here[self.ids] = self.own
        ids = ids[ids + self.k < len(self.word)]
        self.ids = ids[part.piece[ids + self.k] == part.piece[ids]]
        _, at, self.own = np.unique(here[self.ids] * self.forms + self.word[self.ids + self.k], return_index=True, return_inverse=True)
        self.at, self.k = self.ids[at], self.k + 1

    def spread(self, of_phrase: np.ndarray) -> np.ndarray:
        """What holds of a phrase, at the places where it begins."""
        out = np.zeros(len(self.word) + 1, dtype=bool)
        out[self.ids] = of_phrase[self.own]
        return out

    def count(self) -> np.ndarray:
        return np.bincount(self.own[self.ids < self.part.own], minlength=len(self.at))

    def prints(self, seeds: np.ndarray) -> np.ndarray:
        return xxh64(self.part.data, self.part.start[self.at], self.part.end[self.at + self.k - 1], seeds[self.lang[self.at]])


def _sampled(part: Words, langs: np.ndarray, seeds: np.ndarray, of_doc: np.ndarray, most: int, share: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(prints, counts) of the phrases that begin at one place in ``share``.

    Which places follows from how texts are dealt to tasks; that bears on what is proposed, never on the result.
    """
    runs = _Runs(part, langs)
    runs.ids = np.flatnonzero(mix(of_doc[part.text] + np.arange(len(part.text), dtype=np.uint64)) % np.uint64(share) == 0)
    runs.own = runs.word[runs.ids]
    while len(runs.ids):
        n = runs.count()
        some = np.flatnonzero(n)
        yield runs.prints(seeds)[some].view(np.int64), n[some]
        if runs.k == most:
            return
        runs.longer(runs.ids)


def _border(part: Words, langs: np.ndarray, seeds: np.ndarray, most: int, new: np.ndarray, old: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(language, first byte, end, count) of phrases whose parts ``new`` holds, but for those counted when ``old`` was new."""
    runs = _Runs(part, langs)
    counted = np.full(len(runs.word) + 1, old is not None)  # words are, whatever was proposed
    while len(runs.ids):
        n = runs.count()
        n[counted[runs.at]] = 0
        some = np.flatnonzero(n)
        at = runs.at[some]
        yield runs.lang[at], part.start[at], part.end[at + runs.k - 1], n[some]
        if runs.k == most:
            return
        prints = runs.prints(seeds)
        if old is not None:
            held = runs.spread(_holds(old, prints)) & counted
            counted = held & np.append(held[1:], False)
        held = runs.spread(_holds(new, prints))
        runs.longer(np.flatnonzero(held[:-1] & held[1:]))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    to = np.concatenate([[0], np.cumsum(size)])
    own = data[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(own)]).cast(pa.string())


def _read(docs: DataFrame, work, most: int, schema: str) -> DataFrame:
    """``work`` on the parts of the texts: (part, language of each text, seeds and names of languages, seed of each text)."""
    rows = docs.select(F.xxhash64("doc_id").alias("seed"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(1).dictionary_encode()
            seeds = np.array([xxhash.xxh64_intdigest(x.encode(), SEED) for x in names.dictionary.to_pylist()], dtype=np.uint64)
            for part in words(*raw_texts(b.column(2)), _WORD, _BREAK, reach=most - 1, size=BYTES):
                yield from work(part, names.indices.to_numpy().astype(np.int64), seeds, names.dictionary, b.column(0).to_numpy().view(np.uint64))

    return map_texts(rows, read, schema)


def sample(docs: DataFrame, most: int = MOST, share: int = SHARE) -> DataFrame:
    """(print, n) of phrases of up to ``most`` words at a ``share``-th of the places where phrases begin."""

    def work(part, langs, seeds, _, of_doc):
        for prints, n in _sampled(part, langs, seeds, of_doc, most, share):
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(n)], ["print", "n"])

    return _read(docs, work, most, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, new: Proposed, old: Proposed | None = None, most: int = MOST) -> DataFrame:
    """(lang, phrase, n): phrases of up to ``most`` words whose parts ``new`` holds, but for those counted with ``old``.

    The empty phrase counts all words.
    """
    shared_new, shared_old = new.shared, old and old.shared

    def work(part, langs, seeds, names, _):
        if not shared_old:
            total = np.bincount(langs[part.text[: part.own]], minlength=len(seeds))
            yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(seeds)), pa.array(total)], ["lang", "phrase", "n"])
        for lang, start, end, n in _border(part, langs, seeds, most, shared_new.value, shared_old and shared_old.value):
            for i, j in _bounded(end - start):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[i:j])), _strings(part.data, start[i:j], end[i:j]), pa.array(n[i:j])], ["lang", "phrase", "n"])

    return _read(docs, work, most, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _bounded(sizes: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of items of at most so many bytes, or of one item."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def n_words(phrase: str = "phrase") -> F.Column:
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def frequent(docs: DataFrame, most: int = MOST, least: int = LEAST, share: int = SHARE, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """(lang, phrase, n) of all frequent phrases, and of each language the empty phrase with all its words."""
    enough = (F.col("n") >= least) | (F.col("phrase") == "")
    # phrases of ``most`` words are no parts, so nobody asks whether they are proposed
    proposed = saved(sample(docs, most - 1, share).filter(F.col("n") >= sample_least).select("print"), "proposed")
    now, before, passes = Proposed(proposed), None, []
    while True:
        passes.append(saved(counts(docs, now, before, most).filter(enough), "frequent"))
        parts = passes[-1].filter((F.col("phrase") != "") & (n_words() < most))
        failures = saved(now.lacking(parts.select(F.xxhash64("lang", "phrase").alias("print"))), "failures")
        if failures.isEmpty():
            break
        now, before = Proposed(failures, now), now
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, **sampling: int) -> DataFrame:
    """Of each language the ``top`` candidates by score: lang, rank, phrase, a, l, r, n, score.

    A candidate is a frequent phrase of two words or more. It is dropped where a longer one that contains it has at least
    ``inside`` percent of its occurrences; that is so where one of a word more has, as parts are no rarer than the whole.
    """
    known = saved(frequent(docs, most, least, **sampling).withColumn("k", F.when(F.col("phrase") != "", n_words()).otherwise(0)), "phrases")
    candidates = known.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    longer = candidates.filter("k > 2").withColumn("ws", F.split("phrase", " "))
    part = lambda first: F.array_join(F.slice("ws", first, F.col("k") - 1), " ")
    longer = longer.select("lang", F.explode(F.array(part(1), part(2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True))).drop("longer")

    ws = kept.withColumn("ws", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    ws = ws.select("lang", "phrase", "a", "cut", F.array_join(F.slice("ws", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("ws", F.col("cut") + 1, F.col("k")), " ").alias("right"))
    # a common word begins or ends very many phrases: it is looked up in several tasks
    salted = lambda name, n: known.filter("k > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ws = ws.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cuts = ws.join(salted("left", "l"), ["lang", "left", "salt"]).join(salted("right", "r"), ["lang", "right", "salt"])
    totals = known.filter("k = 0").select("lang", F.col("n").alias("words"))
    cuts = cuts.join(totals, "lang").withColumn("up", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("words").cast("decimal(17,0)"))
    cuts = cuts.withColumn("score", F.expr("up div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = cuts.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", F.col("words").alias("n"), "b.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return rows.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: All phrases of each length, counted and cut.
OP11_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY 1),
counted AS (SELECT lang, k, p, count(*)::HUGEINT AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS p FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
  GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.p, c.k, c.f AS a, j, x.f AS l, y.f AS r, n, 1000 * c.f * n // (x.f * y.f) AS score
  FROM (SELECT *, string_split(p, ' ') AS ws, unnest(range(1, k)) AS j FROM counted WHERE k > 1) c JOIN totals USING (lang)
  JOIN counted x ON x.lang = c.lang AND x.p = array_to_string(c.ws[1:j], ' ') JOIN counted y ON y.lang = c.lang AND y.p = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT lang, p, a, n, arg_min({'l': l, 'r': r}, score * 10 + j) AS b, min(score) AS score FROM cuts GROUP BY 1, 2, 3, 4),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.lang = b.lang AND c.f >= b.a AND len(c.p) > len(b.p) AND contains(' ' || c.p || ' ', ' ' || b.p || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT lang, rank, p AS phrase, a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
