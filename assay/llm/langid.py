"""Language identification, word first: a known word counts by its log frequency in each
language; an unseen word falls back to ever shorter character n-grams.

``fit`` learns from a bounded sample: rows are taken by a hash, of each language about as many
as of any other, or all it has; every labelled language gets a row. All words and n-grams of the
sample are in the model, each as a 64-bit hash and one log frequency a language, so the sample bounds its size.

The language of a text is the one under which its words are likeliest; the score says how far its words agree on it: it
is the mean, over the words, of the likelihood that a word gives that language among all. ``predict`` keeps one row
per input row; a text that is null or has no letter is ``und`` with score 0, as is every
text when nothing could be learned. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, saved, table

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
FIT_ROWS = 20_000
#: A language with as many rows has about as many in the sample, however many languages there are.
LEAST_ROWS = 50
HASHES = 1 << 30
#: Longest word that is one unit; a longer run of letters is cut into pieces of at most as many.
LONG_WORD = 64
MEMO = 300_000


def pieces(run: str) -> Iterator[str]:
    """Equal pieces of a long run of letters, each with the letters after it that its last n-grams reach into."""
    marked = f"^{run}$"
    k = -(-len(marked) // LONG_WORD)
    for i in range(k):
        start, end = i * len(marked) // k, (i + 1) * len(marked) // k
        yield f"{marked[start:end]}\n{marked[end : end + LONGEST - 1]}"


def words_of(text: str) -> list[str]:
    """Words, with a run of over LONG_WORD letters as its pieces."""
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) > LONG_WORD:
        return [p for w in words for p in (pieces(w) if len(w) > LONG_WORD else (w,))]
    return words


def grams_of(word: str, n: int) -> list[str]:
    """All n-grams of a word, or those that begin in a piece."""
    piece, cut, after = word.partition("\n")
    word = piece + after if cut else f"^{word}$"
    return [word[i : i + n] for i in range(min(len(piece) if cut else len(word), len(word) - n + 1))]


def hashed(units: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(u.encode()) for u in units], dtype=np.uint64, count=len(units))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def level(rows: list[int], most: int) -> float:
    """The most rows a language may give so that all give ``most`` together."""
    left, rest = most, len(rows)
    for n in sorted(rows):
        if n * rest > left:
            return max(LEAST_ROWS, left / rest)
        left, rest = left - n, rest - 1
    return float("inf")


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> "Model":
    """``docs`` has doc_id, text, lang; rows without a language or a text teach nothing."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(HASHES)))
    given = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.min("h").alias("least")).collect()
    own = level([r["rows"] for r in given], fit_rows)
    if any(r["rows"] > own for r in given):
        cuts = [(r["lang"], max(int(HASHES * min(1.0, own / r["rows"])), r["least"] + 1)) for r in given]
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long")), "lang").filter("h < cut")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text))
            for lang, seen in by.items():
                for n in range(LONGEST + 1):
                    units = Counter() if n else seen
                    for w, c in seen.items() if n else ():
                        for g in grams_of(w, n):
                            units[g] += c
                    h = hashed(list(units)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h), pa.array([lang] * len(h), pa.string()), pa.array(list(units.values()), pa.int64())], ["n", "unit", "lang", "c"])

    counts = map_texts(rows.select("text", "lang"), count, "n int, unit long, lang string, c long")
    return Model(saved(counts.groupBy("n", "unit", "lang").agg(F.sum("c").alias("c")), "counts").toArrow())


class Model:
    """Log frequency of every unit in every language: for each unit length the sorted hashes of units and a matrix."""

    def __init__(self, counted: pa.Table):
        lang = counted["lang"].combine_chunks().dictionary_encode()
        self.langs = sorted(lang.dictionary.to_pylist())
        column = np.array([self.langs.index(x) for x in lang.dictionary.to_pylist()], dtype=np.int64)[lang.indices.to_numpy()]
        n, unit, c = (counted[x].to_numpy() for x in ("n", "unit", "c"))
        self.units, self.logs = [], []
        for size in range(LONGEST + 1):
            at = np.flatnonzero(n == size)
            units, row = np.unique(unit[at].view(np.uint64), return_inverse=True)
            counts = np.full((len(units), len(self.langs)), 0.5)
            counts[row, column[at]] += c[at]
            self.units.append(units)
            self.logs.append(np.log(counts / counts.sum(axis=0)).astype(np.float32) if len(units) else counts.astype(np.float32))

    def rows(self, size: int, units: list[str]) -> np.ndarray:
        """The row of each unit, -1 where it is unknown."""
        known, h = self.units[size], hashed(units)
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        return np.where(known[at] == h, at, -1) if len(known) else np.full(len(h), -1)


class Scorer:
    """A model at work in a task, with the words it has met."""

    def __init__(self, model: Model):
        self.langs, self.model = model.langs, model
        self.memo: dict[str, int] = {}
        self.matrix = np.zeros((0, len(self.langs)))
        self.shares = np.zeros((0, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        """Add relative log probabilities of ``words`` to the memo, by word or by the longest n-grams known."""
        out = np.zeros((len(words), len(self.langs)))
        found = self.model.rows(0, words)
        known = found >= 0
        out[known] = self.model.logs[0][found[known]]
        left = np.flatnonzero(~known).tolist()
        for n in range(LONGEST, 0, -1):
            grams = [grams_of(words[i], n) for i in left]
            size = np.array([len(g) for g in grams], dtype=np.int64)
            rows = self.model.rows(n, [g for own in grams for g in own])
            owner = np.repeat(np.arange(len(left)), size)[rows >= 0]
            hits = np.bincount(owner, minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner, self.model.logs[n][rows[rows >= 0]])
            for i in np.flatnonzero(hits):
                out[left[i]] = sums[i] / hits[i]
            left = [left[i] for i in np.flatnonzero(hits == 0)]
        start = len(self.matrix)
        if words:
            out -= out.max(axis=1, keepdims=True)
            likely = np.exp(out)
            self.matrix = np.concatenate([self.matrix, out])
            self.shares = np.concatenate([self.shares, likely / likely.sum(axis=1, keepdims=True)])
        self.memo.update(zip(words, range(start, start + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for low in range(0, len(texts), 500):
            seen = [Counter(words_of(t)) if t else Counter() for t in texts[low : low + 500]]
            if len(self.memo) > MEMO:
                self.memo.clear()
                self.matrix, self.shares = self.matrix[:0], self.shares[:0]
            if self.langs:
                self.learn([w for w in set().union(*seen) if w not in self.memo])
            for own in seen:
                if not self.langs or not any(c.isalpha() for w in own for c in w):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                rows = np.fromiter(map(self.memo.__getitem__, own), dtype=np.int64, count=len(own))
                times = np.fromiter(own.values(), dtype=np.float64, count=len(own))
                best = int(np.argmax(times @ self.matrix[rows]))
                langs.append(self.langs[best])
                scores.append(float(times @ self.shares[rows, best] / times.sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id unless given) with lang_pred and score."""
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            langs, scores = scorer.predict(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    fields = [f"`{c}` {t}" for c, t in kept.dtypes[: len(keep)]]
    return map_texts(kept, scan, ", ".join([*fields, "lang_pred string", "score double"]))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
