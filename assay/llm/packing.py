"""Harmonic packing of token sequences.

A document's ids are cut into pieces that suit reciprocal-capacity classes: class k holds
pieces longer than capacity/(k+1) and no longer than capacity/k, and each of its bins takes exactly
k of them. A remainder that would leave more than ``WASTE`` of its class's bins empty is cut at
the next class size first. Lengths up to ``SMALL`` have a class each.

Bins are filled inside a slot of (class, hash), so workers need nothing of each other; the
pieces that do not fill a bin, fewer than k in each slot, are dealt again in fewer slots, until
one slot a class is left. What remains then is bounded by the classes and is packed first-fit.

A null text is empty and has the end id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, saved, table

CAPACITY, END = 2048, 1
SMALL, WASTE = 64, 0.03
MEMO = 600_000
PIECES_A_SLOT = 20_000
#: White space that splits words here but not in the tokenizer.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words that Unicode normalisation leaves alone, and how the vocabulary splits them once in lower case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Byte-level vocabularies write a byte that is no printable character as a character from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_END = END.to_bytes(4, "little")


class _Memo(dict):
    """Remembers what ``make`` returns; a hit costs one look-up."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes, by a vocabulary whose tokens never span white space.

    Words are remembered. A new word of plain letters, digits and signs is lower-cased and split
    by the vocabulary's own rule here, and only its model is asked, once for each part; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.parts = _Memo(self.word), _Memo(self.part)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:  # a special token, maybe
            return self.whole(word)
        parts = _SPLIT.findall(word.lower())
        return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if len(self.words) > MEMO:
                self.words.clear()
                self.parts.clear()
            if not text:
                yield _END
            elif any(s in text for s in _SEPARATORS):
                yield self.whole(text) + _END
            else:
                yield b"".join(map(self.words.__getitem__, text.split())) + _END


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """How many pieces of this length a bin of its class takes."""
    return capacity // length


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest <= SMALL or k * rest >= (1 - WASTE) * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and nth (a document's pieces in order)."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                own, rows = [], []
                for i, raw in enumerate(encoder.encode(part.column(1).to_pylist())):
                    start, n = 0, len(raw) // 4
                    for length in cuts(n):
                        own.append(i)
                        rows.append((start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n))
                        start += length
                columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), *map(pa.array, columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_texts(kept, scan, f"doc_id {dict(kept.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


def _first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bounded rest, longest first, into the first bin with room."""
    parts = list(batches)
    if not parts:
        return
    rest = pd.concat(parts)
    rest = rest.sort_values(["length", "pid"], ascending=[False, True])
    room: list[int] = []
    first = 0
    bins, offsets = [], []
    for length in rest["length"]:
        b = next((i for i in range(first, len(room)) if room[i] >= length), len(room))
        if b == len(room):
            room.append(CAPACITY)
        bins.append(b)
        offsets.append(CAPACITY - room[b])
        room[b] -= length
        while first < len(room) and room[first] == 0:
            first += 1
    yield pd.DataFrame({"pid": rest["pid"].to_numpy(), "sequence_id": -1 - np.array(bins, dtype=np.int64), "offset": np.array(offsets, dtype=np.int64)})


def pack(cut: DataFrame) -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset."""
    numbered = saved(cut.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    light = numbered.select("pid", "length", F.when(F.col("length") <= SMALL, -F.col("length")).otherwise(F.floor(F.lit(CAPACITY) / F.col("length"))).cast("long").alias("class"), F.floor(F.lit(CAPACITY) / F.col("length")).cast("long").alias("k"))
    whole = light.filter("k = 1").select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, done = light.filter("k > 1"), [whole]
    slots = max(1, -(-numbered.count() // PIECES_A_SLOT))
    while True:
        slot = Window.partitionBy("class", "slot").orderBy("pid")
        dealt = left.withColumn("slot", F.pmod(F.xxhash64("pid"), F.lit(slots))).withColumn("r", F.row_number().over(slot) - 1)
        dealt = dealt.withColumn("n", F.count("*").over(Window.partitionBy("class", "slot")))
        dealt = dealt.withColumn("bin", F.floor(F.col("r") / F.col("k"))).withColumn("full", (F.col("bin") + 1) * F.col("k") <= F.col("n"))
        # a bin is named by its first piece
        dealt = saved(dealt, "dealt")
        own = Window.partitionBy("class", "slot", "bin").orderBy("pid")
        done.append(dealt.filter("full").select("pid", F.min("pid").over(own).alias("sequence_id"), (F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset")))
        left = dealt.filter("not full").select("pid", "length", "class", "k")
        if slots == 1:
            break
        slots = max(1, slots // 16)
    done.append(left.select("pid", "length").repartition(1).mapInPandas(_first_fit, "pid long, sequence_id long, offset long"))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return numbered.join(placed, "pid").drop("pid")


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) and their places; ``path`` names the vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
