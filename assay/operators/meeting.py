"""Blocks of classes of claims against each other: what depends on the letters and numbers of both, as matrices in a task.

A row has two blocks (``xs``, ``ys``) of a bounded number of classes, each of one kind, and what rules say of a pair of those kinds: whether their
quantities are compared (``num0``, or ``num1`` if their texts are alike) and which edge holds whatever the numbers (``xy0``, ``xy1``; ``yx0``, ``yx1`` the other way).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .slots import RATIO, UNATTRIBUTED

#: Classes of a side, about, and grams that are looked at together.
BLOCK, GRAMS = 512, 4096
#: Classes of some rows that are read together.
MEMBERS = 4096
EDGE = "struct<conflict_type: string, confidence: double, severity: string>"
MET = f"c long, d long, n long, ratio double, similarity double, edge {EDGE}"
NONE, NUMERIC, PLAIN, ALIKE, SUPPORT = range(5)
_SHIFT = 21  # bits of a code point


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the distinct bigrams of each text; one character is a gram itself. Sorted by text."""
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    after = np.r_[codes[1:], 0]
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    kept = ~last | (sizes[text] == 1)
    grams, of = np.unique((codes << _SHIFT | np.where(last, (1 << _SHIFT) - 1, after))[kept], return_inverse=True)
    both = np.unique(text[kept] * max(1, len(grams)) + of)
    return both // max(1, len(grams)), both % max(1, len(grams))


def _ranks(values: pa.Array) -> np.ndarray:
    """Places of ``values`` in order, the same for equal ones."""
    return pc.rank(values, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


class _Classes:
    """Both sides of some rows, one after the other."""

    def __init__(self, rows: pa.RecordBatch):
        sides = [rows.column("xs"), rows.column("ys")]
        sizes = np.concatenate([pc.list_value_length(s).to_numpy() for s in sides]).astype(np.int64)
        ends = np.cumsum(sizes)
        self.at = list(zip(ends - sizes, ends, strict=True))
        flat = pa.concat_arrays([pc.list_flatten(s) for s in sides])
        field = flat.field
        self.c, self.n = field("c").to_numpy(), field("n").to_numpy()
        self.lone = field("lone").to_numpy(zero_copy_only=False).astype(bool)
        both = _ranks(pa.concat_arrays([field("first"), field("last")]))
        self.first, self.last = both[: len(flat)], both[len(flat) :]
        self.texts, self.known = field("low").fill_null(""), field("low").is_valid().to_numpy(zero_copy_only=False)
        self._grams = None
        listed = field("quantities")
        self.quantities = np.nan_to_num(pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        self.begins = np.cumsum(self.quantities) - self.quantities
        one = pc.list_flatten(listed)
        code = lambda name: one.field(name).dictionary_encode()
        unit, context = code("unit"), code("context")
        self.unit, self.context = unit.indices.to_numpy(), context.indices.to_numpy()
        self.value = one.field("value").to_numpy(zero_copy_only=False)
        at = lambda names, name: names.dictionary.to_pylist().index(name) if name in names.dictionary.to_pylist() else -1
        self.percent, self.bare, self.node = at(unit, "percent"), at(unit, "plain"), at(context, "process_node")

    def ratios(self, x: tuple[int, int], y: tuple[int, int]) -> np.ndarray:
        """The first ratio beyond RATIO between quantities of one context and of units that agree, as ``slots.numeric_ratio``; NaN without one."""
        out = np.full((x[1] - x[0], y[1] - y[0]), np.nan)
        if not len(self.value):
            return out
        counts = self.quantities[slice(*x)], self.quantities[slice(*y)]
        for i in range(counts[0].max(initial=0)):
            for j in range(counts[1].max(initial=0)):
                rows, columns = np.flatnonzero(counts[0] > i), np.flatnonzero(counts[1] > j)
                p, q = self.begins[slice(*x)][rows, None] + i, self.begins[slice(*y)][None, columns] + j
                a, b = self.unit[p], self.unit[q]
                agree = (a == b) | ((a != self.percent) & (b != self.percent) & ((a == self.bare) | (b == self.bare)))
                v, w = self.value[p], self.value[q]
                fits = agree & (self.context[p] == self.context[q]) & (self.context[p] != self.node) & (v > 0) & (w > 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.maximum(v, w) / np.minimum(v, w)
                own = np.ix_(rows, columns)
                out[own] = np.where(np.isnan(out[own]) & fits & (ratio > RATIO), ratio, out[own])
        return out

    def similarities(self, x: tuple[int, int], y: tuple[int, int]) -> np.ndarray:
        """Jaccard indices of the texts' bigrams; 0 if both have none, NaN where a text is null."""
        if self._grams is None:
            text, gram = _grams(self.texts)
            self._grams = text, gram, np.searchsorted(text, np.arange(len(self.texts) + 1))
        text, gram, starts = self._grams
        (a, b), (p, q) = ((starts[s], starts[e]) for s, e in (x, y))
        names, of = np.unique(np.r_[gram[a:b], gram[p:q]], return_inverse=True)
        rows, sizes = (text[a:b] - x[0], text[p:q] - y[0]), np.diff(starts)
        shared = np.zeros((x[1] - x[0], y[1] - y[0]))
        for low in range(0, len(names), GRAMS):
            sides = []
            for row, place, n in ((rows[0], of[: b - a], x[1] - x[0]), (rows[1], of[b - a :], y[1] - y[0])):
                kept = (place >= low) & (place < low + GRAMS)
                has = np.zeros((n, min(GRAMS, len(names) - low)), np.float32)
                has[row[kept], place[kept] - low] = 1
                sides.append(has)
            shared += sides[0] @ sides[1].T
        union = sizes[slice(*x), None] + sizes[None, slice(*y)] - shared
        out = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        return np.where(self.known[slice(*x), None] & self.known[None, slice(*y)], out, np.nan)


def meeting(types: tuple[str, ...] | None, least: float, summed: bool, unique: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task that yields the edges (MET) of classes of both blocks of each row, of ``types`` only if given: a ``ratio``, an ``edge`` or a ``similarity`` of ``least`` or more.

    An edge from class c to class d holds for members of which that of c has the smaller id. If ``summed``, c and d are null and n is the number of pairs of members, wherever
    that follows from the sizes of classes: ids are ``unique``, the edge does not depend on which member has the smaller id, and a class is ``lone``, alone in its members' evidence.
    """
    wants = lambda name: types is None or name in types

    def codes(row: dict, way: str, ratio: np.ndarray | None, similarity: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray:
        alike = np.zeros(shape, bool) if similarity is None else similarity >= UNATTRIBUTED
        out = np.full(shape, NONE, np.int8) if similarity is None else np.where(similarity >= least, SUPPORT, NONE).astype(np.int8)
        for name, code, where in ((f"{way}0", PLAIN, ~alike), (f"{way}1", ALIKE, alike)):
            if row[name] is not None:
                out[where] = code
        if ratio is not None:
            out[np.where(alike, row["num1"], row["num0"]) & ~np.isnan(ratio)] = NUMERIC
        wanted = [False, wants("numeric_conflict"), *(row[f"{way}{i}"] is not None and wants(row[f"{way}{i}"]["conflict_type"]) for i in (0, 1)), wants("support")]
        out[~np.array(wanted)[out]] = NONE
        return out

    def of_row(classes: _Classes, row: dict, x: tuple[int, int], y: tuple[int, int]) -> Iterator[tuple]:
        """(c, d, n, code, way, ratio, similarity) as arrays, but for the way."""
        shape, same = (x[1] - x[0], y[1] - y[0]), row["same"]
        numeric = row["num0"] or row["num1"]
        forth = classes.ratios(x, y) if numeric else None
        back = forth if not numeric or max(classes.quantities[slice(*x)].max(initial=0), classes.quantities[slice(*y)].max(initial=0)) <= 1 else classes.ratios(y, x).T
        differ = row["num0"] != row["num1"] or row["xy0"] != row["xy1"] or row["yx0"] != row["yx1"]
        similarity = classes.similarities(x, y) if differ or wants("support") else None
        xy, yx = codes(row, "xy", forth, similarity, shape), codes(row, "yx", back, similarity, shape)
        first, last = classes.first, classes.last
        once = np.arange(shape[0])[:, None] < np.arange(shape[1])[None] if same else np.ones(shape, bool)
        sides = classes.c[slice(*x)], classes.c[slice(*y)]
        n = classes.n[slice(*x), None] * classes.n[None, slice(*y)]
        if same:
            once |= np.eye(len(n), dtype=bool)
            np.fill_diagonal(n, classes.n[slice(*x)] * (classes.n[slice(*x)] - 1) // 2)
        up = (first[slice(*x), None] < last[None, slice(*y)]) & once  # some member of x has a smaller id than one of y
        down = (first[None, slice(*y)] < last[slice(*x), None]) & once
        if same:
            np.fill_diagonal(down, False)
        if summed and unique:
            alone = classes.lone[slice(*x), None] | classes.lone[None, slice(*y)]
            equal = xy == yx
            if forth is not back:
                equal &= (xy != NUMERIC) | (forth == back)
            for code, i in ((PLAIN, 0), (ALIKE, 1)):
                if row[f"xy{i}"] != row[f"yx{i}"]:
                    equal &= xy != code
            whole = alone & (~(up & down) | equal)
            for way, code, where, ratio in (("xy", xy, up & whole, forth), ("yx", yx, down & ~up & whole, back)):
                yield from added(n, code, where, way, ratio, similarity)
            up, down = up & ~whole, down & ~whole
        for way, code, where, ratio, (c, d) in (("xy", xy, up, forth, (0, 1)), ("yx", yx, down, back, (1, 0))):
            at = np.nonzero(where & (code != NONE))
            if len(at[0]):
                found = code[at]
                yield sides[c][at[c]], sides[d][at[d]], np.ones(len(found), np.int64), found, way, None if ratio is None else ratio[at], None if similarity is None else similarity[at]

    def added(n: np.ndarray, code: np.ndarray, where: np.ndarray, way: str, ratio: np.ndarray | None, similarity: np.ndarray | None) -> Iterator[tuple]:
        """Pairs of members, summed by code and by ratio or similarity."""
        for kind in (NUMERIC, PLAIN, ALIKE, SUPPORT):
            at = where & (code == kind)
            if not at.any():
                continue
            values = ratio if kind == NUMERIC else similarity if kind == SUPPORT else np.zeros(code.shape)
            by, of = np.unique(values[at], return_inverse=True)
            sums = np.zeros(len(by), np.int64)
            np.add.at(sums, of.ravel(), n[at])
            none = np.full(len(by), -1, np.int64)
            yield none, none, sums, np.full(len(by), kind, np.int8), way, by, by

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.list_value_length(batch.column("xs")), pc.list_value_length(batch.column("ys"))).to_numpy()
            ends, low = np.cumsum(sizes), 0
            while low < len(sizes):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MEMBERS, "right")))
                rows, low = batch.slice(low, high - low), high
                classes, out = _Classes(rows), []
                for i, row in enumerate(rows.drop_columns(["xs", "ys"]).to_pylist()):
                    x, y = classes.at[i], classes.at[i + rows.num_rows]
                    out += [_edges(row, *found) for found in of_row(classes, row, x, x if row["same"] else y)]
                if out:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return work


def _edges(row: dict, c: np.ndarray, d: np.ndarray, n: np.ndarray, code: np.ndarray, way: str, ratio: np.ndarray | None, similarity: np.ndarray | None) -> pa.RecordBatch:
    pair = lambda ids: pa.array(ids, pa.int64(), mask=ids < 0)
    value = lambda v, kind: pa.nulls(len(code), pa.float64()) if v is None else pa.array(v, pa.float64(), mask=code != kind)
    names = ("conflict_type", "confidence", "severity")
    kinds = [pa.string(), pa.float64(), pa.string()]
    said = pa.array([row[f"{way}{i}"] for i in (0, 1)] + [None], pa.struct(list(zip(names, kinds, strict=True))))
    edge = said.take(pa.array(np.where(code == PLAIN, 0, np.where(code == ALIKE, 1, 2))))
    return pa.RecordBatch.from_arrays([pair(c), pair(d), pa.array(n, pa.int64()), value(ratio, NUMERIC), value(similarity, SUPPORT), edge], ["c", "d", "n", "ratio", "similarity", "edge"])
