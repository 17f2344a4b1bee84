"""Each query against a brute-force version, on the small tables and on awkward ones."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from . import brute
from .conftest import SF

DOC_QUERIES = ["op1_pii", "op3_suffix_array", "op4_langid", "op5_mixing", "op7_simhash", "op8_substring"]


def bag(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_pii(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    keys = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    want = Counter((r["doc_id"], *(brute.pii(r["text"])[k] for k in keys)) for r in rows_of(d))
    assert bag(run("op1_pii", d), "doc_id", *keys) == want


def _numbered(rows):
    """Rows that share an id or have none are told apart by their place."""
    return [((i, r["doc_id"]), r["text"]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_bytes(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    want = Counter((k[1], *v) for k, v in brute.bytes_removed(_numbered(rows_of(d))).items())
    assert bag(run("op3_suffix_array", d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_words(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    want = Counter((k[1], *v) for k, v in brute.words_removed(_numbered(rows_of(d))).items())
    assert bag(run("op8_substring", d), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_langid(run, rows_of):
    truth = {r["doc_id"]: r["lang"] for r in rows_of(SF)}
    held = [r for r in run("op4_langid", SF) if r["held_out"]]
    assert len(held) > 20 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_langid_plain(run, rows_of, messy, folder):
    """Against a plain fit and prediction; here the sample is all labelled rows."""
    rows = rows_of(SF if folder == "small" else messy)
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, brute.langid([(r["doc_id"], r["text"], r["lang"]) for r in rows]), strict=True))
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in run("op4_langid", SF if folder == "small" else messy))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 1e-4


def test_langid_awkward(run, messy):
    got = run("op4_langid", messy)
    und = [r["doc_id"] for r in got if r["lang_pred"] == "und"]
    assert sorted(x for x in und if x is not None) == [1, 2, 3, 13] and und.count(None) == 1
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"}


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_mixing(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    rows = rows_of(d)
    size = lambda t: len(brute.WORD.findall(t or ""))
    sums = defaultdict(int)
    for r in rows:
        sums[r["source"]] += size(r["text"])
    target = brute.targets(dict(sums))
    got = run("op5_mixing", d)
    want = Counter((r["doc_id"], size(r["text"]), sums[r["source"]], round(target[r["source"]], 6)) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    largest = max(r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for (goal, _), words in taken.items():
        assert abs(words - goal) <= 1.01 * largest


def test_mixing_again(spark, run, messy):
    from assay.llm.registry import QUERIES

    again = QUERIES["op5_mixing"](spark, messy).repartition(5).collect()
    assert bag(again, "doc_id", "size", "taken") == bag(run("op5_mixing", messy), "doc_id", "size", "taken")


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_simhash(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    rows = rows_of(d)
    got = run("op7_simhash", d)
    texts = [(i, r["text"]) for i, r in enumerate(rows)]
    found = brute.simhash(texts)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[found[i][1]].append(r["doc_id"])
    want = Counter()
    for i, r in enumerate(rows):
        ids = [x for x in least[found[i][1]] if x is not None]
        want[r["doc_id"], found[i][0], min(ids) if ids else None] += 1
    assert bag(got, "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_packing(run, rows_of, messy, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    d = SF if folder == "small" else messy
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run("op9_packing", d)
    want = defaultdict(list)
    for r in rows_of(d):
        want[r["doc_id"]].append(brute.ids(t, r["text"]))
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    total = 0
    for doc, lists in want.items():
        for n, same in [(n, [x for x in lists if len(x) == n]) for n in {len(x) for x in lists}]:
            own = Counter((r["start"], r["length"], r["ids_crc32"]) for r in pieces.pop((doc, n)))
            cut = sorted({(s, ln) for s, ln, _ in own})
            assert [s for s, _ in cut] == [0, *np.cumsum([ln for _, ln in cut])[:-1]] and sum(ln for _, ln in cut) == n
            for ids in same:
                for s, ln in cut:
                    own[s, ln, brute.crc(ids[s : s + ln])] -= 1
            assert not any(own.values())
            total += n * len(same)
    assert not pieces
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert total / (2048 * len(bins)) > 0.9


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_embeddings(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    rows = rows_of(d, "embeddings")
    fine = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    units = [np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) if fine(r["embedding"]) else None for r in rows]
    pairs = [(i, j) for i, a in enumerate(units) for j in range(i) if a is not None and units[j] is not None and len(a) == len(units[j]) and a @ units[j] >= 0.9]
    linked = Counter(x for p in pairs for x in p)
    part = brute.components(range(len(rows)), pairs)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r["vec_id"] is not None:
            ids[part[i]].append(r["vec_id"])
    want = Counter()
    for i, r in enumerate(rows):
        c = min(ids[part[i]], default=None)
        want[r["vec_id"], linked[i], c, r["vec_id"] is not None and r["vec_id"] == c] += 1
    assert bag(run("op2_embedding_dedup", d), "vec_id", "n_links", "component_id", "kept") == want


@pytest.mark.parametrize("folder", ["small", "messy"])
def test_neighbours(run, rows_of, messy, folder):
    d = SF if folder == "small" else messy
    fine = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in rows_of(d, "embeddings") if r["vec_id"] is not None and fine(r["embedding"])]
    by = defaultdict(list)
    for r in run("op6_ann", d):
        by[r["query_id"]].append(r)
    hits = total = 0
    for q in {v for v, _ in rows if v % 100 == 0}:
        asked = [i for i, (v, _) in enumerate(rows) if v == q]
        others = [r for i, r in enumerate(rows) if i != asked[0] and len(r[1]) == len(rows[asked[0]][1])]
        true = sorted((float(np.sqrt(((x - rows[asked[0]][1]) ** 2).sum())), v) for v, x in others)[:10]
        got = sorted(by.pop(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [k + 1 for k in range(len(true)) for _ in asked]
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        hits += sum((Counter((r["score"], r["vec_id"]) for r in got[:: len(asked)]) & Counter(true)).values())
        total += len(true)
    assert hits >= 0.9 * total and not by


def test_licenses(run, messy):
    got = {r["path"]: (r["license"], r["origin"]) for r in run("op10_licenses", messy)}
    assert got["c/0/1/LICENSE.100"] == ("Apache-2.0", "text")
    assert got["b/0/0/5.txt"] == (None, "none")
    assert len(got) == len({r for r in got})


def test_license_inheritance(spark):
    from assay.llm.licenses import scan

    files = spark.createDataFrame(
        [
            ("r/LICENSE", "Released under the MIT License."),
            ("r/a/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
            ("r/a/b/x.py", "print(1)"),
            ("r/y.py", None),
            ("r/a/z.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"),
            ("other/w.py", ""),
            ("r/ab/v.py", "not a license at all, just the word license in a much longer line of text"),
        ],
        "path string, text string",
    )
    got = {r["path"]: (r["license"], r["origin"], r["directory"]) for r in scan(files).collect()}
    assert got["r/a/b/x.py"] == ("Apache-2.0", "directory", "r/a")
    assert got["r/y.py"] == ("MIT", "directory", "r")
    assert got["r/a/z.py"] == ("GPL-3.0", "text", None)
    assert got["other/w.py"] == (None, "none", None)
    assert got["r/ab/v.py"] == ("MIT", "directory", "r")


def test_license_texts(spark):
    """Tags, titles, headers in comments, bodies with their own copyright lines; and texts that only mention a licence."""
    from assay.llm.licenses import BODIES, scan

    body = {}
    for name, text in BODIES:
        body[name] = text  # the longest of each
    wrapped = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    files = {
        "a/1.py": ("# SPDX-License-Identifier: MIT\nimport os", "MIT"),
        "a/2.py": ("// SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"),
        "a/3.c": ("/* SPDX-License-Identifier: GPL-3.0-only */", "GPL-3.0"),
        "a/4.go": ("// Copyright 2021 The Authors. All rights reserved.\n//\n" + wrapped(body["Apache-2.0"], "// ") + "\npackage x", "Apache-2.0"),
        "a/5.h": ("/*\n" + wrapped(body["GPL-2.0"], " * ") + "\n */\n\nint x;", "GPL-2.0"),
        "b/LICENSE": ("MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + wrapped(body["MIT"], ""), "MIT"),
        "c/LICENSE.txt": ("Copyright (c) 2020, Jane Roe\nAll rights reserved.\n\n" + wrapped(body["BSD-3-Clause"], ""), "BSD-3-Clause"),
        "d/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Preamble text of some sort.", "GPL-3.0"),
        "e/LICENSE": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
        "f/LICENSE": ("BSD 3-Clause License", "BSD-3-Clause"),
        "g/x.rs": (body["MPL-2.0"], "MPL-2.0"),
        "h/x.py": ("This file is distributed under the MIT License. See LICENSE for details.", "MIT"),
        "i/x.py": ("You need a driving license to rent a car, and copyright law differs between countries of the region.", None),
        "j/x.py": ("SPDX-License-Identifier: LicenseRef-Ours-7.1", None),
        "k/LICENSE": (wrapped(body["BSD-2-Clause"], ""), "BSD-2-Clause"),
        "l/LICENSE": (body["ISC"], "ISC"),
    }
    rows = [(p, t) for p, (t, _) in files.items()] + [("i/x.py", None), ("h/x.py", "MIT License"), ("h/x.py", "MIT License"), (None, "MIT License"), (None, None)]
    got = {r["path"]: r["license"] for r in scan(spark.createDataFrame(rows, "path string, text string")).collect() if r["origin"] == "text" or r["origin"] == "none"}
    assert got == {p: want for p, (_, want) in files.items()} | {"": "MIT"}


@pytest.mark.parametrize("name", [*DOC_QUERIES, "op2_embedding_dedup", "op6_ann", "op9_packing", "op10_licenses", "pipeline"])
def test_nothing(run, nothing, name):
    assert run(name, nothing) == []


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_a_row_for_each(run, rows_of, messy, name):
    assert Counter(r["doc_id"] for r in run(name, messy)) == Counter(r["doc_id"] for r in rows_of(messy))
