"""Loading that goes on, and vector indexes on disk."""

import json

import numpy as np
import pytest

from assay.sources import index, quarantine
from assay.sources.vectors import Index, save


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "sub").mkdir()
    write = lambda name, text: (d / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    write("lines.jsonl", '\n{"content": "ok", "id": "x", "n": 1}\n   \n{"text": "two"}\n{"content": \n[1]\n{"title": "no text"}\n{"content": "last"}')
    write("fine.jsonl", '{"content": "a"}\r\n{"content": "b"}\n')
    write("one.json", '{"content": "obj", "doc_id": "o"}')
    write("many.json", '[{"text": "m0"}, {"text": "m1", "source": "s"}]')
    write("none.json", "[]")
    write("numbers.json", "[1]")
    write("broken.json", "{")
    write("half.json", '[{"text": "m0"}, {"title": "x"}]')
    write("sub/plain.txt", "text of a file\nwith lines")
    write("sub/bad.txt", b"\xff\xfe not utf-8")
    write("notes.md", "# One\nbody\n## Two\nmore")
    write("ignored.csv", "a,b")
    return str(d)


def named(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows.collect())


def problems(rows):
    return sorted((r["file"].rsplit("/", 1)[1], r["line"] or 0, r["reason"]) for r in rows.collect())


BAD = [
    ("bad.txt", 0, quarantine.ENCODING), ("broken.json", 0, quarantine.MALFORMED), ("half.json", 0, quarantine.NO_TEXT), ("lines.jsonl", 5, quarantine.MALFORMED),
    ("lines.jsonl", 6, quarantine.ROOT), ("lines.jsonl", 7, quarantine.NO_TEXT), ("numbers.json", 0, quarantine.ROOT),
]
GOOD = [("fine_0", "a"), ("fine_1", "b"), ("many_0", "m0"), ("many_1", "m1"), ("notes_s0", "# One\nbody"), ("notes_s1", "## Two\nmore"), ("o", "obj"), ("plain", "text of a file\nwith lines")]


def test_a_bad_file_does_not_stop_the_others(spark, folder):
    loaded = quarantine.load(spark, folder)
    assert named(loaded.documents) == GOOD and problems(loaded.problems) == BAD


def test_good_lines_of_bad_files(spark, folder):
    loaded = quarantine.load(spark, folder, good_lines=True)
    assert named(loaded.documents) == sorted([*GOOD, ("x", "ok"), ("lines_3", "two"), ("lines_7", "last"), ("half_0", "m0")])
    assert problems(loaded.problems) == BAD
    (x,) = loaded.documents.filter("doc_id = 'x'").collect()
    assert (x["line"], x["metadata"]) == (1, {"n": "1"})


def test_only_the_folder_itself(spark, folder):
    assert "plain" not in dict(named(quarantine.load(spark, folder, recursive=False).documents))


def test_lines_of_many_splits(spark, tmp_path):
    """Files cut into many splits, and several in one: numbers are those of the file."""
    for f in range(3):
        (tmp_path / f"f{f}.jsonl").write_text("".join(json.dumps({"id": f"{f}-{i}", "content": "x" * (i * 37 % 400)}) + "\n" if i % 10 else "\n" for i in range(700)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        lines = quarantine.json_lines(spark, str(tmp_path)).documents
        assert lines.rdd.getNumPartitions() > 3
        got = [(r["doc_id"], r["line"]) for r in lines.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == sorted((f"{f}-{i}", i) for f in range(3) for i in range(700) if i % 10)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8)) * 4
    return [(i, (centres[i % 12] + rng.standard_normal(8)).tolist()) for i in range(600)]


def test_reloaded_index(spark, vectors, tmp_path):
    path = str(tmp_path / "ix")
    with pytest.raises(ValueError):
        Index(spark, path)
    frame = spark.createDataFrame([*vectors, (900, None), (901, [float("nan")] * 8), (902, [])], "doc_id long, v array<double>")
    assert save(frame, path, lists=10) == 1
    opened = Index(spark, path)
    assert (opened.rows, opened.lists, opened.width) == (600, 10, 8)
    asked = spark.createDataFrame(vectors[:20], "query_id long, q array<double>")
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: np.argsort(-(x @ x[i]), kind="stable")[:5].tolist() for i in range(20)}

    def hits(rows):
        out = {}
        for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["rank"])):
            out.setdefault(r["query_id"], []).append(r["doc_id"])
        return out

    assert hits(opened.search(asked, 5)) == want
    found = hits(opened.search(asked, 5, probes=3))
    assert sum(len(set(found[i]) & set(want[i])) for i in want) >= 95
    # only partitions of lists that a query asks for are read
    one = opened.search(asked.limit(1), 5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "list#" in plan.split("PartitionFilters: [")[1].split("]")[0] + "]"
    # a new version does not disturb one that is open
    assert save(frame.filter("doc_id < 50"), path) == 2
    assert hits(opened.search(asked, 5)) == want and Index(spark, path).rows == 50 and Index(spark, path, 1).rows == 600
    with pytest.raises(ValueError):
        Index(spark, path, 3)
    with pytest.raises(ValueError):
        opened.search(spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>"), 5)


def test_index_of_odd_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        save(spark.createDataFrame([(1, None)], "doc_id long, v array<double>"), str(tmp_path / "a"))
    with pytest.raises(ValueError):
        save(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id long, v array<double>"), str(tmp_path / "b"))
    save(spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])], "doc_id long, v array<double>"), str(tmp_path / "c"))
    got = Index(spark, str(tmp_path / "c")).search(spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, q array<double>"), 1)
    assert [(r["doc_id"], r["score"]) for r in got.collect()] == [(2, 1.0)]


def test_hybrid(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green pear", [0.0, 1.0]), (3, "red pear", [0.6, 0.8]), (4, "blue plum", [0.9, 0.1]), (5, "blue fig", [0.8, 0.1])], "doc_id long, text string, v array<double>")
    index.save(docs, str(tmp_path / "t"))
    save(docs, str(tmp_path / "v"))
    asked = spark.createDataFrame([(1, "red", [0.0, 1.0]), (2, "apple", None)], "query_id long, query string, q array<double>")
    got = Index(spark, str(tmp_path / "v")).hybrid(index.load(spark, str(tmp_path / "t")), asked, 3).collect()
    assert {(r["query_id"], r["rank"]): r["doc_id"] for r in got} == {(1, 1): 3, (1, 2): 1, (1, 3): 2, (2, 1): 1}
