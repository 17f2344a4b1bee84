"""Readers, checkpoints and streams on files."""

import json

import pytest
from pyspark.sql import functions as F

from assay.operators import chunking, conflict
from assay.sources import checkpoint, documents
from assay.streaming import incremental


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text(json.dumps({"id": "x", "content": "one", "tag": "t"}) + "\n\n" + json.dumps({"text": "two", "title": "T"}) + "\n")
    got = {r["text"]: r for r in documents.read(spark, str(p)).collect()}
    assert got["one"]["doc_id"] == "x" and got["one"]["metadata"] == {"tag": "t"}
    assert got["two"]["doc_id"].startswith("a_") and got["two"]["title"] == "T"


def test_malformed_line_stops(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "text": "one"}\n{broken\n')
    with pytest.raises(Exception, match="malformed line"):
        documents.read(spark, str(p)).collect()


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1, "text": "p"}, {"text": "q"}]))
    (tmp_path / "sub" / "c.txt").write_text("plain\ntext")
    (tmp_path / "sub" / "d.md").write_text("intro\n# One\nbody\n## Two\nmore")
    (tmp_path / "e.bin").write_text("?")
    got = {r["doc_id"]: r["text"] for r in documents.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"1": "p", "b_1": "q", "c": "plain\ntext", "d_s0": "intro", "d_s1": "# One\nbody", "d_s2": "## Two\nmore"}
    with pytest.raises(ValueError, match="no reader"):
        documents.read(spark, str(tmp_path / "e.bin"))


def test_ids_are_checked(spark):
    good = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    assert documents.checked_ids(good).count() == 2
    for bad in ([("a", "x"), ("a", "y")], [("a", " ")], [(" ", "x")], [(None, "x")]):
        with pytest.raises(ValueError):
            documents.checked_ids(spark.createDataFrame(bad, "doc_id string, text string"))


def test_write_split(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id long, split string")
    got = {r["split"]: r["n"] for r in documents.write_split(rows, str(tmp_path / "out")).collect()}
    assert got == {"train": 2, "test": 1} and spark.read.json(str(tmp_path / "out" / "split=train")).count() == 2


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "ck")
    schema = "id long, value string, error string, seq long, signature string"
    checkpoint.append(spark.createDataFrame([(1, "a", None, 1, "s"), (2, None, "boom", 1, "s"), (3, "old", None, 1, "other")], schema), path)
    checkpoint.append(spark.createDataFrame([(1, "b", None, 2, "s")], schema), path)
    done = checkpoint.load(spark, path, "id", "s")
    assert {r["id"]: r["value"] for r in done.collect()} == {1: "b", 2: None}
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(r["id"] for r in checkpoint.todo(items, done, "id").collect()) == [2, 3]
    assert checkpoint.repaired(done, str(tmp_path / "new")).count() == 1
    parts = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string")
    assert checkpoint.signature(parts) == checkpoint.signature(parts.orderBy(F.desc("name")))


def test_stream_indexes_like_the_batch(spark, tmp_path):
    source, schema = tmp_path / "in", "doc_id long, text string"
    docs = spark.createDataFrame([(i, f"document number {i} " * 40) for i in range(6)], schema)
    docs.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), size=100, overlap=10)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "chunks")).drop("batch")
    want = chunking.chunk(docs, size=100, overlap=10)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_stream_grows_the_conflict_graph(spark, tmp_path):
    texts = spark.createDataFrame([(f"e{i}", f"Acme sold {1000 * (i + 1)} cars in total.") for i in range(4)], "k string, body string")
    claims = conflict.extract(texts, "k", "body")
    claims.repartition(2, "claim_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.conflict_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "edges"))
    assert sorted((r["source_id"], r["target_id"]) for r in got.collect()) == sorted((r["source_id"], r["target_id"]) for r in conflict.detect(claims).collect())


def test_latest_stream(spark, tmp_path):
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 'a'), (1, timestamp'2024-01-01 00:10:00', 'b'), (2, timestamp'2024-01-01 00:05:00', 'c') as t(id, ts, v)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.latest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["id"], "ts")
    q = stream.writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["v"] for r in spark.table("latest").collect()} == {1: "b", 2: "c"}


def test_saved_index_finds_the_same(spark, tmp_path):
    from assay.operators import retrieval
    from assay.sources import index

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index.save(docs, str(tmp_path / "index"))
    got = index.search(index.load(spark, str(tmp_path / "index")), asked, 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, retrieval.bm25(docs, asked, 5).collect()))


def test_public_readers(spark, tmp_path):
    from assay.sources import public

    (tmp_path / "f.jsonl").write_text(json.dumps({"id": 7, "claim": "c", "label": "SUPPORTS"}) + "\n")
    assert public.fever(spark, str(tmp_path / "f.jsonl")).first().asDict() == {"question_id": "7", "claim": "c", "label": "supports"}
    (tmp_path / "h.json").write_text(json.dumps([{"_id": "q", "question": "?", "answer": "!", "context": [["T", ["one.", "two."]], ["U", ["three."]]], "supporting_facts": [["T", 0]]}]))
    questions, docs = public.hotpot(spark, str(tmp_path / "h.json"))
    assert questions.first()["titles"] == ["T"]
    assert {r["title"]: r["text"] for r in docs.collect()} == {"T": "one. two.", "U": "three."}
