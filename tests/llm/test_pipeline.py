"""Each stage against a plain version of its rule, on its own input."""

from collections import Counter

import corpus_pipeline as p

from . import brute
from .conftest import SF


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select(*p.COLUMNS)


def test_language_id(spark, messy):
    got = p.language_id(spark, _docs(spark, messy), messy).collect()
    kept = Counter(r["doc_id"] for r in got)
    assert not {1, 2, 3, 13} & set(kept) and kept[9] == 2 and kept[4] == 1


def test_language_id_keeps_clean(spark):
    docs = _docs(spark, SF)
    got = p.language_id(spark, docs, SF)
    assert got.columns == list(p.COLUMNS) and got.count() >= 0.99 * docs.filter("text rlike '[a-z]'").count()


def test_near_duplicates(spark):
    docs = _docs(spark, SF)
    part = brute.simhash([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, SF).collect())
    assert got == sorted({c for _, c in part.values()})


def test_one_of_repeated_rows_stays(spark, messy):
    got = Counter(r["doc_id"] for r in p.near_duplicates(spark, _docs(spark, messy), messy).collect())
    assert got[8] + got[9] == 1


def test_personal_data(spark, messy):
    got = {r["doc_id"]: r for r in p.personal_data(spark, _docs(spark, messy), messy).collect()}
    assert "mail me at <EMAIL> or <PHONE>, card <CARD>, host <IP>." in got[7]["text"]
    assert got[7]["n_chars"] == len(got[7]["text"]) and got[1]["text"] is None


def test_mix_sources(spark, run, messy):
    got = Counter(r["doc_id"] for r in p.mix_sources(spark, _docs(spark, messy), messy).collect() if r["doc_id"] is not None)
    size = {r["doc_id"]: r["size"] for r in run("op5_mixing", messy)}
    assert all(n <= 3 * (2 if d == 9 else 1) and size[d] for d, n in got.items())


def test_whole(spark, messy):
    out = p.run(spark, messy)
    per = out.groupBy("sequence_id").sum("length").collect()
    assert per and all(r[1] <= 2048 for r in per)
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "personal_data", "mix_sources", "pack"]
