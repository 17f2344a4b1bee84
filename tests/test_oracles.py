"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import duckdb
import pandas as pd
import pytest

from assay.plans import benchmarking, evaluation, extras, inference, knowledge, matching, planning, retrieval, stores

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
PLANS = (retrieval, evaluation, knowledge, inference, benchmarking, extras, matching, planning, stores)
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PLANS for k, v in p.ORACLES.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(9)
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert {c: str(t) for c, t in got.dtypes.items()} == {c: str(want[c].dtype) for c in got.columns}
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    first = entry.entry(spark)
    assert first.columns == ["query_id", "rank", "doc_id", "score"] and first.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
