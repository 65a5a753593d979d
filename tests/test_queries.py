"""Every registered query that has SQL gives the rows that DuckDB gives, on the smallest driver tables."""

import os

import pandas as pd
import pytest

from quillmesh import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    show = lambda v: None if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if isinstance(df[c].dtype, pd.Int64Dtype):
            df[c] = df[c].astype("float64")
        df[c] = df[c].astype("datetime64[us]") if df[c].dtype.kind == "M" else df[c]
    return sorted((tuple(show(float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, SF).count() > 0, name
