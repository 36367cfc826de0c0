import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["user_id", "n", "t_from", "t_to", "digest"] and rows.count() > 0


def test_every_query_is_registered():
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in [*TABLES, "embeddings"]:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, list | tuple) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str(list(v))
    if v is None or pd.isna(v):
        return ""
    return str(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (sorted(map(tuple, df[cols].map(plain).itertuples(index=False))) for df in (got, want))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    """What its rows are is held against plain versions elsewhere; here each query must make some over the stored tables, the same twice."""
    first, second = (sorted(map(str, entry.queries()[name](spark, FOLDER).collect())) for _ in range(2))
    assert first and first == second
