"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from recallspark.plans import registry

QUERIES, ORACLES = registry.loaded().QUERIES, registry.ORACLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(x) -> str:
    if pd.isna(x):
        return ""
    return str(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def _rows(frame):
    return sorted(tuple(map(_cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    mine, twin = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(twin.columns)
    assert _rows(mine) == _rows(twin)
