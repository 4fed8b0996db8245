"""Each registered query against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from simloom.plans.catalog import QUERIES, SQL, flagship

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def _rows(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("null" if pd.isna(x) else f"{float(x):.5f}" if isinstance(x, int | float) or hasattr(x, "dtype") and x.dtype.kind in "fiu" else str(x) for x in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    close = sum(a != b for a, b in zip(_rows(ours), _rows(theirs), strict=True))
    assert close == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).limit(1).count() == 1


def test_flagship(spark):
    assert flagship(spark).count() == 5 * 500
