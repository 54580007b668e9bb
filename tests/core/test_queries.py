"""Every query with SQL gives the same rows as DuckDB, at the smallest scale."""

import numbers
import os

import duckdb
import pytest

from wattline.plans import relations, series, workflows  # noqa: F401
from wattline.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        if t.endswith(".parquet"):
            c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def norm(frame, cols):
    one = lambda x: "null" if x is None or str(x) in ("nan", "<NA>", "NaT") else repr(round(float(x), 5) + 0.0) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(one, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert norm(got, cols) == norm(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
