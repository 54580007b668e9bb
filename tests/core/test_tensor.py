"""The day tensor is text: every digit of it has to be that of its SQL."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions import scalars
from wattline.plans import series  # noqa: F401
from wattline.plans.fixtures import FIRST
from wattline.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.1"
BEGIN = datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=FIRST)


def equals_sql(spark, sf):
    """Rows taken in their order: DuckDB's threads share a table's row groups as they come."""
    con = duckdb.connect()
    con.sql("SET threads = 1")
    path = f"{sf}/events.parquet"
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = QUERIES["day_tensor"](spark, sf).collect(), con.sql(SQL["day_tensor"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    return {(k, d): t[1:-1].split(", ") for k, d, t in want}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_halves_of_the_seventh_place(spark):
    assert len(equals_sql(spark, SF)) == 150


def events(spark, tmp_path, rows, files=1):
    rows = [(k, BEGIN + datetime.timedelta(hours=h), v) for k, h, v in rows]
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, "event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        (made,) = (tmp_path / f"part{i}").glob("*.parquet")
        made.rename(tmp_path / "events.parquet" / f"{i:03d}.parquet")
    return str(tmp_path)


def test_numbers_of_any_size(spark, tmp_path):
    odd = [0.0, -0.0, -1e-7, 4e-7, 1e-6, -2.5e-6, 1.2e-5, 9.9e-5, 1e-4, 5.5e-4, 1e-3, 9999999.0, 1e7, -12345678.9, 123456789.123456789, 1e15, 9007199254740993.0, 1e16, -1.25e16, 1e22, 1e300, math.inf, -math.inf, math.nan]
    rows = [("a", h, v) for h, v in enumerate(odd)]
    rows += [("b", h, 1.0) for h in range(23)] + [("b", 23, None)]  # an hour without a known value
    rows += [(None, h, 1.0) for h in range(24)] + [("c", h, 1.0) for h in (*range(-24, 0), *range(720, 744))]  # no name; off the grid
    rows += [("d", h, v) for h in range(24) for v in (None, 2.0, 3.0)]
    got = equals_sql(spark, events(spark, tmp_path, rows))
    assert got["a", FIRST // 24][3:8] == ["0.0", "1e-06", "-3e-06", "1.2e-05", "9.9e-05"] and got["a", FIRST // 24][-3:] == ["inf", "-inf", "nan"]
    assert got.keys() == {("a", FIRST // 24), ("d", FIRST // 24)}


def test_means_are_summed_in_file_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, int(h), float(v)) for k, h, v in zip(rng.choice(["a", "b"], 60_000), rng.integers(0, 240, 60_000), rng.choice([1e16, -1e16, 1.01, 43.47, 7.3], 60_000), strict=True)]
    sf = events(spark, tmp_path, rows, files=5)
    assert len(equals_sql(spark, sf)) == 20


def test_rounding_and_text_equal_duckdb(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([10.0 ** rng.uniform(-8, 20, 4000), rng.integers(0, 10**9, 4000) / 64, rng.integers(0, 2 * 10**9, 4000) / 2e6, np.arange(200) / 1e6])
    x = np.unique(np.concatenate([x, np.nextafter(x, 0), np.nextafter(x, np.inf), -x])).tolist()
    got = spark.createDataFrame([(v,) for v in x], "x double").select(scalars.number_list(F.array(scalars.binary_round(F.col("x"), 6)))).collect()
    want = duckdb.execute("SELECT [round(unnest($1::DOUBLE[]), 6)]::VARCHAR", [x]).fetchall()
    assert [(v, g[0]) for v, g in zip(x, got, strict=True)] == [(v, w[0]) for v, w in zip(x, want, strict=True)]
