"""Queries run over all rows: the same as DuckDB's SQL without its cut, or as a direct computation."""

import datetime
import os

import duckdb
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.core.test_queries import SF, norm
from wattline.operators import evaluate, joins, profile
from wattline.plans import relations, series, workflows  # noqa: F401
from wattline.plans.fixtures import FIRST, FULL, LAST, PER_DAY, TRAIN_END
from wattline.plans.registry import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        if t.endswith(".parquet"):
            c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_takes_whole_tables(name):
    assert not re.search(r"(WHERE|AND) [\w.]*(id|key) % \d+ = 0", SQL[name])


def test_channels_met_counts_a_channel_once(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(k), i, int(s), int(s + n)) for i, (g, k, s, n) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 25, 300), rng.integers(-200, 400, 300), rng.integers(1, 60, 300), strict=True))]
    want = {i: len({k2 for g2, k2, _, s2, e2 in rows if g2 == g and s < e2 and e > s2}) for g, k, i, s, e in rows}
    df = spark.createDataFrame(rows, "g long, k long, id long, start long, `end` long")
    assert {r.id: r.n_channels for r in joins.channels_met(df, ["g"], "k", "id", 16).collect()} == want


@pytest.fixture(scope="module")
def profiles(con):
    """By width, series and day: each window's distance to the nearest of the baseline, other days only."""
    f = con.sql(f"WITH {FULL} SELECT series_id, slot, p FROM f ORDER BY 1, 2").df()
    out = {}
    for name, part in f.groupby("series_id"):
        x = part["p"].to_numpy(float).reshape(-1, PER_DAY)
        for width in (4, 6):
            w = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)
            z = (w - w.mean(-1, keepdims=True)) / w.std(-1, keepdims=True)
            assert not (w.std(-1) <= profile.EPSILON).any()
            for d in range(len(x)):
                ref = np.concatenate([z[r] for r in range((TRAIN_END - FIRST) // PER_DAY) if r != d])
                dist = np.linalg.norm(z[d][:, None] - ref[None][:, ~np.isnan(ref).any(-1)], axis=-1).min(axis=1)
                for i in np.flatnonzero(~np.isnan(dist)):
                    out[width, name, FIRST // PER_DAY + d, int(i)] = float(dist[i])
    assert len({k[1] for k in out}) == 5 and len({k[2] for k in out}) == (LAST - FIRST) // PER_DAY
    return out


@pytest.mark.parametrize("name", ["znorm_ab_join", "lodo_calibration"])
def test_profiles_cover_all_series_and_days(spark, profiles, name):
    want = {k[1:]: v for k, v in profiles.items() if k[0] == 4 and (k[2] >= TRAIN_END // PER_DAY) == (name == "znorm_ab_join")}
    got = {(r.series_id, r.day, r.start): r.distance for r in QUERIES[name](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def percentiles(profiles, width, places):
    """Best mid-rank of the windows over each test slot among the baseline's distances of its series."""
    best = {}
    for s in {k[1] for k in profiles}:
        mine = {k[2:]: round(v, places) for k, v in profiles.items() if k[:2] == (width, s)}
        base = np.array([v for (d, _), v in mine.items() if d < TRAIN_END // PER_DAY])
        for (d, i), v in mine.items():
            if d >= TRAIN_END // PER_DAY:
                pct = 100 * float((base < v - 1e-9).mean() + 0.5 * (abs(base - v) <= 1e-9).mean())
                for h in range(i, i + width):
                    best[s, d, h] = max(best.get((s, d, h), 0.0), pct)
    return best


def test_day_scores_cover_all_series_and_days(spark, profiles):
    got = {(r.series_id, r.day, r.h): r.scale_4 for r in QUERIES["day_scores"](spark, SF).collect()}
    want = percentiles(profiles, 4, 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.4 for k in want)


def test_detector_scales_cover_all_series_and_days(spark, profiles):
    rows = QUERIES["detector_scales"](spark, SF).collect()
    for width in (4, 6):
        got = {(r.series_id, r.day, r.h): r[f"scale_{width}"] for r in rows if r[f"scale_{width}"] is not None}
        want = percentiles(profiles, width, 12)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.4 for k in want)


def test_change_points_anywhere_in_the_month(spark, tmp_path):
    rng = np.random.default_rng(9)
    begin = datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=FIRST)
    level = {"a": lambda i: 50.0 if i >= 60 else 10.0, "b": lambda i: 10.0 if i >= 650 else 50.0, "c": lambda i: 10.0}
    rows = [(k, begin + datetime.timedelta(hours=i), f(i) + float(rng.normal(0, 0.5))) for k, f in level.items() for i in range(LAST - FIRST)]
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["change_points"](spark, str(tmp_path)).collect()
    assert sorted((r.series_id, r.slot - FIRST, round(r.shift / 10)) for r in got) == [("a", 60, 4), ("b", 650, -4)]


def chosen(spark, rows, quota):
    df = spark.createDataFrame(rows, "d string, t long, score double").repartition(3)
    return [tuple(r) for r in evaluate.diverse(df, "d", "t", [-F.col("score"), F.col("d"), F.col("t")], quota)]


def test_cases_after_a_hot_device(spark):
    rows = [("hot", i, 10.0 - i / 1e4) for i in range(2500)] + [(k, 5, 1.0) for k in "abcde"]
    assert chosen(spark, rows, 4) == [("hot", 0, 10.0), ("a", 5, 1.0), ("b", 5, 1.0), ("c", 5, 1.0)]
    assert len(chosen(spark, rows, 9)) == 6  # every device has one case, no device has a second one 12 hours away


@pytest.mark.parametrize("devices", [1, 3, 30])
def test_cases_equal_a_walk_over_all_rows(spark, devices):
    rng = np.random.default_rng(devices)
    rows = [(f"d{d}", int(t) * 3600, float(s)) for d, t, s in zip(rng.integers(0, devices, 400), rng.integers(0, 200, 400), rng.normal(size=400), strict=True)]

    class Ranked:
        def collect(self):
            return [dict(zip("dts", r, strict=True)) for r in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))]

    for quota in (3, 12):
        assert chosen(spark, rows, quota) == [tuple(r.values()) for r in evaluate.select_diverse(Ranked(), "d", "t", quota)]
