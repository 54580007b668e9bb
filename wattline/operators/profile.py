"""Subsequence similarity (matrix profile).

``ab_join`` keeps everything in Spark SQL: z-normalised windows meet on their
offset and the dot product gives the distance.  ``ab_join_arrays`` is the fast
path: one task per series multiplies window matrices in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A window whose deviation is at most this is constant.
EPSILON = 10 * 2.220446049250313e-16


def windows(rows: DataFrame, keys: list[str], slot: str, value: str, width: int, per_day: int) -> DataFrame:
    """(keys, start, offset, z, is_const) of every full window of known values inside a day."""
    if not 2 <= width <= per_day:
        raise ValueError(f"a window of {width} does not fit into a day of {per_day}")
    starts = rows.where(F.col(value).isNotNull()).withColumn("start", F.explode(F.sequence(F.greatest(F.col(slot) - (width - 1), F.lit(0)), F.least(F.col(slot), F.lit(per_day - width)))))
    w = Window.partitionBy(*keys, "start")
    full = starts.withColumn("__n", F.count("*").over(w)).withColumn("__m", F.avg(value).over(w)).withColumn("__s", F.stddev_pop(value).over(w)).where(F.col("__n") == width)
    const = F.col("__s") <= EPSILON
    return full.select(*keys, "start", (F.col(slot) - F.col("start")).alias("offset"), F.when(~const, (F.col(value) - F.col("__m")) / F.col("__s")).alias("z"), const.alias("is_const"))


def ab_join(query: DataFrame, reference: DataFrame, series: str, day: str, width: int, *, leave_own_day_out: bool = False) -> DataFrame:
    """Best distance of each query window to the reference's, with its neighbour (first in day, start order)."""
    r = reference.select(series, F.col(day).alias("r_day"), F.col("start").alias("r_start"), "offset", F.col("z").alias("rz"), F.col("is_const").alias("rc"))
    on = query.join(r, [series, "offset"])
    if leave_own_day_out:
        on = on.where(F.col(day) != F.col("r_day"))
    pair = on.groupBy(series, day, "start", "r_day", "r_start").agg(F.sum(F.col("z") * F.col("rz")).alias("dot"), F.first("is_const").alias("qc"), F.first("rc").alias("rc"))
    d = F.when(F.col("qc") & F.col("rc"), 0.0).when(F.col("qc") | F.col("rc"), float(np.sqrt(width))).otherwise(F.sqrt(F.greatest(2.0 * width - 2.0 * F.col("dot"), F.lit(0.0))))
    pair = pair.withColumn("d", d)
    best = F.min(F.struct("d", "r_day", "r_start"))
    return pair.groupBy(series, day, "start").agg(best.alias("b")).select(series, day, "start", F.col("b.d").alias("distance"), F.col("b.r_day").alias("r_day"), F.col("b.r_start").alias("r_start"))


def _z(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.lib.stride_tricks.sliding_window_view(x, width, axis=-1)
    good = np.isfinite(w).all(axis=-1)
    m, s = w.mean(axis=-1, keepdims=True), w.std(axis=-1, keepdims=True)
    const = s[..., 0] <= EPSILON
    with np.errstate(all="ignore"):
        z = np.where(const[..., None], 0.0, (w - m) / s)
    return np.where(good[..., None], z, 0.0), const, good


def profile_arrays(query: np.ndarray, reference: np.ndarray, width: int, own: np.ndarray | None = None) -> np.ndarray:
    """(query days, starts) best distances; ``own`` names a reference day to leave out for each query day.  NaN without neighbour."""
    qz, qc, qg = _z(query, width)
    rz, rc, rg = _z(reference, width)
    flat, fc, fg = rz.reshape(-1, width), rc.ravel(), rg.ravel()
    day = np.repeat(np.arange(len(reference)), rz.shape[1])
    out = np.full(qz.shape[:2], np.nan)
    for i in range(len(query)):
        d = np.sqrt(np.maximum(2 * width - 2 * (qz[i] @ flat.T), 0))
        d = np.where(qc[i][:, None] & fc[None], 0.0, np.where(qc[i][:, None] ^ fc[None], np.sqrt(width), d))
        d[:, ~fg if own is None else ~fg | (day == own[i])] = np.inf
        d[~qg[i]] = np.inf
        best = d.min(axis=1) if d.shape[1] else np.full(len(d), np.inf)
        out[i] = np.where(np.isfinite(best), best, np.nan)
    return out


def ab_join_arrays(days: DataFrame, series: str, day: str, values: str, is_query: str, width: int, *, leave_own_day_out: bool = False) -> DataFrame:
    """(series, day, start, distance); ``days`` has one row a day with an array of equally many values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        x = np.array([[np.nan if v is None else v for v in row] for row in pdf["v"]], float)
        query = pdf["q"].to_numpy(bool)
        ref = np.flatnonzero(~query) if not leave_own_day_out else np.arange(len(pdf))
        chosen = np.flatnonzero(query)
        own = np.searchsorted(ref, chosen) if leave_own_day_out else None
        got = profile_arrays(x[chosen], x[ref], width, own)
        n, m = got.shape
        return pd.DataFrame({series: pdf[series].iloc[0], day: np.repeat(pdf[day].to_numpy()[chosen], m), "start": np.tile(np.arange(m), n), "distance": got.ravel()}).dropna()

    kind = {f.name: f.dataType.simpleString() for f in days.schema}
    return days.select(series, day, F.col(values).alias("v"), F.col(is_query).alias("q")).groupBy(series).applyInPandas(run, f"{series} {kind[series]}, {day} {kind[day]}, start long, distance double")


def reference_days(target: DataFrame, history: DataFrame, series: str, day: str, *, least: int = 6, solar: bool = False) -> DataFrame:
    """(series, target day, reference day): the same weekday/weekend group if it has ``least`` days, else all."""
    weekend = lambda c: F.weekday(F.date_from_unix_date(F.col(c).cast("int"))) >= 5
    h = history.select(series, F.col(day).alias("r_day")).distinct().withColumn("r_weekend", weekend("r_day"))
    pairs = target.select(series, day).distinct().withColumn("weekend", weekend(day)).join(h, series)
    same = F.col("weekend") == F.col("r_weekend")
    n = F.sum(same.cast("int")).over(Window.partitionBy(series, day))
    keep = F.lit(True) if solar else (same | (F.col("n_same") < least))
    return pairs.withColumn("n_same", n).where(keep).select(series, day, "r_day")


def daily_outlier(calibration: DataFrame, target: DataFrame, series: str, score: str) -> DataFrame:
    """Outlier: score over the largest calibration score and over median + 4 MAD."""
    from wattline.operators.calibrate import mad

    stats = mad(calibration, [series], score).join(calibration.groupBy(series).agg(F.max(score).alias("top")), series)
    return target.join(stats, series).withColumn("daily_outlier", (F.col(score) > F.col("top")) & (F.col(score) > F.col("median") + 4 * F.col("mad")))
