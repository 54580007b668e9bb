"""Streaming forms of the batch operators: tumbling scores, sessions and frozen calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_scores(points: DataFrame, *, ts: str = "ts", score: str = "score", flag: str = "is_anomaly", minutes: int = 15, expected: int = 3, late: str = "1 hour") -> DataFrame:
    """Per series and interval: max, mean, deviation, coverage and any-flag, once the watermark passes."""
    w = F.window(ts, f"{minutes} minutes")
    agg = points.withWatermark(ts, late).groupBy("series_id", w.alias("w")).agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("score_std"), F.count(score).alias("n"), F.bool_or(flag).alias("is_anomaly"))
    return agg.select("series_id", F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), "max_score", "mean_score", "score_std", (F.col("n") / expected).alias("coverage_ratio"), "is_anomaly")


def sessions(flagged: DataFrame, *, ts: str = "ts", gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Events: flagged instants at most ``gap`` apart."""
    agg = flagged.withWatermark(ts, late).groupBy("series_id", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("interval_count"), F.max("score").alias("max_score"))
    return agg.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "interval_count", "max_score")


def with_frozen_percentile(points: DataFrame, bins: DataFrame, *, score: str = "score") -> DataFrame:
    """Stream-static join with frozen quantile bins (series_id, lower, upper, percentile): half-open, lower inclusive."""
    held = bins.withColumnRenamed("series_id", "b_series")
    on = (F.col("series_id") == F.col("b_series")) & (F.col(score) >= F.col("lower")) & (F.col(score) < F.col("upper"))
    return points.join(held, on, "left").drop("b_series", "lower", "upper")


def frozen_bins(reference: DataFrame, score: str, n: int = 200) -> DataFrame:
    """Quantile bins of a reference; ``percentile`` is the share at or below a bin's lower edge."""
    q = reference.groupBy("series_id").agg(F.percentile(score, F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("q"))
    rows = q.select("series_id", F.posexplode("q").alias("i", "lower"), "q")
    upper = F.coalesce(F.get("q", F.col("i") + 1), F.lit(float("inf")))
    return rows.select("series_id", F.when(F.col("i") == 0, float("-inf")).otherwise(F.col("lower")).alias("lower"), upper.alias("upper"), (F.col("i") / n).alias("percentile")).where("lower < upper")
