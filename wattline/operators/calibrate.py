"""Frozen calibration: distribution functions, quantiles, scales and references.

Reference rows are flagged, and one window sort per series answers all targets:
the count of reference values up to each value.  No reference array is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ecdf(rows: DataFrame, keys: Sequence[str], value: str, is_reference: Column, name: str = "percentile") -> DataFrame:
    """Right-closed share of reference values up to each value, 0..1; null without value or reference."""
    ref = is_reference & F.col(value).isNotNull()
    w = Window.partitionBy(*keys)
    up_to = F.sum(ref.cast("int")).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), F.try_divide(up_to.cast("double"), F.sum(ref.cast("int")).over(w))))


def ecdf_mid(rows: DataFrame, keys: Sequence[str], value: str, is_reference: Column, name: str = "percentile") -> DataFrame:
    """Mid-rank percentile 0..100: lower ones plus half of the ties."""
    ref = (is_reference & F.col(value).isNotNull()).cast("int")
    w = Window.partitionBy(*keys)
    up_to = F.sum(ref).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    ties = F.sum(ref).over(Window.partitionBy(*keys, value))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), F.try_divide((up_to - ties / 2) * 100.0, F.sum(ref).over(w))))


def same_slot(history: DataFrame, target: DataFrame, keys: Sequence[str], slot: str, value: str) -> DataFrame:
    """Mid-rank percentile of each target's deviation from its slot's median among the history's deviations.

    Deviations tie within 1e-12 + 1e-9 * |history's|; ties are not lower.
    """
    known = history.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys, slot)
    dev = known.withColumn("m", F.median(value).over(w)).select(*keys, slot, F.abs(F.col(value) - F.col("m")).alias("d"), "m")
    packed = dev.groupBy(*keys, slot).agg(F.first("m").alias("m"), F.collect_list("d").alias("ds"))
    met = target.join(packed, [*keys, slot], "left")
    x = F.abs(F.col(value) - F.col("m"))
    tie = lambda d: F.abs(d - x) <= F.lit(1e-12) + F.lit(1e-9) * F.abs(d)
    lower, equal = F.size(F.filter("ds", lambda d: (d < x) & ~tie(d))), F.size(F.filter("ds", tie))
    return met.withColumn("percentile", F.when(F.col(value).isNotNull() & F.col("m").isNotNull(), (lower + equal / 2) / F.size("ds") * 100)).drop("ds", "m")


def thresholds(rows: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("threshold"))


def with_threshold(rows: DataFrame, keys: Sequence[str], value: str, is_reference: Column, q: float) -> DataFrame:
    """Adds the reference's quantile to every row: one more window over a partitioning that calibration has anyway."""
    return rows.withColumn("threshold", F.percentile(F.when(is_reference, F.col(value)), F.lit(q)).over(Window.partitionBy(*keys)))


def mad(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, median absolute deviation and 95th percentile of absolute values."""
    rows = rows.select(*keys, value)
    middle = rows.groupBy(*keys).agg(F.median(value).alias("median"), F.percentile(F.abs(F.col(value)), F.lit(0.95)).alias("p95"))
    return rows.join(middle, list(keys)).groupBy(*keys).agg(F.first("median").alias("median"), F.first("p95").alias("p95"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def scales(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Center and scale, robust (median, interquartile range) and standard (mean, population deviation); 0 scales become 1."""
    one = lambda c: F.when(c == 0, F.lit(1.0)).otherwise(c)
    q = rows.groupBy(*keys).agg(F.median(value).alias("center"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return q.select(*keys, "center", one(F.col("iqr")).alias("scale"), "mean", one(F.col("std")).alias("std"))


def envelope(history: DataFrame, keys: Sequence[str], slot: str, day: str, value: str, *, reach: int, per_day: int, q: float) -> DataFrame:
    """Per slot, quantiles of values pooled over neighbouring slots; support counts days with a value."""
    spread = history.where(F.col(value).isNotNull()).withColumn("at", F.explode(F.sequence(F.col(slot) - reach, F.col(slot) + reach))).where((F.col("at") >= 0) & (F.col("at") < per_day))
    return spread.groupBy(*keys, F.col("at").alias(slot)).agg(F.percentile(value, F.lit(q)).alias("lower"), F.percentile(value, F.lit(1 - q)).alias("upper"), F.median(value).alias("median"), F.countDistinct(day).alias("support"))


def magnitude_scalars(history: DataFrame, keys: Sequence[str], day: str, slot: str, value: str, *, least: float, relative: float, q: float) -> DataFrame:
    """effect = max(least, relative * p95 |x|); jump = max(effect, q of |steps| inside days)."""
    w = Window.partitionBy(*keys, day).orderBy(slot)
    step = F.when(F.col(slot) - F.lag(slot).over(w) == 1, F.abs(F.col(value) - F.lag(value).over(w)))
    agg = history.withColumn("step", step).groupBy(*keys).agg(F.percentile(F.abs(F.col(value)), F.lit(0.95)).alias("p95"), F.percentile("step", F.lit(q)).alias("q_step"))
    effect = F.greatest(F.lit(least), relative * F.col("p95"))
    return agg.select(*keys, effect.alias("effect"), F.greatest(effect, F.col("q_step")).alias("jump"))


def active_slots(history: DataFrame, keys: Sequence[str], slot: str, value: str) -> DataFrame:
    """Solar-active slots: median |x| over max(0.05, 0.05 * 95th percentile of all |x|)."""
    level = history.groupBy(*keys).agg(F.percentile(F.abs(F.col(value)), F.lit(0.95)).alias("q95"))
    per = history.groupBy(*keys, slot).agg(F.median(F.abs(F.col(value))).alias("m"))
    return per.join(level, list(keys)).select(*keys, slot, (F.col("m") > F.greatest(F.lit(0.05), 0.05 * F.col("q95"))).alias("active"))


def admission(history: DataFrame, keys: Sequence[str], value: str, *, low: float = 0.5, flat: float = 0.01, solar: bool = False) -> DataFrame:
    """low_activity, constant_signal or ready."""
    base = history.groupBy(*keys).agg(F.percentile(F.abs(F.col(value)), F.lit(0.95)).alias("p95"))
    used = history.join(base, list(keys))
    if solar:
        used = used.where(F.abs(F.col(value)) > F.greatest(F.lit(0.05), 0.05 * F.col("p95")))
    m = mad(used, keys, value).select(*keys, "mad").join(used.groupBy(*keys).agg(F.countDistinct(value).alias("kinds")), list(keys))
    status = F.when(F.col("p95") < low, "low_activity").when(F.col("kinds").isNull() | (F.col("kinds") <= 1) | (F.col("mad") < flat), "constant_signal").otherwise("ready")
    return base.join(m, list(keys), "left").select(*keys, "p95", "mad", status.alias("status"))
