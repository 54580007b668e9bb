"""Regular grids.  Slots are integers (epoch minutes divided by the step), so intervals are half-open by construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970; zone-free timestamps are read in the session's zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def slot_of(ts: Column, minutes: int) -> Column:
    return F.floor(epoch(ts) / F.lit(60 * minutes)).cast("long")


def full_grid(series: DataFrame, first: int, last: int, name: str = "slot") -> DataFrame:
    """Every slot first..last-1 for each row of ``series``; slots are generated where the series are, nothing is joined."""
    return series.select("*", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long"))).alias(name))


def complete(rows: DataFrame, key: str, first: int, last: int, slot: str = "slot") -> DataFrame:
    """``rows`` on the full grid of every key: missing slots hold nulls."""
    return full_grid(rows.select(key).distinct(), first, last, slot).join(rows, [key, slot], "left")


def local_day_slots(day: str, zone: str, minutes: int = 5) -> Column:
    """The instants of a local calendar day, fewer or more than usual when clocks change."""
    begin = F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), 1).cast("timestamp"), zone)
    return F.sequence(begin, end - F.expr(f"INTERVAL {minutes} MINUTES"), F.expr(f"INTERVAL {minutes} MINUTES"))


def role(slot: Column, *, baseline: int, train_end: int, test_start: int, test_end: int) -> Column:
    """baseline, context, test, or outside."""
    return F.when((slot >= baseline) & (slot < train_end), "baseline").when((slot >= train_end) & (slot < test_start), "context").when((slot >= test_start) & (slot < test_end), "test").otherwise("outside")


def valid_days(rows: DataFrame, keys: Sequence[str], day: str, value: str, per_day: int, ratio: float) -> DataFrame:
    """Days whose known values reach ceil(ratio * per_day)."""
    need = -(-int(round(ratio * per_day * 1e6)) // 1_000_000)
    return rows.groupBy(*keys, day).agg(F.count(value).alias("n_known")).withColumn("valid", F.col("n_known") >= need)


def upsample(rows: DataFrame, slot: str, times: int) -> DataFrame:
    """Each slot repeated on a grid ``times`` as fine, with where it came from."""
    return rows.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(times)]))).withColumn("source_slot", F.col(slot)).withColumn(slot, F.col(slot) * times + F.col("part"))


def chronological_split(rows: DataFrame, key: str, order: str, ratio: float) -> DataFrame:
    """The last round(n * ratio) rows of each key are ``test``, the others ``train``."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    k = F.row_number().over(w.orderBy(order))
    n = F.count("*").over(w)
    return rows.withColumn("part", F.when(k > n - F.round(n * F.lit(ratio)).cast("long"), "test").otherwise("train"))


def four_way(rows: DataFrame, key: str, order: str, ratios: tuple[float, float, float]) -> DataFrame:
    """train, validation, calibration by int(n * ratio) each, the rest test."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    k = F.row_number().over(w.orderBy(order)) - 1
    n = F.count("*").over(w)
    a, b, c = (F.floor(n * F.lit(r)) for r in ratios)
    return rows.withColumn("part", F.when(k < a, "train").when(k < a + b, "validation").when(k < a + b + c, "calibration").otherwise("test"))


def global_positions(rows: DataFrame, key: str, name: str = "position", buckets: int = 64) -> DataFrame:
    """Position of each row by a numeric key, from 0, without one task that sorts all rows.

    Quantile cuts part the rows into ranges; a range's rows are numbered on their own and shifted by the ranges before it.
    """
    from pyspark.sql import Window

    cuts = sorted(set(rows.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.001)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    parted = rows.withColumn("__b", part)
    before = parted.groupBy("__b").agg(F.count("*").alias("n"))
    before = before.select("__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    k = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return parted.withColumn("__k", k).join(F.broadcast(before), "__b").withColumn(name, F.col("__before") + F.col("__k")).drop("__b", "__k", "__before")
