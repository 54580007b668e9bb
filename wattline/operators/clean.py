"""Duplicate policies, strict checks and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.timegrid import epoch


def dedupe(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], policy: str, value: str | None = None) -> DataFrame:
    """One row a key: ``first`` or ``last`` in ``order``, or ``mean`` of ``value``."""
    if policy == "mean":
        return rows.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    by = [c.asc() if policy == "first" else c.desc() for c in order]
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return rows.withColumn("__k", k).where("__k = 1").drop("__k")


def violations(rows: DataFrame, key: str, ts: str, value: str, minutes: int) -> DataFrame:
    """Counts per key of what strict reading rejects: nulls, infinities, off-grid and duplicate instants."""
    at = epoch(F.col(ts))
    per = rows.groupBy(key, ts).agg(F.count("*").alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("bad"), F.sum((F.abs(F.col(value)) == float("inf")).cast("long")).alias("inf"))
    off = (F.pmod(at, F.lit(60 * minutes)) != 0) | (F.date_format(ts, "SSSSSS") != "000000")
    return per.groupBy(key).agg(F.sum("bad").alias("n_null"), F.coalesce(F.sum("inf"), F.lit(0)).alias("n_infinite"), F.sum(F.when(off, F.col("n")).otherwise(0)).alias("n_off_grid"), F.sum(F.col("n") - 1).alias("n_duplicate"))


def with_gaps(rows: DataFrame, keys: Sequence[str], slot: str, value: str) -> DataFrame:
    """Adds prev_slot/prev_value, next_slot/next_value (nearest known) and gap (length of the null run, 0 where known)."""
    w = Window.partitionBy(*keys).orderBy(slot)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(slot).alias("s"), F.col(value).alias("v")))
    prev, next_ = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__p", prev).withColumn("__n", next_)
    gap = F.when(F.col(value).isNotNull(), 0).otherwise(F.col("__n.s") - F.col("__p.s") - 1)
    return rows.select("*", F.col("__p.s").alias("prev_slot"), F.col("__p.v").alias("prev_value"), F.col("__n.s").alias("next_slot"), F.col("__n.v").alias("next_value"), gap.alias("gap")).drop("__p", "__n")


def _line(slot: str) -> Column:
    part = (F.col(slot) - F.col("prev_slot")) / (F.col("next_slot") - F.col("prev_slot"))
    return F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * part


def fill(rows: DataFrame, keys: Sequence[str], slot: str, value: str, most: int, policy: str) -> DataFrame:
    """Linear filling into ``filled``.

    whole: interior runs of at most ``most`` slots, complete or not at all;
    inside: the first ``most`` slots of every interior run;
    both: slots within ``most`` of a known one on either side, edges by the nearest value.
    """
    rows = with_gaps(rows, keys, slot, value)
    since, until = F.col(slot) - F.col("prev_slot"), F.col("next_slot") - F.col(slot)
    interior = F.col("prev_slot").isNotNull() & F.col("next_slot").isNotNull()
    if policy == "whole":
        got = F.when(interior & (F.col("gap") <= most), _line(slot))
    elif policy == "inside":
        got = F.when(interior & (since <= most), _line(slot))
    else:
        near = F.coalesce(since <= most, F.lit(False)) | F.coalesce(until <= most, F.lit(False))
        got = F.when(near, F.when(interior, _line(slot)).otherwise(F.coalesce("prev_value", "next_value")))
    return rows.withColumn("filled", F.coalesce(F.col(value), got))


def long_gap_bins(rows: DataFrame, keys: Sequence[str], slot: str, value: str, most: int, per_bin: int) -> DataFrame:
    """Bins that hold a slot of a null run longer than ``most`` (runs at the edges count too)."""
    w = Window.partitionBy(*keys).orderBy(slot)
    rows = rows.withColumn("__b", F.sum(F.col(value).isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where(F.col(value).isNull()).withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "__b")))
    return runs.where(F.col("__n") > most).select(*keys, F.floor(F.col(slot) / per_bin).cast("long").alias("bin")).distinct()


def resample(rows: DataFrame, keys: Sequence[str], slot: str, value: str, per_bin: int, most: int) -> DataFrame:
    """Mean of filled slots per bin; bins of long gaps are null."""
    filled = fill(rows, keys, slot, value, most, "inside").withColumn("bin", F.floor(F.col(slot) / per_bin).cast("long"))
    means = filled.groupBy(*keys, "bin").agg(F.avg("filled").alias("mean"))
    blocked = long_gap_bins(rows, keys, slot, value, most, per_bin).withColumn("blocked", F.lit(True))
    return means.join(blocked, [*keys, "bin"], "left").select(*keys, "bin", F.when(F.col("blocked").isNull(), F.col("mean")).alias("mean"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
