"""Runs, sessions and interval merging.  One sort by key and time serves each of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: Sequence[str], slot: str, *, gap: int, exact: bool = False, name: str = "island") -> DataFrame:
    """Numbers runs of ``rows`` from 1 per key: a new one starts after a step over ``gap`` (``exact``: other than ``gap``)."""
    w = Window.partitionBy(*keys).orderBy(slot)
    step = F.col(slot) - F.lag(slot).over(w)
    new = step.isNull() | ((step != gap) if exact else (step > gap))
    return rows.withColumn("__new", new.cast("int")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def flagged_runs(rows: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str = "island") -> DataFrame:
    """Rows where ``flag`` holds, numbered by runs of consecutive samples (not of time)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("__k", F.row_number().over(w)).where(flag)
    j = F.row_number().over(w)
    return rows.withColumn(name, F.col("__k") - j).drop("__k")


def constant_runs(rows: DataFrame, keys: Sequence[str], slot: str, values: Sequence[str], tol: float, name: str = "island") -> DataFrame:
    """Runs on adjacent slots where every value stays within ``tol`` of the one before; a null or a gap ends a run."""
    w = Window.partitionBy(*keys).orderBy(slot)
    same = F.col(slot) - F.lag(slot).over(w) == 1
    for v in values:
        same = same & (F.abs(F.col(v) - F.lag(v).over(w)) <= tol)
    rows = rows.withColumn("__new", (~F.coalesce(same, F.lit(False))).cast("int"))
    return rows.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_intervals(rows: DataFrame, keys: Sequence[str], start: str, end: str, *, gap: int = 0, touching: bool = True, name: str = "unit") -> DataFrame:
    """Numbers units of intervals by a running maximum of ends; ``touching``: start == end + gap still joins."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | ((F.col(start) > reach + gap) if touching else (F.col(start) >= reach + gap))
    return rows.withColumn("__new", new.cast("int")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def refine(rows: DataFrame, keys: Sequence[str], slot: str, score: str, *, core: float, edge: float) -> DataFrame:
    """Runs at ``edge`` or more that hold a slot at ``core`` or more: their slot bounds and best score."""
    runs = islands(rows.where(F.col(score) >= edge), keys, slot, gap=1)
    return runs.groupBy(*keys, "island").agg(F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.max(score).alias("best")).where(F.col("best") >= core)


def project(rows: DataFrame, keys: Sequence[str], slot: str, score: str, width: int, how: str = "max") -> DataFrame:
    """Each slot's best (or mean) score of the windows that cover it; ``rows`` hold window starts on a full grid."""
    w = Window.partitionBy(*keys).orderBy(slot).rangeBetween(-(width - 1), 0)
    return rows.withColumn("projected", (F.max if how == "max" else F.avg)(score).over(w))
