"""Interval joins without theta joins: intervals are cut into buckets and meet on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators import islands


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose keys are unique on both sides; a key that repeats is an error before any row is joined."""
    for name, side in (("left", left), ("right", right)):
        again = side.groupBy(*keys).count().where("count > 1").limit(3).collect()
        if again:
            raise ValueError(f"keys repeat on the {name} side: {[tuple(r)[:-1] for r in again]}")
    return left.join(right, keys, how)


def buckets(rows: DataFrame, start: str, end: str, width: int, name: str = "bucket") -> DataFrame:
    """One row for each bucket of ``width`` that [start, end) touches."""
    return rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width).cast("long"))))


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, *, a_span=("start", "end"), b_span=("b_start", "b_end")) -> DataFrame:
    """Pairs of overlapping intervals, each once: in the first bucket that both touch."""
    x, y = buckets(a, *a_span, width), buckets(b, *b_span, width)
    meet = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / width).cast("long")
    return x.join(y, [*keys, "bucket"]).where((F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0])) & (F.col("bucket") == meet)).drop("bucket")


def without_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, a_id: str, **spans) -> DataFrame:
    """Rows of ``a`` that no interval of ``b`` overlaps."""
    return a.join(overlapping(a, b, keys, width, **spans).select(*keys, a_id).distinct(), [*keys, a_id], "left_anti")


def bucket_truth(points: DataFrame, windows: DataFrame, keys: Sequence[str], point: str, start: str, width: int, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of the points inside each window [start, start + width) on the window grid: an equi-join."""
    per = points.withColumn(start, (F.floor(F.col(point) / width) * width).cast("long")).groupBy(*keys, start).agg(*aggs)
    return windows.join(per, [*keys, start], "left")


def covered_points(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str) -> DataFrame:
    """Points inside any [start, end) of ``spans``: slots are generated from the spans and meet on equality."""
    slots = spans.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(point)).distinct()
    return points.join(slots, [*keys, point], "left_semi")


def latest_before(rows: DataFrame, key: str, order: str, value: str, bound: Column, real: Column) -> DataFrame:
    """The last real observation before ``bound``."""
    return rows.where(real & (F.col(order) < bound)).groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def in_all(rows: DataFrame, item: str, member: str, n: Column | int) -> DataFrame:
    """Items that all members have."""
    return rows.groupBy(item).agg(F.countDistinct(member).alias("n_members")).where(F.col("n_members") == n)


def _met(pdf: pd.DataFrame, lo: int, width: int) -> np.ndarray:
    """For each query row of one bucket its overlaps with units, less the gaps inside it; pairs that both began earlier were counted there."""
    s, e, kind = (pdf[c].to_numpy() for c in ("start", "end", "kind"))
    qs, qe = s[kind == 0], e[kind == 0]
    us, ue = s[kind == 1], e[kind == 1]
    us, ue, later = np.sort(us), np.sort(ue), np.sort(us[us >= lo])
    n = np.where(qs >= lo, np.searchsorted(us, qe) - np.searchsorted(ue, qs, "right"), np.searchsorted(later, qe))
    gs, ge = s[kind == 2], e[kind == 2]
    for at in range(lo, lo + width):
        n -= np.where(qs < at, np.searchsorted(np.sort(ge[gs == at]), qe), 0)
    return n


def channels_met(events: DataFrame, groups: Sequence[str], series: str, event: str, width: int) -> DataFrame:
    """(event, n_channels): series of its group with an event that overlaps it, itself included; ends lie after starts.

    Each series is merged into disjoint units.  The units that overlap an interval
    follow one another, so a series is counted once if the gaps between them are
    taken off again.  Both counts add up over buckets: no pair is made.
    """
    by = [*groups, series]
    units = islands.merge_intervals(events.select(*by, "start", "end"), by, "start", "end").groupBy(*by, "unit").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gaps = units.select(*groups, F.col("end").alias("start"), F.lead("start").over(Window.partitionBy(*by).orderBy("start")).alias("end")).where("end IS NOT NULL")
    rows = buckets(events.select(*groups, event, "start", "end"), "start", "end", width).withColumn("kind", F.lit(0))
    rows = rows.unionByName(buckets(units.select(*groups, "start", "end"), "start", "end", width).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(gaps.withColumn("bucket", F.floor(F.col("start") / width).cast("long")).withColumn("kind", F.lit(2)), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({event: pdf.loc[pdf["kind"] == 0, event], "n": _met(pdf, int(pdf["bucket"].iloc[0]) * width, width)})

    part = rows.groupBy(*groups, "bucket").applyInPandas(run, f"`{event}` {dict(events.dtypes)[event]}, n long")
    return part.groupBy(event).agg(F.sum("n").alias("n_channels"))


def common_mode(events: DataFrame, eligible: DataFrame, groups: Sequence[str], series: str, event: str, width: int, *, least: int = 3, share: float = 0.3) -> DataFrame:
    """Per event the channels of its group with an overlapping event, and whether they are common mode."""
    out = events.join(channels_met(events, groups, series, event, width), event).join(eligible, list(groups))
    return out.withColumn("common_mode", (F.col("n_channels") >= least) & (F.col("n_channels") / F.col("eligible") >= share))


def components(edges: DataFrame, nodes: DataFrame, *, rounds: int = 50) -> DataFrame:
    """Smallest reachable node of every node, by label propagation with pointer jumping; each round is checkpointed."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select(F.col("node"), F.col("node").alias("unit"))
    durable = label.sparkSession.conf.get("spark.checkpoint.dir", None) is not None or label.sparkSession.sparkContext.getCheckpointDir() is not None
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("unit").alias("m"))
        step = label.join(near, "node", "left").select("node", F.least("unit", F.coalesce("m", "unit")).alias("unit"))
        jump = step.join(step.select(F.col("node").alias("unit"), F.col("unit").alias("further")), "unit", "left").select("node", F.least("unit", F.coalesce("further", "unit")).alias("unit"))
        jump = jump.checkpoint() if durable else jump.persist()
        if jump.join(label.withColumnRenamed("unit", "before"), "node").where("unit != before").isEmpty():
            return jump
        label = jump
    raise RuntimeError("components did not settle")
