"""Injected truth, confusion measures, votes, samples and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from wattline.functions.scalars import stable_hex


def injected(value: Column, original: Column) -> Column:
    """A point counts as injected if it was moved by more than 1e-4."""
    return F.coalesce(F.abs(value - original) > 1e-4, F.lit(False))


def confusion(rows: DataFrame, keys: Sequence[str], flag: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1; without keys one global row."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    agg = [n(flag & truth).alias("tp"), n(flag & ~truth).alias("fp"), n(~flag & truth).alias("fn"), n(~flag & ~truth).alias("tn")]
    out = rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0)))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def votes(scores: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """any, at least two, all of ``models``: a model without a row doesn't flag, other models have no vote."""
    flagged = F.when(F.coalesce("is_anomaly", F.lit(False)) & F.col("model").isin(*models), F.col("model"))
    n = scores.groupBy(*keys).agg(F.count_distinct(flagged).alias("n_flags"))
    return n.select(*keys, (F.col("n_flags") >= 1).alias("any"), (F.col("n_flags") >= 2).alias("two"), (F.col("n_flags") == len(set(models))).alias("all"))


def raw_aggregates(points: DataFrame, cases: DataFrame, series: str, slot: str, value: str, *, case: str = "case_id", start: str = "start", end: str = "end", width: int = 3) -> DataFrame:
    """Mean, least, most and number of the known points in each block of ``width`` slots of a case's slots [start, end)."""
    span = cases.select(case, series, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("block"), F.col(start).alias("__a"), F.col(end).alias("__b"))
    at = points.select(series, F.col(slot).alias("__s"), F.col(value).alias("__v"), F.floor(F.col(slot) / width).alias("block"))
    met = span.join(at, [series, "block"], "left")
    known = F.when((F.col("__s") >= F.col("__a")) & (F.col("__s") < F.col("__b")), F.col("__v"))
    return met.groupBy(case, series, "block").agg(F.avg(known).alias("mean"), F.min(known).alias("least"), F.max(known).alias("most"), F.count(known).alias("n_points"))


def hash_sample(rows: DataFrame, strata: Sequence[str], id_col: str, k: int, *, first: Sequence[Column] = ()) -> DataFrame:
    """k rows of each stratum in order of ``first``, then of the id's SHA-256: reruns agree."""
    w = Window.partitionBy(*strata).orderBy(*first, stable_hex(F.col(id_col)), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evenly_spaced(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Rows at the positions of k evenly spaced ones, both ends included."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(order)) - 1
    ranked = rows.withColumn("position", at).withColumn("__n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(max(1, k - 1))))
    return ranked.where((F.col("__n") <= k) | F.array_contains(wanted, F.col("position").cast("long"))).drop("__n")


def select_diverse(ranked: DataFrame, device: str, at: str, quota: int, *, caps: Sequence[int] = (1, 2, 4), apart: int = 12 * 3600) -> list:
    """Greedy choice on the driver from rows in rank order: rising caps a device, ``apart`` seconds between one device's cases.  ``diverse`` serves large tables."""
    rows, chosen = ranked.collect(), []
    for cap in [*caps, quota]:
        for r in rows:
            if len(chosen) == quota:
                return chosen
            own = [c for c in chosen if c[device] == r[device]]
            if r not in chosen and len(own) < cap and all(abs(c[at] - r[at]) >= apart for c in own):
                chosen.append(r)
    return chosen


def diverse(rows: DataFrame, device: str, at: str, rank: Sequence[Column], quota: int, *, caps: Sequence[int] = (1, 2, 4), apart: int = 12 * 3600) -> list[Row]:
    """``select_diverse`` over all rows of a table, best first by ascending ``rank``.

    What a device may give next depends on its own cases only: each pass takes every
    device's best row that lies ``apart`` from its cases, by one partial aggregate.
    Only a first pass that leaves devices over ends the choice, so at most
    quota * quota rows reach the driver.
    """
    names = rows.columns
    ranked = rows.select(F.col(device).alias("__device"), F.col(at).alias("__at"), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]).alias("__rank"), F.struct(*names).alias("__row"))
    chosen: list[Row] = []
    taken: list[Row] = []
    passes = 0
    for cap in [*caps, quota]:
        fresh: list[Row] = []
        while passes < cap:
            left = ranked
            if taken:
                t = rows.sparkSession.createDataFrame([(r["__device"], r["__at"]) for r in taken], ranked.select(F.col("__device").alias("t_device"), F.col("__at").alias("t_at")).schema)
                left = ranked.join(F.broadcast(t), F.col("__device").eqNullSafe(F.col("t_device")) & (F.abs(F.col("__at") - F.col("t_at")) < apart), "left_anti")
            best = left.groupBy("__device").agg(F.min(F.struct("__rank", "__at", "__row")).alias("b")).select("__device", "b.*")
            got = best.orderBy("__rank", "__at", "__row").limit(quota).collect()
            passes += 1
            if not got:
                passes = quota
                break
            fresh += got
            taken += got
            if passes == 1 and len(got) == quota:
                break
        fresh.sort(key=lambda r: (r["__rank"], r["__at"], r["__row"]))
        chosen += fresh
        if len(chosen) >= quota or passes >= quota:
            break
    return [r["__row"] for r in chosen[:quota]]


def choose_positions(rows: DataFrame, key: str, score: str, id_col: str) -> DataFrame:
    """Of each key the row with the highest score and the one in the middle of the order."""
    w = Window.partitionBy(key)
    k = F.row_number().over(w.orderBy(F.desc(score), id_col))
    n = F.count("*").over(w)
    return rows.withColumn("k", k).withColumn("n", n).where((F.col("k") == 1) | (F.col("k") == F.floor((F.col("n") + 1) / 2))).withColumn("pick", F.when(F.col("k") == 1, "highest").otherwise("median")).drop("k", "n")


def sensitivity(sequences: DataFrame, scenarios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events each scenario (threshold, gap) leaves: starts of sequences whose gap to the one before is larger."""
    met = sequences.crossJoin(F.broadcast(scenarios)).where(F.col("score") >= F.col("threshold"))
    w = Window.partitionBy("scenario", *keys).orderBy("start")
    new = F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > F.col("gap"))
    return met.withColumn("__new", new.cast("long")).groupBy("scenario").agg(F.sum("__new").alias("n_events"), F.count("*").alias("n_sequences"))
