"""Detection rules: interval scores, candidates, events, quality and triage decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.islands import constant_runs, islands


def combine(parts: Sequence[Column], limit: float = 0.995) -> dict[str, Column]:
    """Max, mean, population deviation, coverage, availability and flag of the finite components (0..1)."""
    known = F.array_compact(F.array(*[F.when(~F.isnan(p), p) for p in parts]))
    n = F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)
    var = F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.when(n > 0, n)
    top = F.array_max(known)
    return {"max_score": top, "mean_score": mean, "score_std": F.sqrt(var), "coverage_ratio": n / F.lit(len(parts)), "available": n > 0, "is_anomaly": F.coalesce(top > limit, F.lit(False))}


def candidate(short: Column, medium: Column, alone: float = 99.5, both: float = 99.0) -> Column:
    s, m = F.coalesce(short, F.lit(-1.0)), F.coalesce(medium, F.lit(-1.0))
    return (s > alone) | (m > alone) | ((s > both) & (m > both))


def confidence(short_max: Column, medium_max: Column, support: Column) -> Column:
    s, m = F.coalesce(short_max > 99, F.lit(False)), F.coalesce(medium_max > 99, F.lit(False))
    return F.when(s & m & support, "HIGH").when((s & m) | support, "MEDIUM").otherwise("CANDIDATE")


def event_type(daily: Column, change: Column, magnitude: Column, short_max: Column, medium_max: Column) -> Column:
    """First rule that fits."""
    s, m = F.coalesce(short_max > 99, F.lit(False)), F.coalesce(medium_max > 99, F.lit(False))
    return F.when(daily, "daily_pattern_change").when(change, "state_change").when(m & ~s, "sustained_deviation").when(magnitude & ~(s | m), "magnitude_anomaly").otherwise("shape_change")


def flatlines(rows: DataFrame, keys: Sequence[str], slot: str, value: str, *, least: int = 24, tol: float = 0.001) -> DataFrame:
    """Runs of at least ``least`` slots with steps and range within ``tol``."""
    runs = constant_runs(rows.where(F.col(value).isNotNull()), keys, slot, [value], tol)
    agg = runs.groupBy(*keys, "island").agg(F.min(slot).alias("start"), (F.max(slot) + 1).alias("end"), F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread"), F.avg(value).alias("level"))
    return agg.where((F.col("n") >= least) & (F.col("spread") <= tol)).drop("island")


def freezes(rows: DataFrame, keys: Sequence[str], slot: str, sensors: Sequence[str], power: str, *, least: int = 24, floor: float = 0.05) -> DataFrame:
    """Runs where every sensor is known and unchanged, with power above ``floor``; they may cross midnight, not gaps."""
    known = rows.where(" AND ".join(f"{s} IS NOT NULL" for s in sensors))
    runs = constant_runs(known, keys, slot, sensors, 0.0)
    agg = runs.groupBy(*keys, "island").agg(F.min(slot).alias("start"), (F.max(slot) + 1).alias("end"), F.count("*").alias("n"), F.min(F.abs(F.col(power))).alias("power"))
    return agg.where((F.col("n") >= least) & (F.col("power") > floor)).drop("island", "power")


def flatline_events(flat: DataFrame, history: DataFrame, keys: Sequence[str], value: str, per_day: int, *, tol: float = 0.001) -> DataFrame:
    """Flat runs that are odd for their slots' history: skipped where history is flat too or both are near zero."""
    slots = flat.withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).withColumn("slot", F.pmod("slot", F.lit(per_day)))
    per = history.groupBy(*keys, "slot", "day").agg(F.avg(value).alias("v"))
    typical = slots.join(per, [*keys, "slot"]).groupBy(*keys, "start", "end", "level", "n", "day").agg((F.max("v") - F.min("v")).alias("r"), F.avg(F.abs(F.col("v"))).alias("l"))
    typical = typical.groupBy(*keys, "start", "end", "level", "n").agg(F.median("r").alias("usual_range"), F.median("l").alias("usual_level"))
    calm = (F.abs(F.col("level")) <= 0.05) & (F.col("usual_level") <= 0.05)
    return typical.where((F.col("usual_range") > max(10 * tol, 0.05)) & ~calm).withColumn("confidence", F.lit("physical"))


def near_start(rows: DataFrame, keys: Sequence[str], slot: str, *, before: int = 2, after: int = 1) -> DataFrame:
    """Evidence that may admit a run that starts at a row: a jump into it or into the row before, a change point near it.

    Columns jump_in, jump and change become jump_near and change_near; rows are the whole grid of a key.
    """
    w = Window.partitionBy(*keys).orderBy(slot)
    jump = F.coalesce(F.col("jump_in") > F.col("jump"), F.lit(False))
    near = F.max(F.coalesce(F.col("change"), F.lit(False))).over(w.rangeBetween(-before, after))
    return rows.withColumn("__j", jump).withColumn("jump_near", F.col("__j") | F.coalesce(F.max("__j").over(w.rangeBetween(-1, -1)), F.lit(False))).withColumn("change_near", near).drop("__j")


def magnitude_runs(rows: DataFrame, keys: Sequence[str], slot: str, *, least: int = 3, support: int = 6, percentile: float = 99.5, more: Sequence[Column] = ()) -> DataFrame:
    """Runs of points beyond the envelope by more than the effect; columns value, lower, upper, effect, support, percentile, quality."""
    excess = F.greatest(F.col("value") - F.col("upper"), F.col("lower") - F.col("value"))
    rows = rows.withColumn("excess", excess)
    hit = (F.col("excess") > F.col("effect")) & (F.col("percentile") >= percentile) & (F.col("support") >= support) & ~F.col("quality")
    runs = islands(rows.where(hit), keys, slot, gap=1)
    agg = runs.groupBy(*keys, "island").agg(F.min(slot).alias("start"), (F.max(slot) + 1).alias("end"), F.count("*").alias("n"), F.max("excess").alias("peak"), F.first("effect").alias("effect"), F.max("jumped").alias("jumped"), *more)
    return agg.where(F.col("n") >= least).drop("island")


def magnitude_confirmed(mode: str, *, current_share: Column, jumped: Column, change: Column, shape: Column, peak: Column, effect: Column) -> Column:
    current = F.coalesce(current_share >= 0.5, F.lit(False))
    if mode == "envelope_confirmed":
        return current | jumped | change
    return (peak > 2 * effect) & (jumped | change | (shape & current))


def direction_runs(rows: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Runs of points above (+1) or below (-1) the envelope by more than the effect; opposite signs never join."""
    sign = F.when(F.col("value") - F.col("upper") > F.col("effect"), 1).when(F.col("lower") - F.col("value") > F.col("effect"), -1)
    runs = islands(rows.withColumn("direction", sign).where("direction IS NOT NULL"), [*keys, "direction"], slot, gap=1)
    peak = F.max(F.greatest(F.col("value") - F.col("upper"), F.col("lower") - F.col("value")))
    first = F.min_by(F.coalesce(F.col("jump_in"), F.lit(0.0)), slot)
    return runs.groupBy(*keys, "direction", "island").agg(F.min(slot).alias("start"), (F.max(slot) + 1).alias("end"), F.count("*").alias("n"), peak.alias("peak"), first.alias("onset"), F.first("effect").alias("effect"), F.first("jump").alias("jump"), F.max("short").alias("short"), F.max("medium").alias("medium"), F.avg(F.coalesce("current_beyond", F.lit(False)).cast("double")).alias("current_share")).drop("island")


def triage_reasons(runs: DataFrame, least: int = 3) -> DataFrame:
    """Failed guards of each run in fixed order, and whether it is a priority core (none failed)."""
    guards = [
        (F.col("n") >= least, "no_sustained_historical_envelope_exceedance"),
        (F.col("peak") >= 2 * F.col("effect"), "insufficient_peak_power_effect"),
        (F.col("onset") > F.col("jump"), "no_abrupt_onset_above_frozen_jump_guard"),
        (((F.col("short") >= 99) & (F.col("medium") >= 99)) | (F.col("current_share") >= 0.5), "no_multiscale_or_current_confirmation"),
    ]
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), name) for g, name in guards]))
    return runs.withColumn("reasons", F.array_join(reasons, "|")).withColumn("core", F.col("reasons") == "")


def queue(kind: Column, has_reference: Column, has_core: Column) -> Column:
    return F.when(kind == "data_quality", "data_quality").when(~has_reference, "operating_change_review").when(has_core, "priority_alert").otherwise("operating_change_review")


def lof_bins(points: DataFrame, keys: Sequence[str], slot: str, score: str, flag: str, width: int = 3) -> DataFrame:
    """Bins of ``width`` points: greatest, mean and deviation (population) of the score, points and flags, coverage, whether complete, and any flag (unknown without one)."""
    bins = points.withColumn("bin", F.floor(F.col(slot) / width).cast("long")).groupBy(*keys, "bin")
    out = bins.agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("score_std"), F.count(score).alias("n_points"), F.sum(F.col(flag).cast("int")).cast("long").alias("n_flags"), F.max(flag).alias("is_anomaly"))
    return out.withColumns({"coverage_ratio": F.col("n_points") / F.lit(width), "complete": F.col("n_points") == width})


def trigger(short: Column, medium: Column, magnitude: Column, limit: float = 0.995) -> Column:
    """Which components pass the limit: shape_and_magnitude, shape, magnitude or none."""
    shape = F.coalesce(F.greatest(short, medium) > limit, F.lit(False))
    size = F.coalesce(magnitude > limit, F.lit(False))
    return F.when(shape & size, "shape_and_magnitude").when(shape, "shape").when(size, "magnitude").otherwise("none")


def block_scores(points: DataFrame, keys: Sequence[str], slot: str, error: str, width: int = 3) -> DataFrame:
    """Max, mean and population deviation of the last ``width`` errors."""
    w = Window.partitionBy(*keys).orderBy(slot).rowsBetween(-(width - 1), 0)
    return points.select("*", F.max(error).over(w).alias("max_error"), F.avg(error).over(w).alias("mean_error"), F.stddev_pop(error).over(w).alias("error_std"), F.count(error).over(w).alias("n_points"))


def sliding_windows(points: DataFrame, keys: Sequence[str], slot: str, value: str, observed: str, *, width: int, stride: int, missing_ratio: float) -> DataFrame:
    """Window ends every ``stride`` slots: complete and observed counts, and whether the window may be scored."""
    w = Window.partitionBy(*keys).orderBy(slot).rowsBetween(-(width - 1), 0)
    out = points.select("*", F.count(value).over(w).alias("n_filled"), F.sum(F.col(observed).cast("int")).over(w).alias("n_observed"), F.count("*").over(w).alias("n_slots"))
    ok = (F.col("n_slots") == width) & (F.col("n_filled") == width) & (width - F.col("n_observed") <= missing_ratio * width + 1e-9)
    return out.where(F.pmod(F.col(slot) + 1, F.lit(stride)) == 0).withColumn("status", F.when(F.col("n_slots") < width, "insufficient_history").when(ok, "scored").otherwise("missing_data"))
