"""Longer compositions: exporters, preparation, detector runs, review cases and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators import calibrate, detect, islands, joins, profile
from wattline.operators.timegrid import full_grid


@dataclass(frozen=True)
class Profile:
    """Roles of a dataset in order: baseline < train_end <= context < test_start < test_end (slots)."""

    baseline: int
    train_end: int
    context: int
    test_start: int
    test_end: int
    window: int = 288
    stride: int = 3

    def problems(self) -> list[str]:
        out = []
        if not self.baseline < self.train_end <= self.context < self.test_start < self.test_end:
            out.append("roles overlap or are out of order")
        if self.window < 2 or not 1 <= self.stride <= self.window:
            out.append("window and stride don't fit")
        return out


def calibration_matches(scores: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Rows per model whose calibration version does not begin as the profile says."""
    want = F.lit(None).cast("string")
    for m, p in prefixes.items():
        want = F.when(F.col("model") == m, F.lit(p)).otherwise(want)
    return scores.withColumn("ok", F.coalesce(F.col("calibration_version").startswith(want), F.lit(False))).groupBy("model").agg(F.count_if(~F.col("ok")).alias("n_wrong"))


def required(*frames: DataFrame) -> DataFrame:
    """Union by name of shards that must share one schema; empty ones keep it."""
    names = frames[0].columns
    for f in frames[1:]:
        if sorted(f.columns) != sorted(names):
            raise ValueError(f"shard columns differ: {f.columns}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def unique_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def clip_and_require(rows: DataFrame, series: str, day: str, end, start=None, until=None) -> DataFrame:
    """Rows up to ``end`` of the series with a day in [start, until)."""
    kept = rows.where(F.col(day) <= end)
    if start is None:
        return kept
    return kept.join(rows.where((F.col(day) >= start) & (F.col(day) < until)).select(series).distinct(), series, "left_semi")


def coverage_manifest(rows: DataFrame, series: str, role: str, day: str, value: str) -> DataFrame:
    return rows.groupBy(series, role).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_known"), F.countDistinct(day).alias("n_days"))


def day_status(days: DataFrame, *, per_day: int, ratio: float, slots: str = "n_slots", known: str = "n_known") -> DataFrame:
    """ready, dst_transition (a day of another length) or low_coverage."""
    s = F.when(F.col(slots) != per_day, "dst_transition").when(F.col(known) < F.ceil(F.lit(ratio * per_day)), "low_coverage").otherwise("ready")
    return days.withColumn("status", s)


def backfill_status(status: DataFrame, series: DataFrame, key: str, first_day: int, end_day: int, default: str = "no_data") -> DataFrame:
    """A status for every series and day."""
    return full_grid(series.select(key).distinct(), first_day, end_day, "day").join(status, [key, "day"], "left").withColumn("status", F.coalesce("status", F.lit(default)))


def meter_days(rows: DataFrame, meter: str, channel: str, day: str, slot: str, value: str, per_day: int) -> DataFrame:
    """Per meter and day that all its channels have in full: values of all channels, channel by channel."""
    n = rows.groupBy(meter).agg(F.countDistinct(channel).alias("n_channels"))
    full = rows.where(F.col(value).isNotNull()).groupBy(meter, day).agg(F.sort_array(F.collect_list(F.struct(channel, slot, value))).alias("a"))
    full = full.join(n, meter).where(F.size("a") == F.col("n_channels") * per_day)
    return full.select(meter, day, F.transform("a", lambda s: s[value]).alias("values"))


def scoring_frame(baseline: DataFrame, test: DataFrame, keys: Sequence[str], slot: str, tail: int) -> DataFrame:
    """The last ``tail`` baseline rows of each key before the test rows."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(slot)))
    return baseline.withColumn("__k", k).where(F.col("__k") <= tail).drop("__k").withColumn("split", F.lit("baseline")).unionByName(test.withColumn("split", F.lit("test")))


def stale_gate(rows: DataFrame, key: str, slot: str, real: Column, boundary: int, *, most: int, train_least: int, test_least: int) -> DataFrame:
    """Why a series is skipped: no test rows, a last real observation too old, or too few windows."""
    last = F.max(F.when(real & (F.col(slot) < boundary), F.col(slot)))
    agg = rows.groupBy(key).agg(last.alias("last_real"), F.count_if(F.col(slot) < boundary).alias("n_train"), F.count_if(F.col(slot) >= boundary).alias("n_test"))
    gate = F.when(F.col("n_test") == 0, "no_test_rows").when(F.col("last_real").isNull() | (boundary - F.col("last_real") > most), "stale_baseline").when((F.col("n_train") < train_least) | (F.col("n_test") < test_least), "too_few_windows").otherwise("scored")
    return agg.withColumn("gate", gate)


def prediction_frame(points: DataFrame, keys: Sequence[str], slot: str, value: str, score: str, *, own: int = 3) -> DataFrame:
    """Coverage of the last ``own`` slots and the status; the score is null unless available."""
    w = Window.partitionBy(*keys).orderBy(slot).rowsBetween(-(own - 1), 0)
    n = F.count(value).over(w)
    seen = F.count("*").over(w)
    status = F.when(seen < own, "insufficient_history").when(n == own, "observed").when(n > 0, "interpolated").otherwise("missing_data")
    out = points.select("*", (n / F.lit(own)).alias("coverage_ratio"), status.alias("data_status"))
    return out.withColumn("available", F.col("data_status").isin("observed", "interpolated")).withColumn(score, F.when(F.col("available"), F.col(score)))


def reservoir(rows: DataFrame, key: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each key by a seeded hash of the id: a uniform sample that reruns repeat."""
    w = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def anomalous_days(days: DataFrame, points: DataFrame, keys: Sequence[str], day: str, slot: str, *, gap: int) -> DataFrame:
    """Flagged days with the runs of flagged points inside them; a flagged day without points keeps one row."""
    runs = islands.islands(points, [*keys, day], slot, gap=gap).groupBy(*keys, day, "island").agg(F.min(slot).alias("start"), (F.max(slot) + 1).alias("end"), F.max("score").alias("max_score"), F.count("*").alias("n_points"))
    return days.join(runs.drop("island"), [*keys, day], "left")


def day_rollup(days: DataFrame, points: DataFrame, keys: Sequence[str], day: str, slot: str) -> DataFrame:
    """Flagged days with first, last, largest and mean of their flagged points."""
    agg = points.groupBy(*keys, day).agg(F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.count("*").alias("n_points"))
    return days.join(agg, [*keys, day], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def day_profile_scores(history: DataFrame, target: DataFrame, series: str, day: str, slot: str, value: str, widths: Sequence[int], per_day: int) -> DataFrame:
    """Scales of one detector run: each target slot's percentile (0..100) of its window distances among leave-one-day-out ones."""
    out = None
    for width in widths:
        ref = profile.windows(history, [series, day], slot, value, width, per_day)
        query = profile.windows(target, [series, day], slot, value, width, per_day)
        base = profile.ab_join(ref, ref, series, day, width, leave_own_day_out=True).withColumn("is_ref", F.lit(True))
        got = profile.ab_join(query, ref, series, day, width).withColumn("is_ref", F.lit(False))
        ranked = calibrate.ecdf_mid(base.unionByName(got), [series], "distance", F.col("is_ref")).where("NOT is_ref")
        slots = ranked.select(series, day, F.explode(F.sequence(F.col("start"), F.col("start") + width - 1)).alias(slot), "percentile")
        part = slots.groupBy(series, day, slot).agg(F.max("percentile").alias(f"scale_{width}"))
        out = part if out is None else out.join(part, [series, day, slot], "full")
    return out


def preflight(channels: DataFrame, packages: DataFrame, supported: Sequence[int]) -> DataFrame:
    """ready, unsupported_category or unavailable for every channel."""
    met = channels.join(packages.select("category", F.lit(True).alias("has")), "category", "left")
    s = F.when(F.col("category").isNull() | ~F.col("category").isin(*supported), "unsupported_category").when(F.col("has").isNull(), "unavailable").otherwise("ready")
    return met.withColumn("status", s).drop("has")


def case_rows(cases: DataFrame, rows: DataFrame, key: str, slot: str, around: int) -> DataFrame:
    """Rows within ``around`` slots of each case: slots are generated from the cases and meet on equality."""
    spans = cases.withColumn(slot, F.explode(F.sequence(F.col("at") - around, F.col("at") + around)))
    return spans.join(rows, [key, slot]).withColumn("offset", F.col(slot) - F.col("at"))


def candidates(scores: DataFrame, keys: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    """Per slot: available and flagged models, priority as the sum of percentiles, and a hash to break ties."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("model")))), "|")
    agg = scores.groupBy(*keys).agg(names(F.col("available")).alias("available_models"), names(F.col("available") & F.col("is_anomaly")).alias("flagged_models"), F.sum(F.coalesce("max_percentile", F.lit(0.0))).alias("priority"))
    return agg.withColumn("tie", F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols]), 256), 1, 16))


def queue_export(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by queue, one row a priority segment) of events with a queue and JSON segments."""
    cores = events.select("event_id", "queue", F.explode(F.from_json("segments", "array<struct<start:long,end:long>>")).alias("s")).select("event_id", "queue", "s.start", "s.end")
    return events.groupBy("queue").agg(F.count("*").alias("n_events")), cores


def compose_events(quality: DataFrame, behaviour: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Quality events, and behaviour events that no quality event overlaps."""
    spans = quality.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    free = joins.without_overlap(behaviour, spans, keys, width, "event_id")
    return quality.withColumn("kind", F.lit("quality")).unionByName(free.withColumn("kind", F.lit("behaviour")), allowMissingColumns=True)


def replay(original: DataFrame, edits: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Known edits put in place, nothing else changed."""
    e = edits.select(*keys, F.col(value).alias("__edit"), F.lit(True).alias("is_injected"))
    return original.join(e, list(keys), "left").withColumn(value, F.when(F.col("is_injected"), F.col("__edit")).otherwise(F.col(value))).withColumn("is_injected", F.coalesce("is_injected", F.lit(False))).drop("__edit")


def magnitude_events(rows: DataFrame, keys: Sequence[str], slot: str, mode: str, legacy: DataFrame, width: int, *, least: int = 3) -> DataFrame:
    """Magnitude runs that their own evidence admits and that earlier events don't cover in full.

    ``rows`` is the whole grid with value, lower, upper, effect, jump, jump_in, support, percentile and
    quality, and optionally current_beyond, shape and change (absent: no such evidence).  Only jumps and
    change points near a run's start admit it.
    """
    if mode not in ("envelope_confirmed", "transition_guarded"):
        raise ValueError(f"unknown mode: {mode}")
    absent = {c: F.lit(False) for c in ("current_beyond", "shape", "change", "jumped") if c not in rows.columns}
    near = detect.near_start(rows.withColumns(absent), keys, slot)
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    more = [F.min_by(truth("jump_near"), slot).alias("jump_near"), F.min_by(truth("change_near"), slot).alias("change_near"), F.max(truth("shape")).alias("shape_near"), F.avg(truth("current_beyond").cast("double")).alias("current_share")]
    runs = detect.magnitude_runs(near, keys, slot, least=least, more=more)
    ok = detect.magnitude_confirmed(mode, current_share=F.col("current_share"), jumped=F.col("jump_near"), change=F.col("change_near"), shape=F.col("shape_near"), peak=F.col("peak"), effect=F.col("effect"))
    slots = runs.select(*keys, F.col("start").alias("__start"), F.explode(F.sequence("start", F.col("end") - 1)).alias(slot))
    spans = legacy.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias(slot)).distinct()
    fresh = slots.join(spans, [*keys, slot], "left_anti").select(*keys, F.col("__start").alias("start")).distinct()
    return runs.where(ok).join(fresh, [*keys, "start"], "left_semi")
