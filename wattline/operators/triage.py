"""Evidence of source events on points, and their lossless split into review queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.islands import islands

#: Queues and reasons as published, reasons in their order.
QUEUES = ("priority_alert", "operating_change_review", "data_quality")
REASONS = (
    "insufficient_observed_point_support",
    "no_sustained_historical_envelope_exceedance",
    "insufficient_peak_power_effect",
    "no_abrupt_onset_above_frozen_jump_guard",
    "no_multiscale_or_current_confirmation",
)
SAME_RUN = "guards_not_coincident_in_one_point_run"
CONFIRMED = "sustained_effect_abrupt_onset_and_confirmation"
QUALITY = "source_data_quality_event"
NO_REFERENCE = "missing_target_or_frozen_reference"
CORES = "array<struct<start:bigint,end:bigint,direction:string,peak:double,onset:double,current_share:double>>"


def event_evidence(events: DataFrame, points: DataFrame, keys: Sequence[str], slot: str, *, event: str = "event_id", support: int = 6, least: int = 3, effect: float = 2.0, joint: float = 99.0, share: float = 0.5, observed: float = 0.95) -> DataFrame:
    """One row an event: observed ratio, points outside, longest run, peak, direction, cores and reasons.

    ``events`` have start and end (slots, half open) and short and medium percentiles; ``points`` are the
    grid with value, lower, upper, median, effect, jump, support, excluded and current_beyond.  Each event
    meets only the points of its keys and slots.  A core is one run to one side of the envelope that is long
    enough, exceeds ``effect`` times the guard, begins with a jump from a supported point, and is confirmed.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    by_slot = Window.partitionBy(*keys).orderBy(slot)
    ok = F.col("value").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull() & (F.col("support") >= support) & ~yes(F.col("excluded"))
    p = points.withColumn("supported", yes(ok))
    excess = F.greatest(F.col("value") - F.col("upper"), F.col("lower") - F.col("value"))
    jump = F.when(F.col(slot) - F.lag(slot).over(by_slot) == 1, F.abs(F.col("value") - F.lag("value").over(by_slot)))
    p = p.withColumns({"excess": excess, "jump_in": jump, "before_supported": yes(F.lag("supported").over(by_slot))})
    own = events.select(event, *keys, "start", "end", yes((F.col("short") >= joint) & (F.col("medium") >= joint)).alias("multiscale"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(slot))
    met = own.join(p, [*keys, slot])
    sign = F.when(F.col("supported") & (F.col("excess") > F.col("effect")), F.when(F.col("value") > F.col("upper"), "up").otherwise("down"))
    met = met.withColumn("side", sign)
    runs = islands(met.where("side IS NOT NULL"), [event, "side"], slot, gap=1).groupBy(event, "side", "island").agg(
        F.min(slot).alias("first"),
        F.count("*").alias("n"),
        F.max("excess").alias("peak"),
        F.first("effect").alias("guard"),
        F.min_by(F.struct(F.col("jump_in").alias("size"), yes(F.col("before_supported") & (F.col("jump_in") > F.col("jump"))).alias("abrupt")), slot).alias("onset"),
        F.avg(yes(F.col("current_beyond")).cast("double")).alias("current"),
        F.first("multiscale").alias("multiscale"),
    )
    sustained, strong = F.col("n") >= least, F.col("peak") >= effect * F.col("guard")
    abrupt, confirmed = F.col("onset.abrupt"), F.col("multiscale") | (F.col("current") >= share)
    core = F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end"), F.col("side").alias("direction"), F.col("peak"), F.col("onset.size").alias("onset"), F.col("current").alias("current_share"))
    per_run = runs.groupBy(event).agg(
        F.max("n").alias("longest"),
        F.max(sustained & strong).alias("has_peak"),
        F.max(sustained & abrupt).alias("has_onset"),
        F.max(sustained & confirmed).alias("has_confirmation"),
        F.sort_array(F.collect_list(F.when(sustained & strong & abrupt & confirmed, core))).alias("found"),
    )
    median = F.median(F.when(F.col("supported"), F.col("value") - F.col("median")))
    per_point = met.groupBy(event).agg(F.avg(F.col("supported").cast("double")).alias("observed_ratio"), F.count("side").alias("n_outside"), F.max(F.when(F.col("side").isNotNull(), F.col("excess"))).alias("peak_outside"), median.alias("shift"))
    out = events.select(event).join(per_point, event, "left").join(per_run, event, "left")
    enough = yes(F.col("observed_ratio") >= observed)
    no_cores = F.array().cast(CORES)
    out = out.withColumn("cores", F.when(enough & F.col("found").isNotNull(), F.col("found").cast(CORES)).otherwise(no_cores)).withColumn("enough", enough)
    fails = [~F.col("enough"), ~yes(F.col("longest") >= least), ~yes(F.col("has_peak")), ~yes(F.col("has_onset")), ~yes(F.col("has_confirmation"))]
    reasons = F.array_compact(F.array(*[F.when(f, F.lit(name)) for f, name in zip(fails, REASONS, strict=True)]))
    has_core = F.size("cores") > 0
    reasons = F.when(has_core, F.array(F.lit(CONFIRMED))).when(F.size(reasons) == 0, F.array(F.lit(SAME_RUN))).otherwise(reasons)
    sides = F.array_distinct(F.transform("cores", lambda c: c["direction"]))
    drift = F.when(F.col("shift").isNull(), "unknown").when(F.col("shift") > 0, "up").when(F.col("shift") < 0, "down").otherwise("flat")
    direction = F.when(F.size(sides) == 1, F.element_at(sides, 1)).when(F.size(sides) > 1, F.lit("mixed")).otherwise(drift)
    return out.select(event, F.coalesce("observed_ratio", F.lit(0.0)).alias("observed_ratio"), F.coalesce("n_outside", F.lit(0)).alias("n_outside"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("peak_outside", F.lit(0.0)).alias("peak_outside"), direction.alias("direction"), "cores", reasons.alias("triage_reasons"), F.when(has_core, QUEUES[0]).otherwise(QUEUES[1]).alias("review_queue"))


def classify(events: DataFrame, points: DataFrame, keys: Sequence[str], slot: str, *, event: str = "event_id", kind: str = "event_type", has_reference: Column | None = None, **how) -> DataFrame:
    """Every source event once, with all its columns, its queue, reasons, direction and cores.

    Ids must be unique and known.  Data-quality events and events without a frozen reference are not measured.
    """
    if not events.where(F.col(event).isNull()).isEmpty() or not events.groupBy(event).count().where("count > 1").isEmpty():
        raise ValueError("event ids must be known and unique")
    able = F.coalesce(has_reference, F.lit(False)) if has_reference is not None else F.lit(True)
    quality = F.coalesce(F.col(kind) == "data_quality", F.lit(False))
    measured = event_evidence(events.where(~quality & able), points, keys, slot, event=event, **how).withColumn("__measured", F.lit(True))
    met = events.withColumn("__able", able).withColumn("__quality", quality).join(measured, event, "left")
    queue = F.when(F.col("__quality"), QUEUES[2]).when(F.col("__measured"), F.col("review_queue")).otherwise(QUEUES[1])
    reasons = F.when(F.col("__quality"), F.array(F.lit(QUALITY))).when(F.col("__measured"), F.col("triage_reasons")).otherwise(F.array(F.lit(NO_REFERENCE)))
    none = F.array().cast(CORES)
    return met.select(*events.columns, queue.alias("review_queue"), reasons.alias("triage_reasons"), F.coalesce("direction", F.lit("unknown")).alias("direction"), F.coalesce("cores", none).alias("cores"), F.coalesce(F.aggregate("cores", F.lit(0).cast("bigint"), lambda a, c: a + c["end"] - c["start"]), F.lit(0)).alias("core_slots"))


def lossless(events: DataFrame, classified: DataFrame, event: str = "event_id") -> bool:
    """Whether the classified events are the source events, each once and unchanged."""
    own = classified.select(*events.columns)
    return events.exceptAll(own).isEmpty() and own.exceptAll(events).isEmpty() and classified.where(~F.coalesce(F.col("review_queue").isin(*QUEUES), F.lit(False))).isEmpty()
