"""The canonical score contract and its queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.scalars import parse_bool
from wattline.operators.islands import islands

SCORES = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("interval_start", T.TimestampType()),
        T.StructField("interval_end", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("raw_score", "max_score", "mean_score", "score_std", "max_percentile", "mean_percentile", "threshold")],
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("coverage_ratio", T.DoubleType()),
        T.StructField("source_resolution_minutes", T.IntegerType()),
        T.StructField("aggregation_method", T.StringType()),
        T.StructField("data_status", T.StringType()),
        T.StructField("calibration_version", T.StringType()),
        T.StructField("available", T.BooleanType()),
    ]
)
#: The measures of a model in the wide table.
METRICS = ("max_percentile", "mean_percentile", "max_score", "mean_score", "available", "source_resolution_minutes", "data_status", "aggregation_method")
#: Models whose rows must say that they were resampled, with the status and the minutes they must name.
DISCLOSED = {"matrix_profile": ("upsampled_from_30m", 30)}
#: How far a percentile may lie outside of 0..1 before it is clipped.
TOLERANCE = 1e-9


def missing_columns(df: DataFrame) -> list[str]:
    return [f.name for f in SCORES if f.name not in df.columns]


def validate(scores: DataFrame, models: Sequence[str], minutes: int = 15, disclosed: Mapping[str, tuple[str, int]] = DISCLOSED) -> DataFrame:
    """One row of violation counts: zero everywhere means the scores honour the contract.  Nulls violate what needs a value."""
    start, end = F.unix_seconds("interval_start"), F.unix_seconds("interval_end")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    unless = lambda c: ~F.coalesce(c, F.lit(False))
    where = lambda c: F.coalesce(c, F.lit(False))
    off = lambda c: where((F.col(c) < -TOLERANCE) | (F.col(c) > 1 + TOLERANCE) | F.isnan(c))
    undisclosed = F.lit(False)
    for model, (status, resolution) in disclosed.items():
        undisclosed = undisclosed | (where(F.col("model") == model) & unless((F.col("data_status") == status) & (F.col("source_resolution_minutes") == resolution)))
    per = scores.groupBy("model", "series_id", "interval_start").agg(F.count("*").alias("n"))
    checks = scores.agg(
        count(unless(F.col("model").isin(*models)), "unknown_model"),
        count(F.col("series_id").isNull(), "missing_series"),
        count(F.col("interval_start").isNull() | F.col("interval_end").isNull(), "unreadable_instant"),
        count(unless(~F.col("calibration_version").contains("not_frozen")), "not_frozen"),
        count(unless(end - start == 60 * minutes), "wrong_duration"),
        count(unless(F.pmod(start, F.lit(60 * minutes)) == 0), "off_grid"),
        count(off("max_percentile") | off("mean_percentile"), "percentile_out_of_range"),
        count(where(F.col("available")) & F.col("is_anomaly").isNull(), "unknown_flag"),
        count(undisclosed, "undisclosed_resampling"),
    )
    return checks.crossJoin(per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores as later steps take them: percentiles clipped to 0..1, flags as truth values (unknown is false)."""
    percentiles = {c: F.when(F.col(c).isNotNull(), clipped(F.col(c))) for c in ("max_percentile", "mean_percentile")}
    return scores.withColumns(percentiles | {c: parse_bool(F.col(c)) for c in ("available", "is_anomaly")})


def clipped(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def wide(scores: DataFrame, grid: DataFrame, models: Sequence[str], metrics: Sequence[str] = METRICS, slot: str = "slot") -> DataFrame:
    """One row per series and slot, model_metric columns; availability is false where no score is."""
    pivoted = scores.groupBy("series_id", slot).pivot("model", list(models)).agg(*[F.first(m).alias(m) for m in metrics])
    out = grid.join(pivoted, ["series_id", slot], "left")
    return out.withColumns({f"{m}_available": F.coalesce(f"{m}_available", F.lit(False)) for m in models if "available" in metrics})


def events(scores: DataFrame, keys: Sequence[str], slot: str, *, gap: int, minutes: int) -> DataFrame:
    """Flagged slots joined into events; a gap over ``gap`` slots parts them."""
    runs = islands(scores.where("available AND is_anomaly"), keys, slot, gap=gap)
    agg = runs.groupBy(*keys, "island").agg(F.min(slot).alias("start_slot"), (F.max(slot) + 1).alias("end_slot"), F.max("raw_score").alias("max_raw_score"), F.avg("raw_score").alias("mean_raw_score"), F.max("max_percentile").alias("max_score_percentile"), F.count("*").alias("interval_count"))
    return agg.drop("island").withColumn("duration_minutes", (F.col("end_slot") - F.col("start_slot")) * minutes)


def run_summary(scores: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n_intervals"),
        F.sum(F.coalesce("available", F.lit(False)).cast("long")).alias("n_available"),
        F.sum(F.coalesce("is_anomaly", F.lit(False)).cast("long")).alias("n_anomaly"),
        F.min(slot).alias("first_slot"),
        F.max(slot).alias("last_slot"),
        F.array_join(F.sort_array(F.collect_set("data_status")), "|").alias("data_status"),
    )


def review_state(available: Column, priority: Column, quality: Column, change: Column, source: Column) -> Column:
    """unavailable > priority > data_quality > operating_change > noncore_context > no_source_event."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(available), "unavailable").when(yes(priority), "priority").when(yes(quality), "data_quality").when(yes(change), "operating_change").when(yes(source), "noncore_context").otherwise("no_source_event")


def readiness(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    names = scores.sparkSession.createDataFrame([(m,) for m in models], "model string")
    have = scores.groupBy("model").agg(F.count("*").alias("n_rows"), F.sum(F.col("available").cast("long")).alias("n_available"))
    return names.join(have, "model", "left").select("model", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_available") == 0, "unavailable").otherwise("ready").alias("state"))
