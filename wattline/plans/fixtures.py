"""Frames that queries share, and the same in SQL.

``events`` serves as meter readings: the event type is the channel, the hour is
the slot, and value statistics of an hour are the measurements.  Baseline is
2024-01-01 to 2024-01-20, the test period the last ten days of January's thirty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators import calibrate
from wattline.operators.timegrid import complete, slot_of

FIRST, PER_DAY = 473352, 24
TRAIN_END, LAST = FIRST + 20 * PER_DAY, FIRST + 30 * PER_DAY
MODELS = ("lof", "mp", "rpca")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), slot_of(F.col("ts"), 60).alias("slot"), "value")
    return ev.groupBy("series_id", "slot").agg(F.avg("value").alias("p"), F.max("value").alias("imax"), F.min("value").alias("imin"), F.count("*").alias("n"))


def full(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly grid with nulls for empty hours, and day and hour."""
    return with_day(complete(hourly(spark, sf), "series_id", FIRST, LAST))


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.floor(F.col("slot") / PER_DAY).cast("long")).withColumn("h", F.pmod("slot", F.lit(PER_DAY)).cast("long"))


def scores(spark: SparkSession, sf: str, q: float = 0.95) -> DataFrame:
    """Three models' canonical rows: a measurement as raw score, calibrated on the baseline."""
    h = hourly(spark, sf)
    long = h.select("series_id", "slot", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("raw_score")) for m, c in (("lof", "imax"), ("mp", "imin"), ("rpca", "p"))])).alias("s")).select("s.model", "series_id", "slot", "s.raw_score")
    long = calibrate.ecdf(long, ["model", "series_id"], "raw_score", F.col("slot") < TRAIN_END, "max_percentile")
    long = calibrate.with_threshold(long, ["model", "series_id"], "raw_score", F.col("slot") < TRAIN_END, q)
    return long.withColumn("is_anomaly", F.col("raw_score") > F.col("threshold")).withColumn("available", F.lit(True))


H = f"""h AS (SELECT event_type AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, avg(value) AS p, max(value) AS imax, min(value) AS imin, count(*) AS n FROM events GROUP BY 1, 2)"""
FULL = f"""{H}, g AS (SELECT series_id, CAST(s.slot AS BIGINT) AS slot FROM (SELECT DISTINCT event_type AS series_id FROM events), range({FIRST}, {LAST}) s(slot)),
f AS (SELECT g.series_id, g.slot, p, imax, imin, n, g.slot // {PER_DAY} AS day, g.slot % {PER_DAY} AS h FROM g LEFT JOIN h USING (series_id, slot))"""
SCORES = f"""{H}, u AS (SELECT 'lof' AS model, series_id, slot, imax AS raw_score FROM h UNION ALL SELECT 'mp', series_id, slot, imin FROM h UNION ALL SELECT 'rpca', series_id, slot, p FROM h),
e AS (SELECT *, CAST(sum(CASE WHEN slot < {TRAIN_END} THEN 1 ELSE 0 END) OVER (PARTITION BY model, series_id ORDER BY raw_score RANGE UNBOUNDED PRECEDING) AS DOUBLE) / sum(CASE WHEN slot < {TRAIN_END} THEN 1 ELSE 0 END) OVER (PARTITION BY model, series_id) AS max_percentile FROM u),
t AS (SELECT model, series_id, quantile_cont(raw_score, 0.95) AS threshold FROM u WHERE slot < {TRAIN_END} GROUP BY 1, 2),
sc AS (SELECT e.*, threshold, raw_score > threshold AS is_anomaly, TRUE AS available FROM e JOIN t USING (model, series_id))"""
#: Runs of flagged hours per model and series.
EVENTS = f"""{SCORES}, fl AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY model, series_id ORDER BY slot) <= 1 THEN 0 ELSE 1 END AS nw FROM sc WHERE is_anomaly),
il AS (SELECT *, sum(nw) OVER (PARTITION BY model, series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM fl),
ev AS (SELECT model, series_id, island, min(slot) AS start, max(slot) + 1 AS "end", max(raw_score) AS top, avg(raw_score) AS mean, count(*) AS n FROM il GROUP BY 1, 2, 3)"""
