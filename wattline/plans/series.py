"""Queries on cleaning, grids, calibration and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.functions import scalars
from wattline.operators import calibrate, clean, detect, islands, timegrid
from wattline.plans.fixtures import FIRST, FULL, H, LAST, PER_DAY, SCORES, TRAIN_END, full, hourly, scores, table, with_day
from wattline.plans.registry import query, r6, rounded

_EV = "SELECT event_type AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, event_id, value FROM events"


def _readings(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("series_id"), timegrid.slot_of(F.col("ts"), 60).alias("slot"), "event_id", "value")


@query(f"SELECT series_id, slot, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM ({_EV}) GROUP BY 1, 2")
def dedupe_first(spark, sf):
    return clean.dedupe(_readings(spark, sf), ["series_id", "slot"], [F.col("event_id")], "first")


@query(f"SELECT series_id, slot, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM ({_EV}) GROUP BY 1, 2")
def dedupe_last(spark, sf):
    return clean.dedupe(_readings(spark, sf), ["series_id", "slot"], [F.col("event_id")], "last")


@query(f"SELECT series_id, slot, round(avg(value), 6) AS value, count(*) AS n FROM ({_EV}) GROUP BY 1, 2")
def dedupe_mean(spark, sf):
    return rounded(clean.dedupe(_readings(spark, sf), ["series_id", "slot"], [], "mean", "value"), "value")


@query("""WITH k AS (SELECT event_type AS series_id, ts, count(*) AS n, sum(CAST(value IS NULL AS INT)) AS bad FROM events GROUP BY 1, 2)
SELECT series_id, CAST(sum(bad) AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_infinite, CAST(sum(CASE WHEN epoch_us(ts) % 300000000 <> 0 THEN n ELSE 0 END) AS BIGINT) AS n_off_grid, CAST(sum(n - 1) AS BIGINT) AS n_duplicate FROM k GROUP BY 1""")
def strict_violations(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return clean.violations(ev, "series_id", "ts", "value", 5)


@query(f"WITH {FULL} SELECT series_id, slot, round(p, 6) AS p, p IS NOT NULL AS available, CASE WHEN p IS NULL THEN 'missing' ELSE 'observed' END AS availability_reason FROM f")
def grid_completion(spark, sf):
    f = full(spark, sf)
    return f.select("series_id", "slot", *r6("p"), F.col("p").isNotNull().alias("available"), F.when(F.col("p").isNull(), "missing").otherwise("observed").alias("availability_reason"))


_GAPS = f"""{FULL}, nb AS (SELECT *, last_value(CASE WHEN p IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS ps, last_value(p IGNORE NULLS) OVER a AS pv,
first_value(CASE WHEN p IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS ns, first_value(p IGNORE NULLS) OVER b AS nv FROM f
WINDOW a AS (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY series_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ln AS (SELECT *, pv + (nv - pv) * (slot - ps) / (ns - ps) AS line FROM nb)"""


@query(f"WITH {_GAPS} SELECT series_id, slot, round(coalesce(p, CASE WHEN ns - ps - 1 <= 1 THEN line END), 6) AS filled FROM ln")
def gap_fill_whole(spark, sf):
    return clean.fill(full(spark, sf), ["series_id"], "slot", "p", 1, "whole").select("series_id", "slot", *r6("filled"))


@query(f"WITH {_GAPS} SELECT series_id, slot, round(coalesce(p, CASE WHEN ns IS NOT NULL AND slot - ps <= 1 THEN line END), 6) AS filled FROM ln")
def gap_fill_inside(spark, sf):
    return clean.fill(full(spark, sf), ["series_id"], "slot", "p", 1, "inside").select("series_id", "slot", *r6("filled"))


@query(f"WITH {_GAPS} SELECT series_id, slot, round(coalesce(p, CASE WHEN slot - ps <= 1 OR ns - slot <= 1 THEN coalesce(line, pv, nv) END), 6) AS filled FROM ln")
def gap_fill_both(spark, sf):
    return clean.fill(full(spark, sf), ["series_id"], "slot", "p", 1, "both").select("series_id", "slot", *r6("filled"))


_LONG = f"{FULL}, b AS (SELECT *, sum(CAST(p IS NOT NULL AS INT)) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS k FROM f), r AS (SELECT *, count(*) OVER (PARTITION BY series_id, k) AS len FROM b WHERE p IS NULL), lg AS (SELECT DISTINCT series_id, slot // 6 AS bin FROM r WHERE len > 1)"


@query(f"WITH {_LONG} SELECT series_id, bin FROM lg")
def long_gap_bins(spark, sf):
    return clean.long_gap_bins(full(spark, sf), ["series_id"], "slot", "p", 1, 6)


@query(f"""WITH {_GAPS}, b AS (SELECT *, sum(CAST(p IS NOT NULL AS INT)) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS k FROM f), r AS (SELECT *, count(*) OVER (PARTITION BY series_id, k) AS len FROM b WHERE p IS NULL), lg AS (SELECT DISTINCT series_id, slot // 6 AS bin FROM r WHERE len > 1),
m AS (SELECT series_id, slot // 6 AS bin, avg(coalesce(p, CASE WHEN ns IS NOT NULL AND slot - ps <= 1 THEN line END)) AS mean FROM ln GROUP BY 1, 2)
SELECT m.series_id, m.bin, round(CASE WHEN lg.bin IS NULL THEN mean END, 6) AS mean, lg.bin IS NOT NULL AS blocked FROM m LEFT JOIN lg USING (series_id, bin)""")
def resample_bins(spark, sf):
    return rounded(clean.resample(full(spark, sf), ["series_id"], "slot", "p", 6, 1), "mean")


@query(f"WITH {FULL} SELECT series_id, day, count(p) AS n_known, count(p) >= 18 AS valid FROM f GROUP BY 1, 2")
def valid_days(spark, sf):
    return timegrid.valid_days(full(spark, sf), ["series_id"], "day", "p", PER_DAY, 0.75)


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
SELECT CAST(d AS VARCHAR) AS day, round(sin(2 * pi() * dayofyear(d) / 365.25), 6) AS sin_doy, round(cos(2 * pi() * dayofyear(d) / 365.25), 6) AS cos_doy, round(sin(2 * pi() * (isodow(d) - 1) / 7), 6) AS sin_dow, round(cos(2 * pi() * (isodow(d) - 1) / 7), 6) AS cos_dow FROM d""")
def calendar_features(spark, sf):
    d = table(spark, sf, "events").select(F.col("ts").cast("date").alias("d")).distinct()
    return rounded(d.select(F.col("d").cast("string").alias("day"), *scalars.calendar(F.col("d"))), "sin_doy", "cos_doy", "sin_dow", "cos_dow")


@query(f"WITH {H} SELECT series_id, CASE WHEN slot < {TRAIN_END - 48} THEN 'baseline' WHEN slot < {TRAIN_END} THEN 'context' WHEN slot < {LAST} THEN 'test' ELSE 'outside' END AS role, count(*) AS n FROM h GROUP BY 1, 2")
def role_counts(spark, sf):
    role = timegrid.role(F.col("slot"), baseline=FIRST, train_end=TRAIN_END - 48, test_start=TRAIN_END, test_end=LAST)
    return hourly(spark, sf).groupBy("series_id", role.alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {H} SELECT series_id, slot * 4 + k AS slot, slot AS source_slot, CAST(k AS INT) AS part, round(p, 6) AS p FROM h, range(4) t(k)")
def upsample_quarter(spark, sf):
    return timegrid.upsample(hourly(spark, sf).select("series_id", "slot", "p"), "slot", 4).select("series_id", "slot", "source_slot", "part", *r6("p"))


@query("""SELECT event_type AS meter_channel, count(*) AS n_rows, count(DISTINCT CAST(ts AS DATE)) AS n_days_present, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 - count(DISTINCT CAST(ts AS DATE)) AS n_days_missing, CAST(0 AS BIGINT) AS n_bad_timestamp_rows_dropped FROM events GROUP BY 1""")
def manifest(spark, sf):
    d = F.col("ts").cast("date")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("meter_channel")).agg(F.count("*").alias("n_rows"), F.countDistinct(d).alias("n_days_present"), (F.datediff(F.max(d), F.min(d)) + 1 - F.countDistinct(d)).cast("long").alias("n_days_missing"), F.sum(F.col("ts").isNull().cast("long")).alias("n_bad_timestamp_rows_dropped"))


@query(f"WITH {H}, k AS (SELECT series_id, slot, row_number() OVER (PARTITION BY series_id ORDER BY slot) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM h) SELECT series_id, slot, CASE WHEN k > n - round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM k")
def chronological_split(spark, sf):
    return timegrid.chronological_split(hourly(spark, sf).select("series_id", "slot"), "series_id", "slot", 0.2)


@query(f"WITH {H}, k AS (SELECT series_id, slot, row_number() OVER (PARTITION BY series_id ORDER BY slot) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM h) SELECT series_id, slot, CASE WHEN k < floor(n * 0.6) THEN 'train' WHEN k < floor(n * 0.6) + floor(n * 0.15) THEN 'validation' WHEN k < floor(n * 0.6) + floor(n * 0.15) + floor(n * 0.1) THEN 'calibration' ELSE 'test' END AS part FROM k")
def four_way_split(spark, sf):
    return timegrid.four_way(hourly(spark, sf).select("series_id", "slot"), "series_id", "slot", (0.6, 0.15, 0.1))


def _means_in_file_order(spark, sf):
    """Known hourly means on the grid, each summed in the order of the files' rows.

    The tensor is text, so its last digit shows how a mean was added up; partial sums depend on how files are split.
    """
    key = ["series_id", "slot"]
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), timegrid.slot_of(F.col("ts"), 60).alias("slot"), "value", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    ev = ev.where((F.col("slot") >= FIRST) & (F.col("slot") < LAST) & F.col("series_id").isNotNull() & F.col("value").isNotNull())
    w = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ev.select(*key, F.struct(F.count("value").over(w).alias("n"), F.sum("value").over(w).alias("total")).alias("s"))
    return sums.groupBy(*key).agg(F.max("s").alias("s")).select(*key, (F.col("s.total") / F.col("s.n")).alias("p"))


@query(f"WITH {FULL}, d AS (SELECT series_id, day FROM f GROUP BY 1, 2 HAVING count(p) = 24) SELECT series_id, day, list(round(p, 6) ORDER BY h)::VARCHAR AS tensor FROM f JOIN d USING (series_id, day) GROUP BY 1, 2")
def day_tensor(spark, sf):
    f = with_day(_means_in_file_order(spark, sf))
    rows = f.groupBy("series_id", "day").agg(F.sort_array(F.collect_list(F.struct("h", scalars.binary_round(F.col("p"), 6).alias("p")))).alias("a"), F.count("*").alias("n")).where(F.col("n") == PER_DAY)
    return rows.select("series_id", "day", scalars.number_list(F.col("a.p")).alias("tensor"))


@query(f"WITH {H} SELECT series_id, slot, round(CASE WHEN imax - imin < 5 AND slot < {TRAIN_END} THEN NULL ELSE p END, 6) AS p FROM h")
def mask_history(spark, sf):
    frozen = (F.col("imax") - F.col("imin") < 5) & (F.col("slot") < TRAIN_END)
    return hourly(spark, sf).select("series_id", "slot", F.round(F.when(~frozen, F.col("p")), 6).alias("p"))


@query(f"WITH {H} SELECT series_id, slot, round(CASE WHEN slot % 24 = 12 THEN p * 4 WHEN slot % 24 BETWEEN 14 AND 19 THEN p * 2 ELSE p END, 6) AS p, slot % 24 = 12 OR slot % 24 BETWEEN 14 AND 19 AS is_injected FROM h WHERE slot >= {TRAIN_END}")
def controlled_probe(spark, sf):
    h = F.pmod("slot", F.lit(24))
    p = F.when(h == 12, F.col("p") * 4).when(h.between(14, 19), F.col("p") * 2).otherwise(F.col("p"))
    return hourly(spark, sf).where(F.col("slot") >= TRAIN_END).select("series_id", "slot", F.round(p, 6).alias("p"), ((h == 12) | h.between(14, 19)).alias("is_injected"))


@query(f"WITH {FULL} SELECT series_id, slot // 6 AS bin, coalesce(bool_or(imax - imin < 5), FALSE) AS frozen FROM f GROUP BY 1, 2")
def freeze_overlap(spark, sf):
    return full(spark, sf).groupBy("series_id", F.floor(F.col("slot") / 6).cast("long").alias("bin")).agg(F.coalesce(F.bool_or(F.col("imax") - F.col("imin") < 5), F.lit(False)).alias("frozen"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS category, count(*) AS n_channels, CASE WHEN count(*) >= 55 THEN 'train' ELSE 'skipped' END AS plan FROM customer GROUP BY 1")
def category_plan(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("category")).agg(F.count("*").alias("n_channels")).withColumn("plan", F.when(F.col("n_channels") >= 55, "train").otherwise("skipped"))


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 4 AS shard FROM supplier WHERE s_acctbal > 0")
def shard_positions(spark, sf):
    ranked = timegrid.global_positions(table(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey"), "s_suppkey")
    return ranked.select("s_suppkey", F.pmod("position", F.lit(4)).cast("long").alias("shard"))


# calibration ---------------------------------------------------------------


@query(f"WITH {SCORES} SELECT model, series_id, slot, round(max_percentile, 6) AS max_percentile, is_anomaly FROM sc")
def ecdf_right(spark, sf):
    return scores(spark, sf).select("model", "series_id", "slot", *r6("max_percentile"), "is_anomaly")


@query(f"WITH {H}, q AS (SELECT series_id, slot, round(p, 0) AS v FROM h) SELECT a.series_id, a.slot, round((sum(CASE WHEN b.v < a.v THEN 1.0 ELSE 0 END) + 0.5 * sum(CASE WHEN b.v = a.v THEN 1.0 ELSE 0 END)) / count(*) * 100, 6) AS percentile FROM q a JOIN q b ON a.series_id = b.series_id AND b.slot < {TRAIN_END} GROUP BY 1, 2")
def ecdf_mid(spark, sf):
    rows = hourly(spark, sf).select("series_id", "slot", F.round("p", 0).alias("v"))
    return calibrate.ecdf_mid(rows, ["series_id"], "v", F.col("slot") < TRAIN_END).select("series_id", "slot", *r6("percentile"))


@query(f"""WITH {FULL}, hist AS (SELECT *, abs(p - median(p) OVER (PARTITION BY series_id, h)) AS d, median(p) OVER (PARTITION BY series_id, h) AS m FROM f WHERE slot < {TRAIN_END} AND p IS NOT NULL),
mm AS (SELECT DISTINCT series_id, h, m FROM hist), tg AS (SELECT f.series_id, f.slot, f.h, abs(p - m) AS x FROM f JOIN mm USING (series_id, h) WHERE slot >= {TRAIN_END} AND p IS NOT NULL)
SELECT tg.series_id, tg.slot, round((sum(CASE WHEN d < x AND abs(d - x) > 1e-12 + 1e-9 * abs(d) THEN 1.0 ELSE 0 END) + 0.5 * sum(CASE WHEN abs(d - x) <= 1e-12 + 1e-9 * abs(d) THEN 1.0 ELSE 0 END)) / count(*) * 100, 6) AS percentile FROM tg JOIN hist USING (series_id, h) GROUP BY 1, 2""")
def ecdf_same_slot(spark, sf):
    f = full(spark, sf)
    got = calibrate.same_slot(f.where(F.col("slot") < TRAIN_END), f.where((F.col("slot") >= TRAIN_END) & F.col("p").isNotNull()), ["series_id"], "h", "p")
    return got.where("percentile IS NOT NULL").select("series_id", "slot", *r6("percentile"))


@query(f"WITH {H} SELECT series_id, round(quantile_cont(p, 0.99), 6) AS q99, round(quantile_cont(p, 0.995), 6) AS q995 FROM h WHERE slot < {TRAIN_END} GROUP BY 1")
def quantile_thresholds(spark, sf):
    return hourly(spark, sf).where(F.col("slot") < TRAIN_END).groupBy("series_id").agg(F.round(F.percentile("p", F.lit(0.99)), 6).alias("q99"), F.round(F.percentile("p", F.lit(0.995)), 6).alias("q995"))


@query(f"WITH {H}, m AS (SELECT *, median(p) OVER (PARTITION BY series_id) AS m FROM h) SELECT series_id, round(first(m), 6) AS median, round(quantile_cont(abs(p), 0.95), 6) AS p95, round(median(abs(p - m)), 6) AS mad FROM m GROUP BY 1")
def median_mad(spark, sf):
    return rounded(calibrate.mad(hourly(spark, sf), ["series_id"], "p"), "median", "p95", "mad")


@query(f"WITH {H} SELECT series_id, round(median(p), 6) AS center, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 6) AS scale, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std FROM h GROUP BY 1")
def scaler(spark, sf):
    return rounded(calibrate.scales(hourly(spark, sf), ["series_id"], "p"), "center", "scale", "mean", "std")


_ENV = f"en AS (SELECT series_id, a.h AS h, quantile_cont(p, 0.05) AS lower, quantile_cont(p, 0.95) AS upper, median(p) AS median, count(DISTINCT day) AS support FROM f JOIN (SELECT CAST(x AS BIGINT) AS h FROM range(24) t(x)) a ON abs(f.h - a.h) <= 2 WHERE slot < {TRAIN_END} AND p IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {FULL}, {_ENV} SELECT series_id, h, round(lower, 6) AS lower, round(upper, 6) AS upper, round(median, 6) AS median, support FROM en")
def envelope_reference(spark, sf):
    f = full(spark, sf).where(F.col("slot") < TRAIN_END)
    return rounded(calibrate.envelope(f, ["series_id"], "h", "day", "p", reach=2, per_day=PER_DAY, q=0.05), "lower", "upper", "median")


_MAG = f"""st AS (SELECT *, CASE WHEN h > 0 THEN abs(p - lag(p) OVER (PARTITION BY series_id, day ORDER BY slot)) END AS step FROM f WHERE slot < {TRAIN_END}),
mg AS (SELECT series_id, greatest(0.5, 0.05 * quantile_cont(abs(p), 0.95)) AS effect, greatest(greatest(0.5, 0.05 * quantile_cont(abs(p), 0.95)), quantile_cont(step, 0.995)) AS jump FROM st GROUP BY 1)"""


@query(f"WITH {FULL}, {_MAG} SELECT series_id, round(effect, 6) AS effect, round(jump, 6) AS jump FROM mg")
def magnitude_reference(spark, sf):
    f = full(spark, sf).where(F.col("slot") < TRAIN_END)
    return rounded(calibrate.magnitude_scalars(f, ["series_id"], "day", "slot", "p", least=0.5, relative=0.05, q=0.995), "effect", "jump")


@query(f"WITH {FULL}, q AS (SELECT series_id, quantile_cont(abs(p), 0.95) AS q FROM f WHERE slot < {TRAIN_END} GROUP BY 1) SELECT f.series_id, h, median(abs(p)) > greatest(0.05, 0.05 * first(q)) AS active FROM f JOIN q USING (series_id) WHERE slot < {TRAIN_END} GROUP BY 1, 2")
def solar_mask(spark, sf):
    return calibrate.active_slots(full(spark, sf).where(F.col("slot") < TRAIN_END), ["series_id"], "h", "p")


@query("""WITH x AS (SELECT user_id AS series_id, value FROM events), b AS (SELECT series_id, quantile_cont(abs(value), 0.95) AS p95, count(DISTINCT value) AS kinds, median(value) AS m FROM x GROUP BY 1),
d AS (SELECT series_id, median(abs(value - m)) AS mad FROM x JOIN b USING (series_id) GROUP BY 1)
SELECT series_id, round(p95, 6) AS p95, round(mad, 6) AS mad, CASE WHEN p95 < 120 THEN 'low_activity' WHEN kinds <= 1 OR mad < 25 THEN 'constant_signal' ELSE 'ready' END AS status FROM b JOIN d USING (series_id)""")
def admission_status(spark, sf):
    x = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "value")
    return rounded(calibrate.admission(x, ["series_id"], "value", low=120, flat=25), "p95", "mad")


@query(f"WITH {H} SELECT series_id, round(median(p) FILTER (WHERE slot < {TRAIN_END}), 6) AS base_median, round(median(p) FILTER (WHERE slot >= {TRAIN_END}), 6) AS test_median, round(quantile_cont(p, 0.95) FILTER (WHERE slot < {TRAIN_END}), 6) AS base_p95, round(quantile_cont(p, 0.95) FILTER (WHERE slot >= {TRAIN_END}), 6) AS test_p95, round(median(p) FILTER (WHERE slot >= {TRAIN_END}) - median(p) FILTER (WHERE slot < {TRAIN_END}), 6) AS shift FROM h GROUP BY 1")
def drift(spark, sf):
    base, test = F.when(F.col("slot") < TRAIN_END, F.col("p")), F.when(F.col("slot") >= TRAIN_END, F.col("p"))
    agg = hourly(spark, sf).groupBy("series_id").agg(F.median(base).alias("base_median"), F.median(test).alias("test_median"), F.percentile(base, F.lit(0.95)).alias("base_p95"), F.percentile(test, F.lit(0.95)).alias("test_p95"))
    return rounded(agg.withColumn("shift", F.col("test_median") - F.col("base_median")), "base_median", "test_median", "base_p95", "test_p95", "shift")


# windows -------------------------------------------------------------------


def _island_sql(cond: str, flag: str = "imax > 150") -> str:
    return f"""WITH {H}, fl AS (SELECT *, CASE WHEN {cond} THEN 0 ELSE 1 END AS nw FROM (SELECT *, slot - lag(slot) OVER (PARTITION BY series_id ORDER BY slot) AS step FROM h WHERE {flag})),
il AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM fl)
SELECT series_id, CAST(island AS BIGINT) AS island, min(slot) AS start_slot, max(slot) + 1 AS end_slot, count(*) AS n, round(max(imax), 6) AS top FROM il GROUP BY 1, 2"""


def _island_rows(spark, sf, **how):
    runs = islands.islands(hourly(spark, sf).where("imax > 150"), ["series_id"], "slot", **how)
    return runs.groupBy("series_id", F.col("island").cast("long").alias("island")).agg(F.min("slot").alias("start_slot"), (F.max("slot") + 1).alias("end_slot"), F.count("*").alias("n"), F.round(F.max("imax"), 6).alias("top"))


@query(_island_sql("step <= 2"))
def islands_gap(spark, sf):
    return _island_rows(spark, sf, gap=2)


@query(_island_sql("step = 1"))
def islands_exact_step(spark, sf):
    return _island_rows(spark, sf, gap=1, exact=True)


@query(_island_sql("step <= 1").replace("FROM il GROUP BY 1, 2", "FROM il GROUP BY 1, 2 HAVING count(*) >= 2"))
def islands_min_length(spark, sf):
    return _island_rows(spark, sf, gap=1).where("n >= 2")


@query(f"""WITH {H}, fl AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS nw FROM events),
il AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM fl) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n, round(sum(value), 4) AS total FROM il GROUP BY user_id, island""")
def session_events(spark, sf):
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ev.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select("user_id", F.unix_seconds(F.col("w.start")).alias("started"), "n", "total")


@query(f"""WITH {H}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY slot) AS k FROM h), fl AS (SELECT *, k - row_number() OVER (PARTITION BY series_id ORDER BY slot) AS island FROM k WHERE imax > 120)
SELECT series_id, min(slot) AS start_slot, count(*) AS n_steps, round(max(imax), 6) AS top, CASE WHEN max(imax) > 1.5 * 120 THEN 'severe' ELSE 'mild' END AS severity FROM fl GROUP BY series_id, island HAVING count(*) >= 2""")
def sample_periods(spark, sf):
    runs = islands.flagged_runs(hourly(spark, sf), ["series_id"], "slot", F.col("imax") > 120)
    agg = runs.groupBy("series_id", "island").agg(F.min("slot").alias("start_slot"), F.count("*").alias("n_steps"), F.round(F.max("imax"), 6).alias("top")).where("n_steps >= 2").drop("island")
    return agg.withColumn("severity", F.when(F.col("top") > 180, "severe").otherwise("mild"))


_FLAT = f"""WITH {FULL}, v AS (SELECT *, round(p / 40) AS v FROM f WHERE p IS NOT NULL), nw AS (SELECT *, CASE WHEN slot - lag(slot) OVER w = 1 AND abs(v - lag(v) OVER w) <= 0.001 THEN 0 ELSE 1 END AS nw FROM v WINDOW w AS (PARTITION BY series_id ORDER BY slot)),
il AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM nw),
fr AS (SELECT series_id, min(slot) AS start, max(slot) + 1 AS "end", count(*) AS n, max(v) - min(v) AS spread, avg(v) AS level FROM il GROUP BY series_id, island HAVING count(*) >= 4)"""


@query(_FLAT + ' SELECT series_id, start, "end", n, round(spread, 6) AS spread, round(level, 6) AS level FROM fr')
def flatline_runs(spark, sf):
    f = full(spark, sf).withColumn("v", F.round(F.col("p") / 40))
    return rounded(detect.flatlines(f, ["series_id"], "slot", "v", least=4), "spread", "level")


@query(f"""WITH {FULL}, v AS (SELECT series_id, slot, round(p / 60) AS a, round(imax / 150) AS b FROM f WHERE p IS NOT NULL), nw AS (SELECT *, CASE WHEN slot - lag(slot) OVER w = 1 AND a = lag(a) OVER w AND b = lag(b) OVER w THEN 0 ELSE 1 END AS nw FROM v WINDOW w AS (PARTITION BY series_id ORDER BY slot)),
il AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM nw)
SELECT series_id, min(slot) AS start, max(slot) + 1 AS "end", count(*) AS n FROM il GROUP BY series_id, island HAVING count(*) >= 3 AND min(abs(a)) > 0.05""")
def freeze_runs(spark, sf):
    f = full(spark, sf).withColumn("a", F.round(F.col("p") / 60)).withColumn("b", F.round(F.col("imax") / 150))
    return detect.freezes(f, ["series_id"], "slot", ["a", "b"], "a", least=3)


@query(f"""WITH {SCORES}, e2 AS (SELECT * FROM sc WHERE max_percentile >= 0.9), fl AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY model, series_id ORDER BY slot) <= 1 THEN 0 ELSE 1 END AS nw FROM e2),
il AS (SELECT *, sum(nw) OVER (PARTITION BY model, series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM fl)
SELECT model, series_id, min(slot) AS first_slot, max(slot) AS last_slot, round(max(max_percentile), 6) AS best FROM il GROUP BY model, series_id, island HAVING max(max_percentile) >= 0.98""")
def boundary_refinement(spark, sf):
    got = islands.refine(scores(spark, sf), ["model", "series_id"], "slot", "max_percentile", core=0.98, edge=0.9)
    return rounded(got.drop("island"), "best")


_IV = "iv AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS start, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + 20 + o_orderkey % 60 AS \"end\" FROM orders)"


def _intervals(spark, sf):
    d = F.floor(timegrid.epoch(F.col("o_orderdate")) / 86400).cast("long")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), d.alias("start"), (d + 20 + F.col("o_orderkey") % 60).alias("end"))


@query(f"""WITH {_IV}, m AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), u AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS unit FROM m)
SELECT k, min(start) AS start, max("end") AS "end", count(*) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) AS ids FROM u GROUP BY k, unit""")
def interval_merge(spark, sf):
    got = islands.merge_intervals(_intervals(spark, sf), ["k"], "start", "end", gap=5)
    return got.groupBy("k", "unit").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), "|").alias("ids")).drop("unit")


@query(f"WITH {FULL} SELECT series_id, slot, round(max(p) OVER (PARTITION BY series_id ORDER BY slot RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS projected FROM f")
def window_projection(spark, sf):
    return islands.project(full(spark, sf), ["series_id"], "slot", "p", 4).select("series_id", "slot", *r6("projected"))


@query(f"WITH {FULL} SELECT series_id, slot, round(avg(p) OVER (PARTITION BY series_id ORDER BY slot RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS projected FROM f")
def window_timeline(spark, sf):
    return islands.project(full(spark, sf), ["series_id"], "slot", "p", 4, "mean").select("series_id", "slot", *r6("projected"))


@query(f"""WITH {FULL}, w AS (SELECT series_id, slot, count(p) OVER w AS n_filled, CAST(sum(CAST(coalesce(n, 0) > 1 AS INT)) OVER w AS BIGINT) AS n_observed, count(*) OVER w AS n_slots FROM f WINDOW w AS (PARTITION BY series_id ORDER BY slot ROWS 23 PRECEDING))
SELECT series_id, slot, n_filled, n_observed, CASE WHEN n_slots < 24 THEN 'insufficient_history' WHEN n_filled = 24 AND 24 - n_observed <= 2.4 + 1e-9 THEN 'scored' ELSE 'missing_data' END AS status FROM w WHERE (slot + 1) % 3 = 0""")
def sliding_windows(spark, sf):
    f = full(spark, sf).withColumn("seen", F.coalesce(F.col("n") > 1, F.lit(False)))
    return detect.sliding_windows(f, ["series_id"], "slot", "p", "seen", width=24, stride=3, missing_ratio=0.1).select("series_id", "slot", "n_filled", "n_observed", "status")


@query(f"WITH {FULL}, b AS (SELECT series_id, slot, p FROM f) SELECT series_id, slot, round(max(p) OVER w, 6) AS max_error, round(avg(p) OVER w, 6) AS mean_error, round(stddev_pop(p) OVER w, 6) AS error_std, count(p) OVER w AS n_points FROM b WINDOW w AS (PARTITION BY series_id ORDER BY slot ROWS 2 PRECEDING)")
def block_of_three(spark, sf):
    return rounded(detect.block_scores(full(spark, sf).select("series_id", "slot", "p"), ["series_id"], "slot", "p").drop("p"), "max_error", "mean_error", "error_std")


@query(f"WITH {H} SELECT series_id, sum(CASE WHEN step IS NULL OR step > 3 THEN 1 ELSE 0 END)::BIGINT AS n_gap3, sum(CASE WHEN step IS NULL OR step > 1 THEN 1 ELSE 0 END)::BIGINT AS n_gap1 FROM (SELECT *, slot - lag(slot) OVER (PARTITION BY series_id ORDER BY slot) AS step FROM h WHERE imax > 120) GROUP BY 1")
def sequence_counts(spark, sf):
    w = Window.partitionBy("series_id").orderBy("slot")
    step = hourly(spark, sf).where("imax > 120").withColumn("step", F.col("slot") - F.lag("slot").over(w))
    n = lambda g: F.sum((F.col("step").isNull() | (F.col("step") > g)).cast("long")).alias(f"n_gap{g}")
    return step.groupBy("series_id").agg(n(3), n(1))


@query("SELECT user_id, event_id, value, CAST(k AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def head_per_group(spark, sf):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")
    return table(spark, sf, "events").select("user_id", "event_id", "value", k.alias("k")).where("k <= 3")


@query(f"WITH {FULL}, v AS (SELECT series_id, day, avg(p) AS m FROM f GROUP BY 1, 2 HAVING count(p) >= 18), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS k FROM v) SELECT a.series_id, a.day, count(b.day) AS n_history, round(avg(b.m), 6) AS history_mean FROM r a LEFT JOIN r b ON a.series_id = b.series_id AND b.k BETWEEN a.k - 7 AND a.k - 1 GROUP BY 1, 2")
def rolling_history(spark, sf):
    v = full(spark, sf).groupBy("series_id", "day").agg(F.avg("p").alias("m"), F.count("p").alias("n")).where("n >= 18")
    w = Window.partitionBy("series_id").orderBy("day").rowsBetween(-7, -1)
    return v.select("series_id", "day", F.count("m").over(w).alias("n_history"), F.round(F.avg("m").over(w), 6).alias("history_mean"))
