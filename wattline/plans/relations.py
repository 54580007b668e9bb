"""Queries on joins, aggregates, the score contract, detection and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.functions import scalars
from wattline.operators import calibrate, contract, detect, evaluate, islands, joins, models, profile, timegrid
from wattline.plans.fixtures import EVENTS, FIRST, FULL, H, LAST, MODELS, PER_DAY, SCORES, TRAIN_END, full, hourly, scores, table, with_day
from wattline.plans.registry import query, r6, rounded
from wattline.plans.series import _ENV, _IV, _MAG, _intervals


def _events(spark, sf):
    got = contract.events(scores(spark, sf), ["model", "series_id"], "slot", gap=1, minutes=60)
    return got.withColumnsRenamed({"start_slot": "start", "end_slot": "end"})


_OUT = "round(raw_score, 6) AS raw_score, round(max_percentile, 6) AS max_percentile, round(threshold, 6) AS threshold"


@query(f"WITH {SCORES} SELECT model, series_id, slot, {_OUT}, is_anomaly, available FROM sc")
def canonical_scores(spark, sf):
    return rounded(scores(spark, sf), "raw_score", "max_percentile", "threshold").select("model", "series_id", "slot", "raw_score", "max_percentile", "threshold", "is_anomaly", "available")


#: Canonical rows, some of which violate a rule each (by slot), and one model that must disclose its resampling.
_BAD = f"""{SCORES}, bad AS (SELECT CASE WHEN slot % 11 = 0 THEN NULL WHEN slot % 13 = 0 THEN 'nn' ELSE model END AS model, CASE WHEN slot % 17 = 0 THEN NULL ELSE series_id END AS series_id,
CASE WHEN slot % 19 = 0 THEN NULL WHEN slot % 23 = 0 THEN slot * 3600 + 60 ELSE slot * 3600 END AS a, CASE WHEN slot % 29 = 0 THEN NULL WHEN slot % 31 = 0 THEN slot * 3600 + 1800 ELSE slot * 3600 + 3600 END AS b,
CASE WHEN slot % 37 = 0 THEN NULL WHEN slot % 41 = 0 THEN 'v_not_frozen' ELSE 'v1' END AS version, max_percentile + CASE WHEN slot % 43 = 0 THEN 1 ELSE 0 END AS top, CASE WHEN slot % 47 = 0 THEN NULL ELSE is_anomaly END AS flag,
CASE WHEN slot % 5 = 0 THEN 'observed' ELSE 'upsampled_from_30m' END AS data_status, CASE WHEN slot % 7 = 0 THEN 15 ELSE 30 END AS minutes FROM sc)"""


@query(f"""WITH {_BAD}, n AS (SELECT sum(k - 1) AS d FROM (SELECT count(*) AS k FROM bad GROUP BY model, series_id, a)), one AS (SELECT * FROM n)
SELECT count(*) FILTER (WHERE model IS NULL OR model NOT IN ('lof', 'mp', 'rpca')) AS unknown_model, count(*) FILTER (WHERE series_id IS NULL) AS missing_series, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unreadable_instant,
count(*) FILTER (WHERE version IS NULL OR version LIKE '%not_frozen%') AS not_frozen, count(*) FILTER (WHERE a IS NULL OR b IS NULL OR b - a <> 3600) AS wrong_duration, count(*) FILTER (WHERE a IS NULL OR a % 3600 <> 0) AS off_grid,
count(*) FILTER (WHERE top > 1 + 1e-9) AS percentile_out_of_range, count(*) FILTER (WHERE flag IS NULL) AS unknown_flag, count(*) FILTER (WHERE model = 'mp' AND NOT (data_status = 'upsampled_from_30m' AND minutes = 30)) AS undisclosed_resampling,
CAST((SELECT d FROM one) AS BIGINT) AS duplicates FROM bad""")
def validate_scores(spark, sf):
    by = lambda k: F.pmod("slot", F.lit(k)) == 0
    at = F.col("slot") * 3600
    start = F.when(by(19), None).when(by(23), at + 60).otherwise(at)
    end = F.when(by(29), None).when(by(31), at + 1800).otherwise(at + 3600)
    s = scores(spark, sf).withColumns({
        "model": F.when(by(11), None).when(by(13), "nn").otherwise(F.col("model")),
        "series_id": F.when(~by(17), F.col("series_id")),
        "interval_start": F.timestamp_seconds(start),
        "interval_end": F.timestamp_seconds(end),
        "calibration_version": F.when(by(37), None).when(by(41), "v_not_frozen").otherwise("v1"),
        "max_percentile": F.col("max_percentile") + F.when(by(43), 1).otherwise(0),
        "mean_percentile": F.lit(None).cast("double"),
        "is_anomaly": F.when(~by(47), F.col("is_anomaly")),
        "data_status": F.when(by(5), "observed").otherwise("upsampled_from_30m"),
        "source_resolution_minutes": F.when(by(7), 15).otherwise(30),
    })
    return contract.validate(s, MODELS, 60, {"mp": ("upsampled_from_30m", 30)})


_WIDE = ", ".join(f"round(max(CASE WHEN model = '{m}' THEN raw_score END), 6) AS {m}_raw_score, round(max(CASE WHEN model = '{m}' THEN max_percentile END), 6) AS {m}_max_percentile, bool_or(coalesce(model = '{m}', FALSE)) AS {m}_available" for m in MODELS)


@query(f"WITH {SCORES}, g AS (SELECT series_id, CAST(s.slot AS BIGINT) AS slot FROM (SELECT DISTINCT event_type AS series_id FROM events), range({FIRST}, {LAST}) s(slot)) SELECT g.series_id, g.slot, {_WIDE} FROM g LEFT JOIN sc USING (series_id, slot) GROUP BY 1, 2")
def ensemble_wide(spark, sf):
    grid = timegrid.full_grid(table(spark, sf, "events").select(F.col("event_type").alias("series_id")).distinct(), FIRST, LAST)
    return rounded(contract.wide(scores(spark, sf), grid, MODELS, ["raw_score", "max_percentile", "available"]), *[f"{m}_{c}" for m in MODELS for c in ("raw_score", "max_percentile")])


_EIGHT_SQL = ", ".join(f"round(max(CASE WHEN model = '{m}' THEN max_percentile END), 6) AS {m}_max_percentile, round(max(CASE WHEN model = '{m}' THEN max_percentile / 2 END), 6) AS {m}_mean_percentile, round(max(CASE WHEN model = '{m}' THEN raw_score END), 6) AS {m}_max_score, round(max(CASE WHEN model = '{m}' THEN raw_score - 1 END), 6) AS {m}_mean_score, bool_or(coalesce(model = '{m}', FALSE)) AS {m}_available, max(CASE WHEN model = '{m}' THEN 15 END) AS {m}_source_resolution_minutes, max(CASE WHEN model = '{m}' THEN 'observed' END) AS {m}_data_status, max(CASE WHEN model = '{m}' THEN 'max' END) AS {m}_aggregation_method" for m in (*MODELS, "absent"))


@query(f"WITH {SCORES}, g AS (SELECT series_id, CAST(s.slot AS BIGINT) AS slot FROM (SELECT DISTINCT event_type AS series_id FROM events), range({FIRST}, {LAST}) s(slot)) SELECT g.series_id, g.slot, {_EIGHT_SQL} FROM g LEFT JOIN (SELECT * FROM sc WHERE slot % 3 > 0) x USING (series_id, slot) GROUP BY 1, 2")
def ensemble_features(spark, sf):
    grid = timegrid.full_grid(table(spark, sf, "events").select(F.col("event_type").alias("series_id")).distinct(), FIRST, LAST)
    s = scores(spark, sf).where(F.pmod("slot", F.lit(3)) > 0)
    s = s.withColumns({"mean_percentile": F.col("max_percentile") / 2, "max_score": F.col("raw_score"), "mean_score": F.col("raw_score") - 1, "source_resolution_minutes": F.lit(15), "data_status": F.lit("observed"), "aggregation_method": F.lit("max")})
    names = (*MODELS, "absent")
    return rounded(contract.wide(s, grid, names), *[f"{m}_{c}" for m in names for c in ("max_percentile", "mean_percentile", "max_score", "mean_score")])


@query(f"""WITH {EVENTS} SELECT model, series_id, start, "end", round(top, 6) AS top, round(mean, 6) AS mean, n, substr(sha1(concat_ws('|', model, series_id, CAST(start AS VARCHAR), CAST("end" AS VARCHAR))), 1, 16) AS event_id FROM ev""")
def events_canonical(spark, sf):
    e = _events(spark, sf)
    return e.select("model", "series_id", "start", "end", F.round("max_raw_score", 6).alias("top"), F.round("mean_raw_score", 6).alias("mean"), F.col("interval_count").alias("n"), scalars.event_id(F.col("model"), F.col("series_id"), F.col("start"), F.col("end")).alias("event_id"))


@query(f"WITH {SCORES} SELECT model, series_id, count(*) AS n_intervals, CAST(sum(CAST(available AS INT)) AS BIGINT) AS n_available, CAST(sum(CAST(is_anomaly AS INT)) AS BIGINT) AS n_anomaly, min(slot) AS first_slot, max(slot) AS last_slot, string_agg(DISTINCT CASE WHEN slot % 7 = 0 THEN 'interpolated' ELSE 'observed' END, '|' ORDER BY CASE WHEN slot % 7 = 0 THEN 'interpolated' ELSE 'observed' END) AS data_status FROM sc GROUP BY 1, 2")
def run_summary(spark, sf):
    s = scores(spark, sf).withColumn("data_status", F.when(F.pmod("slot", F.lit(7)) == 0, "interpolated").otherwise("observed"))
    return contract.run_summary(s, ["model", "series_id"], "slot")


@query(f"WITH {EVENTS} SELECT start // 24 AS day, model, CASE WHEN n > 1 THEN 'run' ELSE 'spike' END AS kind, count(*) AS n_events FROM ev GROUP BY 1, 2, 3")
def daily_summary(spark, sf):
    return _events(spark, sf).groupBy(F.floor(F.col("start") / PER_DAY).cast("long").alias("day"), "model", F.when(F.col("interval_count") > 1, "run").otherwise("spike").alias("kind")).agg(F.count("*").alias("n_events"))


@query(f"WITH m(model) AS (VALUES ('absent'), ('lof'), ('mp'), ('rpca')), {SCORES} SELECT m.model, count(sc.model) AS n_rows, CASE WHEN count(sc.model) = 0 THEN 'missing' ELSE 'ready' END AS state FROM m LEFT JOIN sc USING (model) GROUP BY 1")
def model_readiness(spark, sf):
    return contract.readiness(scores(spark, sf), ["absent", *MODELS])


# joins ---------------------------------------------------------------------


@query(f"WITH {H}, tr AS (SELECT event_type AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, bool_or(value > 200) AS truth, max(value) AS peak FROM events GROUP BY 1, 2) SELECT series_id, slot, truth, round(peak, 6) AS peak FROM h LEFT JOIN tr USING (series_id, slot)")
def truth_bucket_join(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), timegrid.epoch(F.col("ts")).alias("at"), "value")
    win = hourly(spark, sf).select("series_id", (F.col("slot") * 3600).alias("start"))
    got = joins.bucket_truth(ev, win, ["series_id"], "at", "start", 3600, [F.bool_or(F.col("value") > 200).alias("truth"), F.max("value").alias("peak")])
    return got.select("series_id", F.floor(F.col("start") / 3600).cast("long").alias("slot"), "truth", *r6("peak"))


_QI = """qi AS (SELECT o_custkey AS k, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + 10 AS b_start, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + 25 AS b_end FROM orders WHERE o_orderpriority LIKE '1%')"""


def _quality(spark, sf):
    d = F.floor(timegrid.epoch(F.col("o_orderdate")) / 86400).cast("long")
    return table(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("k"), (d + 10).alias("b_start"), (d + 25).alias("b_end"))


@query(f'WITH {_IV}, {_QI} SELECT k, id, start, "end" FROM iv WHERE NOT EXISTS (SELECT 1 FROM qi WHERE qi.k = iv.k AND iv.start < b_end AND iv."end" > b_start)')
def overlap_anti_join(spark, sf):
    return joins.without_overlap(_intervals(spark, sf), _quality(spark, sf), ["k"], 32, "id")


@query(f'WITH {_IV}, {_QI} SELECT k, id, b_start, b_end FROM iv JOIN qi USING (k) WHERE iv.start < b_end AND iv."end" > b_start')
def overlap_join(spark, sf):
    return joins.overlapping(_intervals(spark, sf), _quality(spark, sf), ["k"], 32).select("k", "id", "b_start", "b_end")


@query(f"""WITH {_IV}, iv2 AS (SELECT n_regionkey AS region, k, id, start, "end" FROM iv JOIN customer ON k = c_custkey JOIN nation ON c_nationkey = n_nationkey), el AS (SELECT region, count(DISTINCT k) AS eligible FROM iv2 GROUP BY 1),
c AS (SELECT a.id, count(DISTINCT b.k) AS n_channels FROM iv2 a JOIN iv2 b ON a.region = b.region AND a.start < b."end" AND a."end" > b.start GROUP BY 1)
SELECT CAST(iv2.region AS BIGINT) AS region, iv2.id, n_channels, eligible, n_channels >= 3 AND n_channels / eligible >= 0.02 AS common_mode FROM iv2 JOIN c USING (id) JOIN el USING (region)""")
def common_mode(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("n_regionkey").cast("long").alias("region"))
    iv = _intervals(spark, sf).join(c, "k")
    eligible = iv.groupBy("region").agg(F.countDistinct("k").alias("eligible"))
    return joins.common_mode(iv, eligible, ["region"], "k", "id", 32, share=0.02).select("region", "id", "n_channels", "eligible", "common_mode")


@query(f"""WITH {_IV}, iv2 AS (SELECT n_regionkey AS region, k, id, start, "end" FROM iv JOIN customer ON k = c_custkey JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT *, max("end") OVER (PARTITION BY region ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv2),
u AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS unit FROM m)
SELECT CAST(region AS BIGINT) AS region, min(start) AS start, max("end") AS "end", count(*) AS n_events, count(DISTINCT k) AS n_channels, max("end" - start) AS longest FROM u GROUP BY region, unit""")
def incident_summary(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("n_regionkey").cast("long").alias("region"))
    iv = _intervals(spark, sf).join(c, "k")
    reach = iv.groupBy("region", "start").agg(F.max("end").alias("end"))  # intervals of one start are always one unit
    units = islands.merge_intervals(reach, ["region"], "start", "end", touching=False).select("region", "start", "unit")
    return iv.join(units, ["region", "start"]).groupBy("region", "unit").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_events"), F.countDistinct("k").alias("n_channels"), F.max(F.col("end") - F.col("start")).alias("longest")).drop("unit")


@query(f'WITH {EVENTS} SELECT ev.model, ev.series_id, ev.start, round(max(h.imax), 6) AS peak, count(*) AS n_hours FROM ev JOIN h ON h.series_id = ev.series_id AND h.slot >= ev.start AND h.slot < ev."end" GROUP BY 1, 2, 3')
def event_score_overlap(spark, sf):
    e = _events(spark, sf).select("model", "series_id", "start", "end")
    h = hourly(spark, sf).select("series_id", "imax", F.col("slot").alias("b_start"), (F.col("slot") + 1).alias("b_end"))
    return joins.overlapping(e, h, ["series_id"], 24).groupBy("model", "series_id", "start").agg(F.round(F.max("imax"), 6).alias("peak"), F.count("*").alias("n_hours"))


@query(f'WITH {EVENTS} SELECT series_id, slot, n FROM h WHERE EXISTS (SELECT 1 FROM ev WHERE ev.series_id = h.series_id AND h.slot >= ev.start AND h.slot < ev."end")')
def point_in_interval(spark, sf):
    return joins.covered_points(hourly(spark, sf).select("series_id", "slot", "n"), _events(spark, sf), ["series_id"], "slot")


@query(f"WITH {H} SELECT series_id, max(slot) AS slot, round(arg_max(p, slot), 6) AS p FROM h WHERE n > 3 AND slot < {TRAIN_END} GROUP BY 1")
def asof_last_real(spark, sf):
    return rounded(joins.latest_before(hourly(spark, sf), "series_id", "slot", "p", F.lit(TRAIN_END), F.col("n") > 3), "p")


@query("WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type FROM events WHERE value > 150) SELECT day, count(DISTINCT event_type) AS n_members FROM d GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def common_dates(spark, sf):
    d = table(spark, sf, "events").where("value > 150").select(F.floor(timegrid.epoch(F.col("ts")) / 86400).cast("long").alias("day"), "event_type")
    return joins.in_all(d, "day", "event_type", 5)


@query(f"WITH {SCORES} SELECT series_id, slot, count(*) AS n_variants, min(raw_score) >= 5 AS all_scored FROM sc GROUP BY 1, 2 HAVING bool_and(raw_score > 1)")
def common_availability(spark, sf):
    return scores(spark, sf).groupBy("series_id", "slot").agg(F.count("*").alias("n_variants"), (F.min("raw_score") >= 5).alias("all_scored"), F.every(F.col("raw_score") > 1).alias("ok")).where("ok").drop("ok")


@query(f"WITH {SCORES} SELECT a.series_id, a.slot, round(b.raw_score - a.raw_score, 6) AS difference FROM sc a JOIN sc b USING (series_id, slot) WHERE a.model = 'mp' AND b.model = 'lof'")
def paired_variants(spark, sf):
    s = scores(spark, sf)
    a, b = (s.where(F.col("model") == m).select("series_id", "slot", F.col("raw_score").alias(c)) for m, c in (("mp", "old"), ("lof", "new")))
    return a.join(b, ["series_id", "slot"]).select("series_id", "slot", F.round(F.col("new") - F.col("old"), 6).alias("difference"))


@query("SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY 1, 2")
def missing_keys_lookup(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("(SELECT o_custkey AS k, 'both' AS side FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT o_custkey, 'only_f' FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'only_f' FROM orders WHERE o_orderstatus = 'O')")
def set_operations(spark, sf):
    o = table(spark, sf, "orders")
    f, p = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return f.intersect(p).withColumn("side", F.lit("both")).unionByName(f.distinct().exceptAll(p.distinct()).withColumn("side", F.lit("only_f")))


@query("SELECT l_suppkey, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days, round(max(l_extendedprice), 2) AS top FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50")
def top_series(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct(F.col("l_shipdate").cast("date")).alias("n_days"), F.round(F.max("l_extendedprice"), 2).alias("top"))
    return g.orderBy(F.desc("n_days"), F.desc("top"), "l_suppkey").limit(50)


# detection -----------------------------------------------------------------


@query(f"""WITH {SCORES}, w AS (SELECT series_id, slot, max(CASE WHEN model = 'mp' THEN max_percentile END) AS a, max(CASE WHEN model = 'lof' THEN max_percentile END) AS b, max(CASE WHEN model = 'rpca' AND slot % 5 <> 0 THEN max_percentile END) AS c FROM sc GROUP BY 1, 2),
l AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS k FROM w) SELECT series_id, slot, round(list_max(k), 6) AS max_score, round(list_avg(k), 6) AS mean_score, round(list_stddev_pop(k), 6) AS score_std, round(len(k) / 3, 6) AS coverage_ratio, len(k) > 0 AS available, coalesce(list_max(k) > 0.995, FALSE) AS is_anomaly FROM l""")
def interval_combine(spark, sf):
    pick = lambda m, extra=F.lit(True): F.max(F.when((F.col("model") == m) & extra, F.col("max_percentile")))
    w = scores(spark, sf).groupBy("series_id", "slot").agg(pick("mp").alias("a"), pick("lof").alias("b"), pick("rpca", F.pmod("slot", F.lit(5)) != 0).alias("c"))
    return rounded(w.select("series_id", "slot", *[c.alias(k) for k, c in detect.combine([F.col("a"), F.col("b"), F.col("c")]).items()]), "max_score", "mean_score", "score_std", "coverage_ratio")


_PARTS = f"""{SCORES}, w AS (SELECT series_id, slot, 100 * max(CASE WHEN model = 'lof' THEN max_percentile END) AS s, 100 * max(CASE WHEN model = 'rpca' THEN max_percentile END) AS m, 100 * max(CASE WHEN model = 'mp' THEN max_percentile END) AS g FROM sc GROUP BY 1, 2)"""
_CAND = f"""{_PARTS}, cd AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY series_id ORDER BY slot) <= 2 THEN 0 ELSE 1 END AS nw FROM w WHERE s > 97 OR m > 97 OR (s > 93 AND m > 93)),
ci AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM cd)"""


@query(f"""WITH {_CAND}, a AS (SELECT series_id, min(slot) AS start, max(slot) + 1 AS "end", max(s) AS s, max(m) AS m, max(g) AS g FROM ci GROUP BY series_id, island)
SELECT series_id, start, "end", CASE WHEN s > 99 AND m > 99 AND g >= 99.5 THEN 'HIGH' WHEN (s > 99 AND m > 99) OR g >= 99.5 THEN 'MEDIUM' ELSE 'CANDIDATE' END AS confidence,
CASE WHEN m > 99 AND s <= 99 THEN 'sustained_deviation' WHEN g >= 99.5 AND NOT (s > 99 OR m > 99) THEN 'magnitude_anomaly' ELSE 'shape_change' END AS event_type, substr(sha1(concat_ws('|', series_id, CAST(start AS VARCHAR), CAST("end" AS VARCHAR))), 1, 16) AS event_id FROM a""")
def candidate_events(spark, sf):
    pick = lambda m: 100 * F.max(F.when(F.col("model") == m, F.col("max_percentile")))
    w = scores(spark, sf).groupBy("series_id", "slot").agg(pick("lof").alias("s"), pick("rpca").alias("m"), pick("mp").alias("g"))
    runs = islands.islands(w.where(detect.candidate(F.col("s"), F.col("m"), 97, 93)), ["series_id"], "slot", gap=2)
    a = runs.groupBy("series_id", "island").agg(F.min("slot").alias("start"), (F.max("slot") + 1).alias("end"), F.max("s").alias("s"), F.max("m").alias("m"), F.max("g").alias("g"))
    big, no = F.col("g") >= 99.5, F.lit(False)
    return a.select("series_id", "start", "end", detect.confidence(F.col("s"), F.col("m"), big).alias("confidence"), detect.event_type(no, no, big, F.col("s"), F.col("m")).alias("event_type"), scalars.event_id(F.col("series_id"), F.col("start"), F.col("end")).alias("event_id"))


@query(f"WITH {_PARTS} SELECT series_id, slot, CASE WHEN greatest(s, m) > 97 AND g > 97 THEN 'shape_and_magnitude' WHEN greatest(s, m) > 97 THEN 'shape' WHEN g > 97 THEN 'magnitude' ELSE 'none' END AS source FROM w")
def trigger_attribution(spark, sf):
    pick = lambda m: 100 * F.max(F.when(F.col("model") == m, F.col("max_percentile")))
    w = scores(spark, sf).groupBy("series_id", "slot").agg(pick("lof").alias("s"), pick("rpca").alias("m"), pick("mp").alias("g"))
    return w.select("series_id", "slot", detect.trigger(F.col("s"), F.col("m"), F.col("g"), 97).alias("source"))


def _banded(spark, sf):
    f = full(spark, sf)
    base = f.where(F.col("slot") < TRAIN_END)
    env = calibrate.envelope(base, ["series_id"], "h", "day", "p", reach=2, per_day=PER_DAY, q=0.05)
    mag = calibrate.magnitude_scalars(base, ["series_id"], "day", "slot", "p", least=0.5, relative=0.05, q=0.995)
    w = Window.partitionBy("series_id").orderBy("slot")
    t = f.where(F.col("slot") >= TRAIN_END).withColumn("jump_in", F.abs(F.col("p") - F.lag("p").over(w)))
    return t.join(env, ["series_id", "h"]).join(mag, "series_id").withColumn("value", F.col("p"))


_BAND = f"""{FULL}, {_ENV}, {_MAG}, bd AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY series_id ORDER BY slot)) AS jump_in FROM f WHERE slot >= {TRAIN_END}), bb AS (SELECT bd.*, lower, upper, support, effect, jump FROM bd JOIN en USING (series_id, h) JOIN mg USING (series_id))"""


@query(f"""WITH {_BAND}, x AS (SELECT *, greatest(p - upper, lower - p) AS excess FROM bb), ht AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY series_id ORDER BY slot) <= 1 THEN 0 ELSE 1 END AS nw FROM x WHERE excess > effect AND support >= 6),
i AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM ht)
SELECT series_id, min(slot) AS start, max(slot) + 1 AS "end", count(*) AS n, round(max(excess), 6) AS peak, bool_or(coalesce(jump_in > jump, FALSE)) AS jumped FROM i GROUP BY series_id, island""")
def magnitude_runs(spark, sf):
    b = _banded(spark, sf).withColumns({"percentile": F.lit(100.0), "quality": F.lit(False), "jumped": F.coalesce(F.col("jump_in") > F.col("jump"), F.lit(False))})
    return rounded(detect.magnitude_runs(b, ["series_id"], "slot", least=1).drop("effect"), "peak")


@query(f"""WITH {_BAND}, d AS (SELECT *, CASE WHEN p - upper > effect THEN 1 WHEN lower - p > effect THEN -1 END AS direction FROM bb), ht AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY series_id, direction ORDER BY slot) <= 1 THEN 0 ELSE 1 END AS nw FROM d WHERE direction IS NOT NULL),
i AS (SELECT *, sum(nw) OVER (PARTITION BY series_id, direction ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM ht),
a AS (SELECT series_id, direction, min(slot) AS start, max(slot) + 1 AS "end", count(*) AS n, max(greatest(p - upper, lower - p)) AS peak, arg_min(coalesce(jump_in, 0), slot) AS onset, first(effect) AS effect, first(jump) AS jump FROM i GROUP BY series_id, direction, island)
SELECT series_id, direction, start, "end", concat_ws('|', CASE WHEN n < 1 THEN 'no_sustained_historical_envelope_exceedance' END, CASE WHEN peak < 2 * effect THEN 'insufficient_peak_power_effect' END, CASE WHEN onset <= jump THEN 'no_abrupt_onset_above_frozen_jump_guard' END, CASE WHEN n <= 1 THEN 'no_multiscale_or_current_confirmation' END) AS reasons FROM a""")
def triage_reasons(spark, sf):
    runs = detect.direction_runs(_banded(spark, sf).withColumns({"short": F.lit(0.0), "medium": F.lit(0.0), "current_beyond": F.lit(False)}), ["series_id"], "slot")
    runs = runs.withColumn("current_share", F.when(F.col("n") > 1, 1.0).otherwise(0.0))
    return detect.triage_reasons(runs, least=1).select("series_id", "direction", "start", "end", "reasons")


@query(f"""WITH {_BAND} SELECT series_id, slot, CASE WHEN p IS NULL THEN 'unavailable' WHEN p - upper > effect THEN 'priority' WHEN n = 1 THEN 'data_quality' WHEN lower - p > effect THEN 'operating_change' WHEN imax > 200 THEN 'noncore_context' ELSE 'no_source_event' END AS review_state, CASE WHEN p IS NOT NULL THEN p - upper > effect END AS priority FROM bb""")
def review_grid(spark, sf):
    b = _banded(spark, sf)
    known = F.col("p").isNotNull()
    priority = F.when(known, F.col("p") - F.col("upper") > F.col("effect"))
    state = contract.review_state(known, priority, F.col("n") == 1, F.col("lower") - F.col("p") > F.col("effect"), F.col("imax") > 200)
    return b.select("series_id", "slot", state.alias("review_state"), priority.alias("priority"))


_WIN = f"""{FULL}, d3 AS (SELECT * FROM f WHERE p IS NOT NULL),
wn AS (SELECT d3.series_id, d3.day, s.k AS start, h - s.k AS o, p, count(*) OVER w AS c, avg(p) OVER w AS m, stddev_pop(p) OVER w AS sd FROM d3 JOIN (SELECT CAST(k AS BIGINT) AS k FROM range(21) t(k)) s ON h BETWEEN s.k AND s.k + 3 WINDOW w AS (PARTITION BY d3.series_id, d3.day, s.k)),
z AS (SELECT *, (p - m) / sd AS z FROM wn WHERE c = 4)"""


def _days(spark, sf):
    """One row per series and day with its 24 values, and whether it is a test day."""
    days = full(spark, sf).groupBy("series_id", "day").agg(F.sort_array(F.collect_list(F.struct("h", "p"))).alias("a"))
    return days.select("series_id", "day", F.transform("a", lambda s: s["p"]).alias("v"), (F.col("day") >= TRAIN_END // PER_DAY).alias("q"))


_FROM = TRAIN_END // PER_DAY


@query(f"""WITH {_WIN}, pr AS (SELECT q.series_id, q.day, q.start, r.day AS r_day, r.start AS r_start, sqrt(greatest(8 - 2 * sum(q.z * r.z), 0)) AS d FROM z q JOIN z r USING (series_id, o) WHERE q.day >= {_FROM} AND r.day < {_FROM} GROUP BY 1, 2, 3, 4, 5) SELECT series_id, day, start, round(min(d), 4) AS distance FROM pr GROUP BY 1, 2, 3""")
def znorm_ab_join(spark, sf):
    got = profile.ab_join_arrays(_days(spark, sf), "series_id", "day", "v", "q", 4)
    return got.select("series_id", "day", "start", F.round("distance", 4).alias("distance"))


@query(f"""WITH {_WIN}, pr AS (SELECT q.series_id, q.day, q.start, r.day AS r_day, r.start AS r_start, sqrt(greatest(8 - 2 * sum(q.z * r.z), 0)) AS d FROM z q JOIN z r USING (series_id, o) WHERE q.day < {_FROM} AND r.day < {_FROM} AND q.day <> r.day GROUP BY 1, 2, 3, 4, 5) SELECT series_id, day, start, round(min(d), 4) AS distance FROM pr GROUP BY 1, 2, 3""")
def lodo_calibration(spark, sf):
    got = profile.ab_join_arrays(_days(spark, sf).where("NOT q").withColumn("q", F.lit(True)), "series_id", "day", "v", "q", 4, leave_own_day_out=True)
    return got.select("series_id", "day", "start", F.round("distance", 4).alias("distance"))


@query(f"""WITH {FULL}, d AS (SELECT DISTINCT series_id, day FROM f), x AS (SELECT *, isodow(DATE '1970-01-01' + CAST(day AS INT)) >= 6 AS we FROM d), pr AS (SELECT a.series_id, a.day, b.day AS r_day, a.we = b.we AS same, sum(CAST(a.we = b.we AS INT)) OVER (PARTITION BY a.series_id, a.day) AS n FROM x a JOIN x b USING (series_id) WHERE a.day >= {TRAIN_END // 24} AND b.day < {TRAIN_END // 24})
SELECT series_id, day, count(*) AS n_reference, sum(r_day)::BIGINT AS checksum FROM pr WHERE same OR n < 6 GROUP BY 1, 2""")
def reference_days(spark, sf):
    d = full(spark, sf).select("series_id", "day").distinct()
    got = profile.reference_days(d.where(F.col("day") >= TRAIN_END // PER_DAY), d.where(F.col("day") < TRAIN_END // PER_DAY), "series_id", "day")
    return got.groupBy("series_id", "day").agg(F.count("*").alias("n_reference"), F.sum("r_day").alias("checksum"))


@query(f"""WITH {FULL}, d AS (SELECT series_id, day, max(p) AS score FROM f GROUP BY 1, 2), c AS (SELECT *, median(score) OVER (PARTITION BY series_id) AS m FROM d WHERE day < {TRAIN_END // 24}), st AS (SELECT series_id, max(score) AS top, first(m) AS m, median(abs(score - m)) AS mad FROM c GROUP BY 1)
SELECT series_id, day, round(score, 6) AS score, score > top AND score > m + 4 * mad AS daily_outlier FROM d JOIN st USING (series_id) WHERE day >= {TRAIN_END // 24}""")
def daily_outlier(spark, sf):
    d = full(spark, sf).groupBy("series_id", "day").agg(F.max("p").alias("score"))
    got = profile.daily_outlier(d.where(F.col("day") < TRAIN_END // PER_DAY), d.where(F.col("day") >= TRAIN_END // PER_DAY), "series_id", "score")
    return got.select("series_id", "day", *r6("score"), "daily_outlier")


# evaluation ----------------------------------------------------------------

_CONF = "sum(CAST({f} AND {t} AS INT))::BIGINT AS tp, sum(CAST({f} AND NOT {t} AS INT))::BIGINT AS fp, sum(CAST(NOT {f} AND {t} AS INT))::BIGINT AS fn, sum(CAST(NOT {f} AND NOT {t} AS INT))::BIGINT AS tn"


@query(f"""WITH {SCORES}, x AS (SELECT sc.*, h.n >= 4 AS truth FROM sc JOIN h USING (series_id, slot)), c AS (SELECT model, series_id, {_CONF.format(f='is_anomaly', t='truth')} FROM x GROUP BY 1, 2), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM c)
SELECT model, series_id, tp, fp, fn, tn, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1 FROM p""")
def confusion_metrics(spark, sf):
    x = scores(spark, sf).join(hourly(spark, sf).select("series_id", "slot", (F.col("n") >= 4).alias("truth")), ["series_id", "slot"])
    return rounded(evaluate.confusion(x, ["model", "series_id"], F.col("is_anomaly"), F.col("truth")), "precision", "recall", "f1")


@query("WITH j AS (SELECT quality = 1 AS q, toxic = 1 AS t FROM labels) SELECT " + _CONF.format(f="q", t="t") + ", round(coalesce(sum(CAST(q AND t AS INT)) / nullif(sum(CAST(q AS INT)), 0), 0), 6) AS \"precision\", round(coalesce(sum(CAST(q AND t AS INT)) / nullif(sum(CAST(t AS INT)), 0), 0), 6) AS recall, round(coalesce(2.0 * sum(CAST(q AND t AS INT)) / nullif(sum(CAST(q AS INT)) + sum(CAST(t AS INT)), 0), 0), 6) AS f1 FROM j")
def confusion_global(spark, sf):
    return rounded(evaluate.confusion(table(spark, sf, "labels"), [], F.col("quality") == 1, F.col("toxic") == 1), "precision", "recall", "f1")


@query(f"WITH {SCORES}, v AS (SELECT * FROM sc WHERE NOT (model = 'mp' AND slot % 4 = 0)) SELECT series_id, slot, coalesce(sum(CAST(is_anomaly AS INT)), 0) >= 1 AS \"any\", coalesce(sum(CAST(is_anomaly AS INT)), 0) >= 2 AS two, coalesce(sum(CAST(is_anomaly AS INT)), 0) = 3 AS \"all\" FROM v GROUP BY 1, 2")
def vote_strategies(spark, sf):
    s = scores(spark, sf).where(~((F.col("model") == "mp") & (F.pmod("slot", F.lit(4)) == 0)))
    return evaluate.votes(s, ["series_id", "slot"], MODELS)


@query(f"""WITH {H}, c AS (SELECT event_type AS case_id, event_type AS series_id, {TRAIN_END} + 5 AS a, {TRAIN_END} + 53 AS b FROM (SELECT DISTINCT event_type FROM events)), k AS (SELECT case_id, c.series_id, x.i AS block, a, b FROM c, range({TRAIN_END + 5} // 3, {TRAIN_END + 52} // 3 + 1) x(i))
SELECT case_id, k.series_id, CAST(block AS BIGINT) AS block, round(avg(p), 6) AS mean, round(min(p), 6) AS least, round(max(p), 6) AS most, count(p) AS n_points FROM k LEFT JOIN h ON h.series_id = k.series_id AND h.slot // 3 = block AND h.slot >= a AND h.slot < b GROUP BY 1, 2, 3""")
def raw_case_metrics(spark, sf):
    h = hourly(spark, sf)
    cases = h.select("series_id").distinct().select(F.col("series_id").alias("case_id"), "series_id", F.lit(TRAIN_END + 5).alias("start"), F.lit(TRAIN_END + 53).alias("end"))
    return rounded(evaluate.raw_aggregates(h, cases, "series_id", "slot", "p"), "mean", "least", "most")


@query(f"""WITH {SCORES} SELECT series_id, slot // 3 AS bin, round(max(raw_score), 6) AS max_score, round(avg(raw_score), 6) AS mean_score, round(stddev_pop(raw_score), 6) AS score_std, count(*) AS n_points, CAST(sum(CAST(is_anomaly AS INT)) AS BIGINT) AS n_flags, bool_or(is_anomaly) AS is_anomaly, round(count(*) / 3, 6) AS coverage_ratio, count(*) = 3 AS complete FROM sc WHERE model = 'lof' GROUP BY 1, 2""")
def lof_interval_scores(spark, sf):
    s = scores(spark, sf).where("model = 'lof'")
    return rounded(detect.lof_bins(s, ["series_id"], "slot", "raw_score", "is_anomaly"), "max_score", "mean_score", "score_std", "coverage_ratio")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf, "customer").select("c_custkey")).distinct()


@query("SELECT r.r_name, count(*) AS n_nations, max(n.n_name) AS last_nation FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1")
def map_lookup(spark, sf):
    regions = table(spark, sf, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("names"))
    named = table(spark, sf, "nation").crossJoin(F.broadcast(regions)).select(F.element_at("names", F.col("n_regionkey")).alias("r_name"), "n_name")
    return named.groupBy("r_name").agg(F.count("*").alias("n_nations"), F.max("n_name").alias("last_nation"))


@query("SELECT c_custkey, c_name, n_orders FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey)")
def one_to_one_merge(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return joins.one_to_one(table(spark, sf, "customer").select("c_custkey", "c_name"), counts, ["c_custkey"])


@query("SELECT event_type, event_id, CAST(k AS BIGINT) AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY substr(sha256(CAST(event_id AS VARCHAR)), 1, 16), event_id) AS k FROM events) WHERE k <= 20")
def stratified_hash_sample(spark, sf):
    got = evaluate.hash_sample(table(spark, sf, "events").select("event_type", "event_id"), ["event_type"], "event_id", 20)
    return got.select("event_type", "event_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {H}, k AS (SELECT series_id, slot, row_number() OVER (PARTITION BY series_id ORDER BY slot) - 1 AS position, count(*) OVER (PARTITION BY series_id) AS n FROM h) SELECT series_id, slot, CAST(position AS BIGINT) AS position FROM k WHERE position IN (SELECT floor(i * (n - 1) / 9) FROM range(10) t(i))")
def evenly_spaced_sample(spark, sf):
    got = evaluate.evenly_spaced(hourly(spark, sf).select("series_id", "slot"), "series_id", "slot", 10)
    return got.select("series_id", "slot", F.col("position").cast("long").alias("position"))


@query("SELECT c_nationkey, c_custkey, pick FROM (SELECT *, CASE WHEN k = 1 THEN 'highest' ELSE 'median' END AS pick FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE k = 1 OR k = (n + 1) // 2)")
def channel_choice(spark, sf):
    return evaluate.choose_positions(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "pick")


@query(f"""WITH {EVENTS}, s AS (SELECT * FROM (VALUES ('a', 50.0, 0), ('b', 50.0, 6), ('c', 100.0, 6)) t(scenario, thr, gap)), m AS (SELECT scenario, gap, model, series_id, start, "end", lag("end") OVER (PARTITION BY scenario, model, series_id ORDER BY start) AS pe FROM ev, s WHERE top >= thr)
SELECT scenario, CAST(sum(CASE WHEN pe IS NULL OR start - pe > gap THEN 1 ELSE 0 END) AS BIGINT) AS n_events, count(*) AS n_sequences FROM m GROUP BY 1""")
def rule_sensitivity(spark, sf):
    sc = spark.createDataFrame([("a", 50.0, 0), ("b", 50.0, 6), ("c", 100.0, 6)], "scenario string, threshold double, gap int")
    return evaluate.sensitivity(_events(spark, sf).withColumn("score", F.col("max_raw_score")), sc, ["model", "series_id"])


@query(f"""WITH {SCORES}, v AS (SELECT model, avg(CAST(is_anomaly AS INT)) AS rate FROM sc GROUP BY 1) SELECT model, round(rate, 6) AS flag_rate, round((1 - rate / (SELECT rate FROM v WHERE model = 'rpca')) * 100, 4) AS reduction FROM v""")
def variant_comparison(spark, sf):
    v = scores(spark, sf).groupBy("model").agg(F.avg(F.col("is_anomaly").cast("int")).alias("rate"))
    base = v.where("model = 'rpca'").select(F.col("rate").alias("base"))
    return v.crossJoin(F.broadcast(base)).select("model", F.round("rate", 6).alias("flag_rate"), F.round((1 - F.col("rate") / F.col("base")) * 100, 4).alias("reduction"))


@query("SELECT event_type, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_kind, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1, 2, 3")
def distribution_diagnostics(spark, sf):
    kind = F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday").alias("day_kind")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, sf, "events").groupBy("event_type", kind, F.hour("ts").cast("long").alias("h")).agg(F.count("*").alias("n"), q.alias("q")).select("event_type", "day_kind", "h", "n", F.round(F.col("q")[0], 6).alias("q50"), F.round(F.col("q")[1], 6).alias("q95"))


@query("SELECT user_id, max(value) AS value, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS ids, count(*) AS n FROM events GROUP BY user_id")
def coalesce_duplicates(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("value"), F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), "|").alias("ids"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS kinds, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS top FROM events GROUP BY 1")
def json_props(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(k).alias("kinds"), F.max(k).alias("top"))


@query(f"""WITH {EVENTS}, iv AS (SELECT DISTINCT model, series_id, start, "end" FROM ev) SELECT sc.model, sc.series_id, sc.slot, sc.is_anomaly, CASE WHEN sc.is_anomaly THEN 'anomaly' ELSE 'normal' END AS label, iv.start IS NOT NULL AS in_event FROM sc LEFT JOIN iv ON iv.model = sc.model AND iv.series_id = sc.series_id AND sc.slot >= iv.start AND sc.slot < iv."end" """)
def annotate_scores(spark, sf):
    e = _events(spark, sf)
    slots = e.select("model", "series_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("slot")).distinct().withColumn("hit", F.lit(True))
    return scores(spark, sf).join(slots, ["model", "series_id", "slot"], "left").select("model", "series_id", "slot", "is_anomaly", scalars.flag_label(F.col("is_anomaly")).alias("label"), F.coalesce("hit", F.lit(False)).alias("in_event"))


@query(f"""WITH {SCORES}, x AS (SELECT sc.model, h.n >= 4 AS inj, is_anomaly FROM sc JOIN h USING (series_id, slot)) SELECT model, count(*) FILTER (WHERE inj) AS n_injected, count(*) FILTER (WHERE inj AND is_anomaly) AS n_covered, count(*) FILTER (WHERE NOT inj AND is_anomaly) AS n_background, round(100 * count(*) FILTER (WHERE inj AND is_anomaly) / nullif(count(*) FILTER (WHERE inj), 0), 4) AS coverage FROM x GROUP BY 1""")
def injection_coverage(spark, sf):
    x = scores(spark, sf).join(hourly(spark, sf).select("series_id", "slot", (F.col("n") >= 4).alias("inj")), ["series_id", "slot"])
    inj, hit = F.col("inj"), F.col("is_anomaly")
    a = x.groupBy("model").agg(F.count_if(inj).alias("n_injected"), F.count_if(inj & hit).alias("n_covered"), F.count_if(~inj & hit).alias("n_background"))
    return a.withColumn("coverage", F.round(F.try_divide(100 * F.col("n_covered"), F.col("n_injected")), 4))


@query("""WITH RECURSIVE e AS (SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 60),
c(n, u) AS (SELECT x, x FROM e UNION SELECT e.y, c.u FROM c JOIN e ON e.x = c.n) SELECT n AS node, min(u) AS unit FROM c GROUP BY 1""")
def review_units(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("node"), F.floor(timegrid.epoch(F.col("o_orderdate")) / 86400).cast("long").alias("start"))
    runs = islands.islands(o, ["o_custkey"], "start", gap=60)  # neighbours within 60 days link the same orders as all pairs do
    return runs.select("node", F.min("node").over(Window.partitionBy("o_custkey", "island")).alias("unit"))


@query()
def rpca_scores(spark, sf):
    f = full(spark, sf).groupBy("series_id", "day").agg(F.sort_array(F.collect_list(F.struct("h", F.coalesce("p", F.lit(0.0)).alias("p")))).alias("a"))
    days = f.select("series_id", "day", F.transform("a", lambda s: s["p"]).alias("values"), (F.col("day") < TRAIN_END // PER_DAY).alias("is_train"))
    return models.rpca_scores(days, quantile=0.95, least_days=10)


@query("""WITH u AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
st AS (SELECT label, d, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY 1, 2), z AS (SELECT label, vec_id, d, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM u JOIN st USING (label, d)),
v AS (SELECT label, vec_id, list(z ORDER BY d) AS z FROM z GROUP BY 1, 2), pr AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_distance(a.z, b.z) AS dist FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY dist, b) AS k FROM pr) WHERE k <= 20), kd AS (SELECT label, a, max(dist) AS kd FROM nn GROUP BY 1, 2),
rd AS (SELECT nn.label, nn.a, 1 / (avg(greatest(nn.dist, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.label = nn.label AND kd.a = nn.b GROUP BY 1, 2),
lf AS (SELECT nn.label, nn.a, avg(o.lrd) / any_value(s.lrd) AS lof FROM nn JOIN rd o ON o.label = nn.label AND o.a = nn.b JOIN rd s ON s.label = nn.label AND s.a = nn.a GROUP BY 1, 2),
th AS (SELECT label, -quantile_cont(-lof, 0.005) AS lim FROM lf GROUP BY 1), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT e.label, e.vec_id, round(lof, 5) AS lof, lof > lim AS is_anomaly, CASE WHEN n <= 20 THEN 'insufficient_rows' ELSE 'ok' END AS status FROM embeddings e JOIN n USING (label) LEFT JOIN lf ON lf.label = e.label AND a = vec_id AND n > 20 LEFT JOIN th ON th.label = e.label AND n > 20""")
def lof_scores(spark, sf):
    got = models.lof(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return got.withColumn("lof", F.round(F.when(~F.isnan("lof"), F.col("lof")), 5))


@query()
def change_points(spark, sf):
    return models.change_points(hourly(spark, sf).select("series_id", "slot", "p"), ["series_id"], "slot", "p")


@query()
def reconstruction_scores(spark, sf):
    f = full(spark, sf).select("series_id", "slot", F.coalesce("p", F.lit(0.0)).alias("p"))
    w = models.window_arrays(f, ["series_id"], "slot", "p", 24, 3).withColumn("is_train", F.col("slot") < TRAIN_END)
    return models.score_windows(w, "series_id", "slot", "values", "is_train")


@query()
def diverse_cases(spark, sf):
    cases = scores(spark, sf).where("is_anomaly").select("model", "series_id", (F.col("slot") * 3600).alias("at"), "raw_score")
    got = evaluate.diverse(cases, "series_id", "at", [-F.col("raw_score"), F.col("series_id"), F.col("at"), F.col("model")], 12)
    return spark.createDataFrame(got, cases.schema)
