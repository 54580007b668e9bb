"""Queries on preparation, exporters, detector runs, review cases and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import contract, detect, evaluate, islands, joins, timegrid, workflow
from wattline.plans.fixtures import EVENTS, FIRST, FULL, H, LAST, MODELS, PER_DAY, SCORES, TRAIN_END, full, hourly, scores, table, with_day
from wattline.plans.registry import query, r6, rounded
from wattline.plans.relations import _BAND, _CONF, _FROM, _WIN, _banded, _days, _events
from wattline.plans.series import _FLAT

_TD = TRAIN_END // PER_DAY
_FIRSTDAY, _LASTDAY = FIRST // PER_DAY, LAST // PER_DAY


@query("SELECT user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-25' AND user_id IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-29' AND CAST(ts AS DATE) < DATE '2024-01-31') GROUP BY 1")
def clip_and_require(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    got = workflow.clip_and_require(ev, "user_id", "day", F.lit("2024-01-25").cast("date"), F.lit("2024-01-29").cast("date"), F.lit("2024-01-31").cast("date"))
    return got.groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {FULL} SELECT series_id, CASE WHEN slot < {TRAIN_END} THEN 'baseline' ELSE 'test' END AS role, count(*) AS n_rows, count(p) AS n_known, count(DISTINCT day) AS n_days FROM f GROUP BY 1, 2")
def coverage_manifest(spark, sf):
    f = full(spark, sf).withColumn("role", F.when(F.col("slot") < TRAIN_END, "baseline").otherwise("test"))
    return workflow.coverage_manifest(f, "series_id", "role", "day", "p")


@query(f"WITH {FULL} SELECT series_id, day, CASE WHEN count(*) <> 24 THEN 'dst_transition' WHEN count(p) < 23 THEN 'low_coverage' ELSE 'ready' END AS status FROM f GROUP BY 1, 2")
def rolling_day_status(spark, sf):
    d = full(spark, sf).groupBy("series_id", "day").agg(F.count("*").alias("n_slots"), F.count("p").alias("n_known"))
    return workflow.day_status(d, per_day=PER_DAY, ratio=0.95).select("series_id", "day", "status")


@query(f"WITH s AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, CAST(d.day AS BIGINT) AS day FROM s, range({_FIRSTDAY}, {_LASTDAY}) d(day)), e AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events GROUP BY 1, 2) SELECT g.user_id, g.day, CASE WHEN e.day IS NULL THEN 'no_data' ELSE 'detected' END AS status FROM g LEFT JOIN e USING (user_id, day)")
def status_backfill(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.floor(timegrid.epoch(F.col("ts")) / 86400).cast("long").alias("day")).distinct()
    return workflow.backfill_status(ev.withColumn("status", F.lit("detected")), ev, "user_id", _FIRSTDAY, _LASTDAY)


@query(f"WITH {FULL}, x AS (SELECT CASE WHEN series_id IN ('click', 'view') THEN 'm1' ELSE 'm2' END AS meter, * FROM f), n AS (SELECT meter, count(DISTINCT series_id) AS c FROM x GROUP BY 1) SELECT x.meter, day, CAST(count(p) AS BIGINT) AS n_values, round(sum(p), 4) AS total FROM x JOIN n USING (meter) GROUP BY x.meter, day, c HAVING count(p) = c * 24")
def meter_day_tensor(spark, sf):
    x = full(spark, sf).withColumn("meter", F.when(F.col("series_id").isin("click", "view"), "m1").otherwise("m2"))
    got = workflow.meter_days(x, "meter", "series_id", "day", "h", "p", PER_DAY)
    return got.select("meter", "day", F.size("values").cast("long").alias("n_values"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"WITH {H}, b AS (SELECT series_id, slot, 'baseline' AS split, row_number() OVER (PARTITION BY series_id ORDER BY slot DESC) AS k FROM h WHERE slot < {TRAIN_END}) SELECT series_id, slot, split FROM b WHERE k <= 21 UNION ALL SELECT series_id, slot, 'test' FROM h WHERE slot >= {TRAIN_END}")
def scoring_frame(spark, sf):
    h = hourly(spark, sf).select("series_id", "slot")
    return workflow.scoring_frame(h.where(F.col("slot") < TRAIN_END), h.where(F.col("slot") >= TRAIN_END), ["series_id"], "slot", 21)


@query(f"""WITH x AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, value FROM events), a AS (SELECT user_id, max(CASE WHEN value > 20 AND slot < {TRAIN_END} THEN slot END) AS last_real, count(*) FILTER (WHERE slot < {TRAIN_END}) AS n_train, count(*) FILTER (WHERE slot >= {TRAIN_END}) AS n_test FROM x GROUP BY 1)
SELECT user_id, last_real, n_train, n_test, CASE WHEN n_test = 0 THEN 'no_test_rows' WHEN last_real IS NULL OR {TRAIN_END} - last_real > 24 THEN 'stale_baseline' WHEN n_train < 40 OR n_test < 15 THEN 'too_few_windows' ELSE 'scored' END AS gate FROM a""")
def stale_baseline_gate(spark, sf):
    x = table(spark, sf, "events").select("user_id", timegrid.slot_of(F.col("ts"), 60).alias("slot"), "value")
    return workflow.stale_gate(x, "user_id", "slot", F.col("value") > 20, TRAIN_END, most=24, train_least=40, test_least=15)


@query(f"""WITH {FULL}, w AS (SELECT series_id, slot, imax, count(p) OVER w AS n, count(*) OVER w AS s FROM f WINDOW w AS (PARTITION BY series_id ORDER BY slot ROWS 2 PRECEDING)),
d AS (SELECT *, CASE WHEN s < 3 THEN 'insufficient_history' WHEN n = 3 THEN 'observed' WHEN n > 0 THEN 'interpolated' ELSE 'missing_data' END AS data_status FROM w)
SELECT series_id, slot, round(n / 3, 6) AS coverage_ratio, data_status, data_status IN ('observed', 'interpolated') AS available, round(CASE WHEN data_status IN ('observed', 'interpolated') THEN imax END, 6) AS score FROM d""")
def prediction_frame(spark, sf):
    got = workflow.prediction_frame(full(spark, sf).withColumn("score", F.col("imax")), ["series_id"], "slot", "p", "score")
    return rounded(got.select("series_id", "slot", "coverage_ratio", "data_status", "available", "score"), "coverage_ratio", "score")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE k <= 50")
def reservoir_sample(spark, sf):
    return workflow.reservoir(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id", 50, 7)


_DAYS = f"""{FULL}, dy AS (SELECT series_id, day FROM f WHERE slot >= {TRAIN_END} GROUP BY 1, 2 HAVING max(imax) > 180), pt AS (SELECT series_id, day, slot, imax AS score FROM f WHERE imax > 200)"""


def _day_points(spark, sf):
    f = full(spark, sf)
    days = f.where(F.col("slot") >= TRAIN_END).groupBy("series_id", "day").agg(F.max("imax").alias("m")).where("m > 180").select("series_id", "day")
    return days, f.where("imax > 200").select("series_id", "day", "slot", F.col("imax").alias("score"))


@query(f"""WITH {_DAYS}, fl AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY series_id, day ORDER BY slot) <= 1 THEN 0 ELSE 1 END AS nw FROM pt), il AS (SELECT *, sum(nw) OVER (PARTITION BY series_id, day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM fl),
r AS (SELECT series_id, day, min(slot) AS start, max(slot) + 1 AS "end", max(score) AS max_score, count(*) AS n_points FROM il GROUP BY series_id, day, island) SELECT dy.series_id, dy.day, start, "end", round(max_score, 6) AS max_score, n_points FROM dy LEFT JOIN r USING (series_id, day)""")
def strict_day_events(spark, sf):
    days, points = _day_points(spark, sf)
    return rounded(workflow.anomalous_days(days, points, ["series_id"], "day", "slot", gap=1), "max_score")


@query(f"WITH {_DAYS} SELECT dy.series_id, dy.day, min(slot) AS first_slot, max(slot) AS last_slot, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, count(slot) AS n_points FROM dy LEFT JOIN pt USING (series_id, day) GROUP BY 1, 2")
def anomalies_by_date(spark, sf):
    days, points = _day_points(spark, sf)
    return rounded(workflow.day_rollup(days, points, ["series_id"], "day", "slot"), "max_score", "mean_score")


@query(f"""WITH {_WIN}, rf AS (SELECT * FROM z WHERE day < {_FROM}),
a AS (SELECT q.series_id, q.day, q.start, q.day >= {_FROM} AS tgt, sqrt(greatest(8 - 2 * sum(q.z * r.z), 0)) AS d FROM z q JOIN rf r ON q.series_id = r.series_id AND q.o = r.o AND q.day <> r.day GROUP BY q.series_id, q.day, q.start, r.day, r.start),
m AS (SELECT series_id, day, start, tgt, round(min(d), 4) AS d FROM a GROUP BY 1, 2, 3, 4), pc AS (SELECT t.series_id, t.day, t.start, (count(*) FILTER (WHERE b.d < t.d) + 0.5 * count(*) FILTER (WHERE b.d = t.d)) / count(*) * 100 AS pct FROM m t JOIN m b ON NOT b.tgt AND b.series_id = t.series_id WHERE t.tgt GROUP BY 1, 2, 3)
SELECT series_id, day, start + k AS h, round(max(pct), 1) AS scale_4 FROM pc, (SELECT CAST(k AS BIGINT) AS k FROM range(4) t(k)) GROUP BY 1, 2, 3""")
def day_scores(spark, sf):
    from wattline.operators import calibrate, profile

    d = _days(spark, sf)
    base = profile.ab_join_arrays(d.where("NOT q").withColumn("q", F.lit(True)), "series_id", "day", "v", "q", 4, leave_own_day_out=True).withColumn("is_ref", F.lit(True))
    got = profile.ab_join_arrays(d, "series_id", "day", "v", "q", 4).withColumn("is_ref", F.lit(False))
    ranked = calibrate.ecdf_mid(rounded4(base.unionByName(got)), ["series_id"], "distance", F.col("is_ref")).where("NOT is_ref")
    slots = ranked.select("series_id", "day", F.explode(F.sequence(F.col("start"), F.col("start") + 3)).alias("h"), "percentile")
    return slots.groupBy("series_id", "day", "h").agg(F.round(F.max("percentile"), 1).alias("scale_4"))


def rounded4(df):
    return df.withColumn("distance", F.round("distance", 4))


@query()
def detector_scales(spark, sf):
    f = full(spark, sf)
    return workflow.day_profile_scores(f.where(F.col("slot") < TRAIN_END), f.where(F.col("slot") >= TRAIN_END), "series_id", "day", "h", "p", (4, 6), PER_DAY)


@query("""SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS category, CASE WHEN s_nationkey NOT IN (0, 1, 2, 3, 4, 5, 6, 7) THEN 'unsupported_category' WHEN s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'unavailable' ELSE 'ready' END AS status FROM supplier""")
def inference_preflight(spark, sf):
    ch = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("category"))
    pk = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("category"))
    return workflow.preflight(ch, pk, range(8)).select("s_suppkey", "category", "status")


@query(f"""WITH {H}, c AS (SELECT series_id, slot AS at FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY imax DESC, slot) AS k FROM h) WHERE k <= 3) SELECT c.series_id, c.at, h.slot, h.slot - c.at AS "offset", round(h.p, 6) AS p FROM c JOIN h ON h.series_id = c.series_id AND h.slot BETWEEN c.at - 24 AND c.at + 24""")
def case_timeline(spark, sf):
    h = hourly(spark, sf).select("series_id", "slot", "p", "imax")
    top = evaluate.hash_sample(h, ["series_id"], "slot", 3, first=[F.desc("imax"), F.col("slot")]).select("series_id", F.col("slot").alias("at"))
    return workflow.case_rows(top, h, "series_id", "slot", 24).select("series_id", "at", "slot", "offset", *r6("p"))


@query(f"""WITH {SCORES} SELECT series_id, slot, string_agg(model, '|' ORDER BY model) AS available_models, coalesce(string_agg(model, '|' ORDER BY model) FILTER (WHERE is_anomaly), '') AS flagged_models, round(sum(max_percentile), 6) AS priority, substr(sha256(concat_ws('|', series_id, CAST(slot AS VARCHAR))), 1, 16) AS tie FROM sc GROUP BY 1, 2""")
def review_candidates(spark, sf):
    return rounded(workflow.candidates(scores(spark, sf), ["series_id", "slot"], ["series_id", "slot"]), "priority")


@query(f"WITH {SCORES} SELECT model, count(*) FILTER (WHERE model = 'mp') AS n_wrong FROM sc GROUP BY 1")
def calibration_check(spark, sf):
    s = scores(spark, sf).withColumn("calibration_version", F.concat(F.col("model"), F.lit("-2024")))
    return workflow.calibration_matches(s, {"lof": "lof-", "mp": "other-", "rpca": "rpca-"})


@query(f"""WITH {EVENTS} SELECT CASE WHEN n > 1 THEN 'priority_alert' ELSE 'operating_change_review' END AS queue, count(*) AS n_events FROM ev GROUP BY 1""")
def queue_counts(spark, sf):
    e = _events(spark, sf)
    q = detect.queue(F.lit("behaviour"), F.lit(True), F.col("interval_count") > 1)
    counts, _ = workflow.queue_export(e.select(F.lit("x").alias("event_id"), q.alias("queue"), F.lit("[]").alias("segments")))
    return counts


@query(f"""WITH {EVENTS} SELECT model, series_id, start, "end", start + s.k AS core_start, start + s.k + 1 AS core_end FROM ev, (SELECT CAST(k AS BIGINT) AS k FROM range(2) t(k)) s WHERE n > 1""")
def priority_segments(spark, sf):
    e = _events(spark, sf).where("interval_count > 1")
    seg = F.to_json(F.array(*[F.struct((F.col("start") + k).alias("start"), (F.col("start") + k + 1).alias("end")) for k in (0, 1)]))
    _, cores = workflow.queue_export(e.select(F.concat_ws("/", "model", "series_id", "start", "end").alias("event_id"), F.lit("priority").alias("queue"), seg.alias("segments")))
    part = F.split("event_id", "/")
    return cores.select(part[0].alias("model"), part[1].alias("series_id"), part[2].cast("long").alias("start"), part[3].cast("long").alias("end"), F.col("start").alias("core_start"), F.col("end").alias("core_end"))


@query(_FLAT + f""", bv AS (SELECT series_id, slot // 12 AS event_id, min(slot) AS start, min(slot) + 6 AS "end" FROM f WHERE imax > 180 GROUP BY 1, 2)
SELECT series_id, start, "end", 'quality' AS kind FROM fr UNION ALL SELECT series_id, start, "end", 'behaviour' FROM bv WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.series_id = bv.series_id AND bv.start < fr."end" AND bv."end" > fr.start)""")
def composed_events(spark, sf):
    f = full(spark, sf)
    quality = detect.flatlines(f.withColumn("v", F.round(F.col("p") / 40)), ["series_id"], "slot", "v", least=4).select("series_id", "start", "end")
    bv = f.where("imax > 180").groupBy("series_id", F.floor(F.col("slot") / 12).cast("long").alias("event_id")).agg(F.min("slot").alias("start"), (F.min("slot") + 6).alias("end"))
    return workflow.compose_events(quality, bv, ["series_id"], 24).select("series_id", "start", "end", "kind")


@query(_FLAT + f""", hs AS (SELECT series_id, h, day, round(p / 40) AS v FROM f WHERE slot < {TRAIN_END} AND p IS NOT NULL), sl AS (SELECT series_id, start, "end", level, n, (start + k) % 24 AS h FROM fr, range(60) t(k) WHERE start + k < "end"),
pd AS (SELECT sl.series_id, start, "end", level, n, day, max(v) - min(v) AS r, avg(abs(v)) AS l FROM sl JOIN hs ON hs.series_id = sl.series_id AND hs.h = sl.h GROUP BY ALL), md AS (SELECT series_id, start, "end", level, n, median(r) AS usual_range, median(l) AS usual_level FROM pd GROUP BY 1, 2, 3, 4, 5)
SELECT series_id, start, "end", n, round(usual_range, 6) AS usual_range FROM md WHERE usual_range > 0.05 AND NOT (abs(level) <= 0.05 AND usual_level <= 0.05)""")
def flatline_events(spark, sf):
    f = full(spark, sf).withColumn("v", F.round(F.col("p") / 40))
    flat = detect.flatlines(f, ["series_id"], "slot", "v", least=4)
    hist = f.where((F.col("slot") < TRAIN_END) & F.col("v").isNotNull()).select("series_id", F.col("h").alias("slot"), "day", "v")
    return rounded(detect.flatline_events(flat, hist, ["series_id"], "v", PER_DAY), "usual_range").select("series_id", "start", "end", "n", "usual_range")


@query(f"""WITH {_BAND}, j AS (SELECT *, greatest(p - upper, lower - p) AS excess, coalesce(jump_in > 30, FALSE) OR coalesce(lag(jump_in) OVER (PARTITION BY series_id ORDER BY slot) > 30, FALSE) AS near FROM bb), ht AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY series_id ORDER BY slot) <= 1 THEN 0 ELSE 1 END AS nw FROM j WHERE excess > effect AND support >= 6),
i AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM ht),
r AS (SELECT series_id, min(slot) AS start, max(slot) + 1 AS "end", max(excess) AS peak, first(effect) AS effect, arg_min(near, slot) AS near, avg(CASE WHEN imax > 150 THEN 1.0 ELSE 0.0 END) AS share FROM i GROUP BY series_id, island),
lg AS (SELECT DISTINCT series_id, slot + k AS s FROM bb, range(2) t(k) WHERE imax > 200)
SELECT series_id, start, "end", round(peak, 6) AS peak, round(share, 6) AS current_share FROM r WHERE peak > 2 * effect AND near AND EXISTS (SELECT 1 FROM range({TRAIN_END}, {LAST}) q(s) WHERE q.s >= r.start AND q.s < r."end" AND NOT EXISTS (SELECT 1 FROM lg WHERE lg.series_id = r.series_id AND lg.s = q.s))""")
def magnitude_events(spark, sf):
    b = _banded(spark, sf).withColumns({"percentile": F.lit(100.0), "quality": F.lit(False), "jump": F.lit(30.0), "current_beyond": F.coalesce(F.col("imax") > 150, F.lit(False))})
    legacy = b.where("imax > 200").select("series_id", F.col("slot").alias("start"), (F.col("slot") + 2).alias("end"))
    return rounded(workflow.magnitude_events(b, ["series_id"], "slot", "transition_guarded", legacy, 24, least=1).select("series_id", "start", "end", "peak", "current_share"), "peak", "current_share")


@query(f"WITH {H} SELECT series_id, slot, round(CASE WHEN n >= 4 THEN imax * 2 ELSE p END, 6) AS p, n >= 4 AS is_injected FROM h")
def localized_replay(spark, sf):
    h = hourly(spark, sf)
    edits = h.where("n >= 4").select("series_id", "slot", (F.col("imax") * 2).alias("p"))
    return rounded(workflow.replay(h.select("series_id", "slot", "p"), edits, ["series_id", "slot"], "p"), "p")


@query(f"""WITH {SCORES}, v AS (SELECT series_id, slot, sum(CAST(is_anomaly AS INT)) AS k FROM sc GROUP BY 1, 2), s AS (SELECT v.*, h.n >= 4 AS truth FROM v JOIN h USING (series_id, slot)), st AS (SELECT 'any' AS strategy, k >= 1 AS f, truth FROM s UNION ALL SELECT 'two', k >= 2, truth FROM s UNION ALL SELECT 'all', k = 3, truth FROM s)
SELECT strategy, {_CONF.format(f='f', t='truth')} FROM st GROUP BY 1""")
def vote_evaluation(spark, sf):
    v = evaluate.votes(scores(spark, sf), ["series_id", "slot"], MODELS).join(hourly(spark, sf).select("series_id", "slot", (F.col("n") >= 4).alias("truth")), ["series_id", "slot"])
    long = v.select("truth", F.explode(F.map_from_arrays(F.array(F.lit("any"), F.lit("two"), F.lit("all")), F.array("any", "two", "all"))).alias("strategy", "f"))
    return evaluate.confusion(long, ["strategy"], F.col("f"), F.col("truth")).select("strategy", "tp", "fp", "fn", "tn")


@query(f"""WITH {SCORES}, d AS (SELECT sc.*, o.raw_score - 2 AS original FROM sc JOIN (SELECT series_id, slot, raw_score FROM sc WHERE model = 'mp') o USING (series_id, slot)) SELECT model, count(*) AS n, count(*) FILTER (WHERE abs(raw_score - original) > 1e-4) AS n_injected, round(sum(raw_score) / sum(abs(original)), 4) AS amplification FROM d GROUP BY 1""")
def paired_injection(spark, sf):
    s = scores(spark, sf)
    o = s.where("model = 'mp'").select("series_id", "slot", (F.col("raw_score") - 2).alias("original"))
    return s.join(o, ["series_id", "slot"]).groupBy("model").agg(F.count("*").alias("n"), F.count_if(evaluate.injected(F.col("raw_score"), F.col("original"))).alias("n_injected"), F.round(F.sum("raw_score") / F.sum(F.abs("original")), 4).alias("amplification"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def uniqueness_violations(spark, sf):
    return workflow.unique_violations(table(spark, sf, "orders"), ["o_custkey"]).withColumnRenamed("count", "n")


@query(f"WITH {H} SELECT series_id, slot, round(pow(p - lag(p) OVER (PARTITION BY series_id ORDER BY slot), 2), 6) AS error, round(avg(pow(p - (SELECT avg(p) FROM h), 2)) OVER (PARTITION BY series_id), 4) AS mse FROM h")
def reconstruction_mse(spark, sf):
    from pyspark.sql import Window

    h = hourly(spark, sf)
    m = h.agg(F.avg("p").alias("m"))
    w = Window.partitionBy("series_id")
    x = h.crossJoin(F.broadcast(m))
    return x.select("series_id", "slot", F.round(F.pow(F.col("p") - F.lag("p").over(w.orderBy("slot")), 2), 6).alias("error"), F.round(F.avg(F.pow(F.col("p") - F.col("m"), 2)).over(w), 4).alias("mse"))
