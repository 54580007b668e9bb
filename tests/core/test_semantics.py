"""Hand-built frames for the rules that are easy to get wrong."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions import scalars
from wattline.operators import calibrate, clean, contract, detect, evaluate, islands, joins, models, profile, timegrid
from wattline.sources import readers, sinks
from wattline.streaming import online


SHORT = "no_sustained_historical_envelope_exceedance"


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, slot long, v double")


def col(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("slot").collect()]


def test_islands_do_not_bridge_missing_points(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 2, 6, 7, 8)], "series_id string, slot long")
    got = islands.islands(df, ["series_id"], "slot", gap=1, exact=True).groupBy("island").count()
    assert sorted(r["count"] for r in got.collect()) == [1, 1, 3]


def test_gap_counts(spark):
    df = spark.createDataFrame([("a", 0), ("a", 30), ("a", 90), ("a", 2880), ("b", 0)], "series_id string, slot long")
    n = lambda g: islands.islands(df, ["series_id"], "slot", gap=g).select("series_id", "island").distinct().count()
    assert (n(0), n(30)) == (5, 4)


def test_midrank_ties_and_extremes(spark):
    hist = spark.createDataFrame([("a", 0, 0.0), ("a", 0, 2.0)], "series_id string, h long, p double")
    target = spark.createDataFrame([("a", 0, 2 + 1e-10), ("a", 0, 10.0), ("a", 0, None), ("a", 1, 1.0)], "series_id string, h long, p double")
    got = {(r.h, r.p): r.percentile for r in calibrate.same_slot(hist, target, ["series_id"], "h", "p").collect()}
    assert got[0, 2 + 1e-10] == 50 and got[0, 10.0] == 100 and got[0, None] is None and got[1, 1.0] is None


def test_ecdf_flavours(spark):
    df = spark.createDataFrame([("a", 0.0, True), ("a", 1.0, True), ("a", 2.0, True), ("a", 4.0, True), ("a", 1.0, False), ("a", 9.0, False), ("a", None, False), ("b", 1.0, False)], "k string, v double, ref boolean")
    right = {(r.k, r.v): r.percentile for r in calibrate.ecdf(df, ["k"], "v", F.col("ref")).where("NOT ref").collect()}
    assert right == {("a", 1.0): 0.5, ("a", 9.0): 1.0, ("a", None): None, ("b", 1.0): None}
    mid = {(r.k, r.v): r.percentile for r in calibrate.ecdf_mid(df, ["k"], "v", F.col("ref")).where("NOT ref").collect()}
    assert mid[("a", 1.0)] == 37.5 and mid[("a", 9.0)] == 100


def test_fill_policies(spark):
    df = series(spark, [None, 1, None, 3, None, None, 6, None, None, None, 10, None])
    fill = lambda most, how: col(clean.fill(df, ["series_id"], "slot", "v", most, how), "filled")
    assert fill(2, "whole") == [None, 1, 2, 3, 4, 5, 6, None, None, None, 10, None]
    assert fill(1, "inside") == [None, 1, 2, 3, 4, None, 6, 7, None, None, 10, None]
    assert fill(1, "both") == [1, 1, 2, 3, 4, 5, 6, 7, None, 9, 10, 10]
    assert {r.bin for r in clean.long_gap_bins(df, ["series_id"], "slot", "v", 2, 3).collect()} == {2, 3}


def test_dedupe_policies(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 0, 2, 3.0), ("a", 1, 1, 5.0)], "k string, slot long, n long, v double")
    pick = lambda how: col(clean.dedupe(df, ["k", "slot"], [F.col("n")], how, "v"), "v")
    assert (pick("first"), pick("last"), pick("mean")) == ([1, 5], [3, 5], [2, 5])


def test_clock_changes(spark):
    n = lambda d: spark.range(1).select(F.size(timegrid.local_day_slots(d, "Australia/Sydney"))).first()[0]
    assert (n("2026-10-04"), n("2026-04-05"), n("2026-06-01")) == (276, 300, 288)


def test_validity_and_splits(spark):
    df = spark.createDataFrame([("a", 0, i, 1.0 if i < 17 else None) for i in range(24)] + [("a", 1, i, 1.0) for i in range(18)], "k string, day long, h long, v double")
    assert {r.day: r.valid for r in timegrid.valid_days(df, ["k"], "day", "v", 24, 0.75).collect()} == {0: False, 1: True}
    parts = timegrid.four_way(spark.createDataFrame([("a", i) for i in range(11)], "k string, slot long"), "k", "slot", (0.6, 0.15, 0.1))
    assert col(parts, "part") == ["train"] * 6 + ["validation"] + ["calibration"] + ["test"] * 3


def test_global_positions(spark):
    keys = [(i * 7919) % 1000 for i in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert all(r.position == r.k for r in timegrid.global_positions(df, "k", buckets=9).collect())
    assert timegrid.global_positions(df.where("k < 0"), "k").count() == 0


def test_block_scores_population_deviation(spark):
    got = detect.block_scores(series(spark, [2, 4, 9]), ["series_id"], "slot", "v").orderBy("slot").collect()[-1]
    assert (got.max_error, got.mean_error) == (9, 5) and got.error_std == pytest.approx(np.std([2, 4, 9]))


def test_combine_skips_unknown_parts(spark):
    df = spark.createDataFrame([(1, 0.5, float("nan"), 0.999), (2, None, None, None)], "slot long, a double, b double, c double")
    got = df.select("slot", *[c.alias(k) for k, c in detect.combine([F.col("a"), F.col("b"), F.col("c")]).items()]).orderBy("slot").collect()
    assert got[0].max_score == 0.999 and got[0].coverage_ratio == pytest.approx(2 / 3) and got[0].is_anomaly and got[0].score_std == pytest.approx(np.std([0.5, 0.999]))
    assert got[1].max_score is None and not got[1].available and got[1].is_anomaly is False


def test_flatlines_and_freezes(spark):
    df = series(spark, [1] * 5 + [2, 3] + [None] + [3] * 4)
    assert [(r.start, r.end) for r in detect.flatlines(df, ["series_id"], "slot", "v", least=4).orderBy("start").collect()] == [(0, 5), (8, 12)]
    two = df.withColumn("w", F.when(F.col("slot") == 3, 0.0).otherwise(1.0))
    assert [(r.start, r.end) for r in detect.freezes(two, ["series_id"], "slot", ["v", "w"], "v", least=4).collect()] == [(8, 12)]


def test_directions_never_join(spark):
    rows = [("a", i, v, 0.0, 10.0, 1.0, 0.5, 20.0, 99.5, 99.5, True) for i, v in enumerate([30.0, -30.0, 30.0, 30.0, 30.0])]
    df = spark.createDataFrame(rows, "series_id string, slot long, value double, lower double, upper double, effect double, jump double, jump_in double, short double, medium double, current_beyond boolean")
    runs = detect.triage_reasons(detect.direction_runs(df, ["series_id"], "slot"))
    assert [(r.direction, r.start, r.end, r.reasons, r.core) for r in runs.orderBy("start").collect()] == [(1, 0, 1, SHORT, False), (-1, 1, 2, SHORT, False), (1, 2, 5, "", True)]


def test_projection_and_refinement(spark):
    df = series(spark, [0.1, 0.9, 0.2, None, 0.3])
    assert col(islands.project(df, ["series_id"], "slot", "v", 2), "projected") == [0.1, 0.9, 0.9, 0.2, 0.3]
    df = series(spark, [98, 99.6, 97.5, 97, 98, 99.4])
    got = islands.refine(df, ["series_id"], "slot", "v", core=99.5, edge=97.5).collect()
    assert [(r.first_slot, r.last_slot) for r in got] == [(0, 2)]


def test_merge_intervals_touching(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 3), ("a", 10, 12), ("a", 20, 21)], "k string, start long, `end` long")
    units = lambda **h: islands.merge_intervals(df, ["k"], "start", "end", **h).select("unit").distinct().count()
    assert (units(), units(touching=False), units(gap=8)) == (2, 3, 1)


def test_overlap_pairs_once(spark):
    rng = np.random.default_rng(0)
    a = [("k", i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 300, 60), rng.integers(1, 90, 60), strict=True))]
    b = [("k", int(s), int(s + n)) for s, n in zip(rng.integers(0, 300, 40), rng.integers(1, 90, 40), strict=True)]
    x, y = spark.createDataFrame(a, "k string, id long, start long, `end` long"), spark.createDataFrame(b, "k string, b_start long, b_end long")
    want = sorted((i, bs, be) for _, i, s, e in a for _, bs, be in b if s < be and e > bs)
    got = sorted((r.id, r.b_start, r.b_end) for r in joins.overlapping(x, y, ["k"], 16).collect())
    assert got == want
    free = {i for _, i, *_ in a} - {w[0] for w in want}
    assert {r.id for r in joins.without_overlap(x, y, ["k"], 16, "id").collect()} == free


def test_label_propagation(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(45)], "node long")
    got = {r.node: r.unit for r in joins.components(edges, nodes).collect()}
    assert got == {i: 0 if i <= 30 else 40 if i == 41 else i for i in range(45)}


def test_profile_forms_agree_with_direct_distances(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 24)).round(2)
    x[1, 4:10] = 2.0
    x[5, 3:9] = 1.0
    rows = [("s", d, h, float(x[d, h])) for d in range(6) for h in range(24) if (d, h) != (2, 7)]
    df = spark.createDataFrame(rows, "series_id string, day long, h long, p double")
    w = profile.windows(df, ["series_id", "day"], "h", "p", 4, 24)
    got = {(r.day, r.start): r.distance for r in profile.ab_join(w.where("day >= 4"), w.where("day < 4"), "series_id", "day", 4).collect()}
    y = x.copy()
    y[2, 7] = np.nan

    def dist(a, b):
        za, zb = a.std() <= profile.EPSILON, b.std() <= profile.EPSILON
        if za or zb:
            return 0.0 if za and zb else 2.0
        return np.linalg.norm((a - a.mean()) / a.std() - (b - b.mean()) / b.std())

    want = {(d, i): min(dist(y[d, i : i + 4], y[r, j : j + 4]) for r in range(4) for j in range(21) if not np.isnan(y[r, j : j + 4]).any()) for d in (4, 5) for i in range(21)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    fast = profile.profile_arrays(y[4:], y[:4], 4)
    assert all(abs(fast[d - 4, i] - v) < 1e-6 for (d, i), v in want.items())


def test_contract_checks(spark):
    assert contract.missing_columns(spark.createDataFrame([], contract.SCORES)) == []
    row = {"model": "x", "series_id": "a", "max_percentile": 1.5, "mean_percentile": 0.5, "available": True, "calibration_version": "not_frozen_1"}
    df = spark.createDataFrame([{**{f.name: None for f in contract.SCORES}, **row}] * 2, contract.SCORES)
    df = df.withColumns({"interval_start": F.timestamp_seconds(F.lit(60)), "interval_end": F.timestamp_seconds(F.lit(120))})
    got = contract.validate(df, ["lof"]).first()
    assert (got.unknown_model, got.not_frozen, got.wrong_duration, got.off_grid, got.percentile_out_of_range, got.unknown_flag, got.duplicates) == (2, 2, 2, 2, 2, 2, 1)
    blank = spark.createDataFrame([{f.name: None for f in contract.SCORES}], contract.SCORES)
    got = contract.validate(blank, ["lof"]).first()
    assert (got.unknown_model, got.missing_series, got.unreadable_instant, got.not_frozen, got.wrong_duration, got.off_grid) == (1,) * 6
    mp = blank.withColumns({"model": F.lit("matrix_profile"), "data_status": F.lit("observed"), "max_percentile": F.lit(1 + 1e-12), "mean_percentile": F.lit(float("nan"))})
    got = contract.validate(mp, ["matrix_profile"]).first()
    assert (got.unknown_model, got.undisclosed_resampling, got.percentile_out_of_range) == (0, 1, 1)
    assert contract.normalised(mp).first().max_percentile == 1.0 and contract.normalised(mp).first().is_anomaly is False
    assert contract.validate(spark.createDataFrame([], contract.SCORES), ["lof"]).first().duplicates == 0


def test_review_state_precedence(spark):
    t, f, n = True, False, None
    rows = [(0, f, t, t, t, t), (1, t, t, t, t, t), (2, t, f, t, t, t), (3, t, n, f, t, t), (4, t, f, f, f, t), (5, t, f, f, f, f), (6, n, t, t, t, t)]
    df = spark.createDataFrame(rows, "slot long, a boolean, p boolean, q boolean, c boolean, s boolean")
    got = df.select("slot", contract.review_state(*[F.col(x) for x in "apqcs"]).alias("x"))
    assert col(got, "x") == ["unavailable", "priority", "data_quality", "operating_change", "noncore_context", "no_source_event", "unavailable"]


def test_confusion_without_hits(spark):
    got = evaluate.confusion(spark.createDataFrame([(False, False)], "a boolean, b boolean"), [], F.col("a"), F.col("b")).first()
    assert (got.tp, got.tn, got.precision, got.f1) == (0, 1, 0.0, 0.0)


def test_greedy_choice():
    class Rows:
        def __init__(self, rows):
            self.rows = rows

        def limit(self, n):
            return Rows(self.rows[:n])

        def collect(self):
            return self.rows

    rows = [{"d": d, "t": t} for d, t in (("a", 0), ("a", 10), ("a", 99999), ("b", 0), ("a", 200000), ("c", 5))]
    got = evaluate.select_diverse(Rows(rows), "d", "t", 5)
    assert [(r["d"], r["t"]) for r in got] == [("a", 0), ("b", 0), ("c", 5), ("a", 99999), ("a", 200000)]


def test_scalars(spark):
    df = spark.createDataFrame([(" YES ", "1.5", "a_b_3", "[1,2]"), ("no", "junk", "x", "{"), (None, "inf", None, None)], "b string, n string, s string, j string")
    got = df.select(scalars.parse_bool(F.col("b")), scalars.finite(F.col("n")), scalars.device_of(F.col("s")), scalars.channel_of(F.col("s")), scalars.json_length(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [(True, 1.5, "a_b", 3, 2), (False, None, "", None, 0), (False, None, None, None, 0)]
    import hashlib

    x = spark.createDataFrame([("k",)], "k string").select(scalars.stable_number(F.col("k")), scalars.event_id(F.col("k"), F.lit(5), prefix="quality")).first()
    assert int(x[0]) == int(hashlib.sha256(b"k").hexdigest()[:16], 16) and x[1] == hashlib.sha1(b"quality|k|5").hexdigest()[:16]


def test_robust_pca_separates(spark):
    rng = np.random.default_rng(0)
    low = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 24))
    sparse = np.zeros_like(low)
    at = rng.choice(low.size, 40, replace=False)
    sparse.ravel()[at] = 10
    a, b = models.robust_pca(low + sparse)
    assert np.linalg.norm(a - low) / np.linalg.norm(low) < 1e-3 and np.allclose(a + b, low + sparse, atol=1e-4)
    days = [("s", d, (low[d] + (8 if d == 39 else 0) * np.eye(24)[3]).tolist(), d < 30) for d in range(40)]
    got = models.rpca_scores(spark.createDataFrame(days, "series_id string, day long, values array<double>, is_train boolean")).orderBy("day").collect()
    assert got[39].is_anomaly and sum(bool(r.is_anomaly) for r in got[30:39]) <= 2 and got[0].status == "ok"


def test_lof_against_direct_computation(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 3)), [[9, 9, 9]]])
    got = models.lof(spark.createDataFrame([("g", i, r.tolist()) for i, r in enumerate(x)] + [("h", 0, [1.0, 2.0, 3.0])], "g string, id long, f array<double>"), "g", "id", "f", k=5, contamination=0.02).collect()
    z = (x - x.mean(0)) / x.std(0)
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    kd = np.sort(d, axis=1)[:, 4]
    lrd = np.array([1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(len(x))])
    want = np.array([lrd[near[i]].mean() / lrd[i] for i in range(len(x))])
    by = {r.id: r for r in got if r.g == "g"}
    assert np.allclose([by[i].lof for i in range(len(x))], want) and by[60].is_anomaly
    assert [r.status for r in got if r.g == "h"] == ["insufficient_rows"]


def test_change_points_equal_exhaustive_search(spark):
    rng = np.random.default_rng(2)
    for n in (14, 20, 25):
        x = np.concatenate([rng.normal(0, 1, n // 2), rng.normal(4, 1, n - n // 2)])
        pen = 2.0

        def cost(cuts):
            e = [0, *cuts, len(x)]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(e, e[1:])) + pen * len(cuts)

        options = [[]] + [[a] for a in range(3, n - 2)] + [[a, b] for a in range(3, n - 2) for b in range(a + 3, n - 2)] + [[a, b, c] for a in range(3, n - 2) for b in range(a + 3, n - 2) for c in range(b + 3, n - 2)]
        assert cost(models.best_cuts(x, 3, pen)) <= min(map(cost, options)) + 1e-9
    step = series(spark, [1.0, 1.1] * 20 + [None] + [5.0, 5.1] * 6)
    got = models.change_points(step, ["series_id"], "slot", "v").collect()
    assert [(r.slot, round(r.shift)) for r in got] == [(40, 4)]
    assert models.change_points(series(spark, [1.0, 1.1] * 10 + [5.0, 5.1] * 10), ["series_id"], "slot", "v").collect() == []


def test_scorer_on_windows(spark):
    f = series(spark, [np.sin(i / 4) for i in range(200)] + [9.0] + [np.sin(i / 4) for i in range(201, 240)])
    w = models.window_arrays(f, ["series_id"], "slot", "v", 24, 3).withColumn("is_train", F.col("slot") < 190)
    got = models.score_windows(w, "series_id", "slot", "values", "is_train").orderBy(F.desc("max_score")).first()
    assert 200 <= got.slot <= 223


HEAD = ",".join(["timestamp", *readers.MEASUREMENTS])


def csv(*stamps):
    return "\n".join([HEAD, *(f"{s},{','.join(['1.0'] * 11)}" for s in stamps)])


def test_day_folders_and_archives(spark, tmp_path):
    for day, stamps in (("01_02_2024", ["2024-02-01T00:00:00Z", "junk"]), ("02_02_2024", ["2024-01-31T23:55:00Z", "2024-02-01T00:00:00Z", "2024-02-02T00:05:00Z"])):
        (tmp_path / "raw" / day).mkdir(parents=True)
        (tmp_path / "raw" / day / "dev_1.csv").write_text(csv(*stamps))
    rows = readers.day_folders(spark, str(tmp_path / "raw"))
    got = readers.merged(rows).collect()
    assert len(got) == 2 and {r.series_id for r in got} == {"dev_1"} and {str(r.folder_date) for r in got} == {"2024-02-01", "2024-02-02"}
    m = readers.merge_manifest(rows).first()
    assert (m.n_rows, m.n_bad_timestamp_rows_dropped, m.n_days_present, m.n_days_missing) == (4, 1, 3, 0)
    arch = tmp_path / "arch"
    arch.mkdir()
    with zipfile.ZipFile(arch / "a.zip", "w") as z:
        z.writestr("x/01_02_2024/dev_1.csv", csv("2024-02-01T00:00:00Z"))
    with tarfile.open(arch / "b.tgz", "w:gz") as t:
        data = csv("2024-02-02T00:00:00Z").encode()
        info = tarfile.TarInfo("02_02_2024/dev_2.csv")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    assert sorted((r.series_id, str(r.folder_date)) for r in readers.archives(spark, str(arch)).collect()) == [("dev_1", "2024-02-01"), ("dev_2", "2024-02-02")]
    with pytest.raises(ValueError):
        list(readers.archive_members("x.rar", b""))


def test_workflow_rules(spark):
    from wattline.operators import workflow

    assert workflow.Profile(0, 10, 10, 12, 20).problems() == [] and len(workflow.Profile(0, 10, 5, 12, 20, 4, 9).problems()) == 2
    base = spark.createDataFrame([("a", i) for i in range(9)], "k string, slot long")
    got = workflow.scoring_frame(base.where("slot < 6"), base.where("slot >= 6"), ["k"], "slot", 2)
    assert [(r.slot, r.split) for r in got.orderBy("slot").collect()] == [(4, "baseline"), (5, "baseline"), (6, "test"), (7, "test"), (8, "test")]
    q = spark.createDataFrame([("a", 0, 10)], "k string, start long, `end` long")
    b = spark.createDataFrame([("a", "x", 9, 12), ("a", "y", 10, 12)], "k string, event_id string, start long, `end` long")
    kinds = workflow.compose_events(q, b, ["k"], 4).collect()
    assert sorted((r.kind, r.event_id) for r in kinds if r.event_id) == [("behaviour", "y")] and len(kinds) == 2
    d = spark.createDataFrame([("a", 1), ("a", 2)], "k string, day long")
    p = spark.createDataFrame([("a", 1, 5, 1.0), ("a", 1, 6, 3.0), ("a", 1, 9, 2.0)], "k string, day long, slot long, score double")
    runs = workflow.anomalous_days(d, p, ["k"], "day", "slot", gap=1).collect()
    assert sorted((r.day, r.start or -1, r.n_points or 0) for r in runs) == [(1, 5, 2), (1, 9, 1), (2, -1, 0)]
    roll = {r.day: (r.n_points, r.max_score) for r in workflow.day_rollup(d, p, ["k"], "day", "slot").collect()}
    assert roll == {1: (3, 3.0), 2: (0, None)}
    g = spark.createDataFrame([("s", 1, True), ("s", 90, True), ("t", 1, True), ("u", 100, True)], "k string, slot long, real boolean")
    gates = {r.k: r.gate for r in workflow.stale_gate(g, "k", "slot", F.col("real"), 50, most=30, train_least=1, test_least=1).collect()}
    assert gates == {"s": "stale_baseline", "t": "no_test_rows", "u": "stale_baseline"}
    with pytest.raises(ValueError, match="differ"):
        workflow.required(d, p)


def test_metadata_mappings(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"d1": {"organization": "o", "channels": [{"id": "d1_C10", "category_id": 3, "category_name": "solar", "metadata": {"rated_power": 5.0}}, {"id": "d1_C2", "category_id": null}]}}')
    meta = readers.channel_metadata(spark, str(tmp_path / "m.json"))
    got = {r.id: (r.position, r.file_index, r.rated_power) for r in readers.rank_mapping(meta).collect()}
    assert got == {"d1_C10": (0, 1, 5.0), "d1_C2": (1, 0, None)}
    man = spark.createDataFrame([("d1", 0), ("d1", 1), ("d1", 7)], "device string, channel int")
    assert {r.channel: r.status for r in readers.discover(man, meta).collect()} == {0: "ready", 1: "category_missing", 7: "metadata_missing"}


def test_scores_union_status_and_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, w double")
    assert sorted(map(tuple, readers.union_scores([a, b], ["k"]).select("k", "v", "w").collect())) == [(1, "x", None), (2, None, 3.0)]
    h, t = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "k string, at long, v double"), spark.createDataFrame([("a", 1, 9.0), ("c", 2, 1.0)], "k string, at long, v double")
    rows, status = readers.history_and_test(h, t, "k", "at")
    assert {r.k: r.v for r in rows.collect()}["a"] == 9.0 and {r.k: r.status for r in status.collect()} == {"a": "ok", "b": "no_test_data", "c": "no_history"}
    sinks.write_set({"t": a}, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_new(a, str(tmp_path / "out/t"))
    back = spark.read.parquet(str(tmp_path / "out/t"))
    assert sinks.same_rows(a, back) and len(sinks.signature({"x": 1}, back).first().signature) == 64
    (tmp_path / "s").mkdir()
    blank = spark.createDataFrame([{f.name: None for f in contract.SCORES} | {"model": "m", "available": True}], contract.SCORES)
    blank.write.parquet(str(tmp_path / "s" / "one_scores_15min.parquet"))
    assert readers.score_files(spark, str(tmp_path / "s")).count() == 1


def test_streams_equal_batch(spark, tmp_path):
    pts = spark.createDataFrame([("a", s, float(s % 7), s % 7 == 3) for s in range(0, 7200, 300)] + [("a", 90000, 0.0, False)], "series_id string, s long, score double, is_anomaly boolean").withColumn("ts", F.timestamp_seconds("s"))
    pts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    bins = online.frozen_bins(pts, "score", 4)
    for name, make in (("scores", online.interval_scores), ("sess", lambda p: online.sessions(p.where("is_anomaly OR s = 90000")))):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        cut = F.col("interval_start" if name == "scores" else "start") < F.timestamp_seconds(F.lit(80000))
        assert sorted(map(str, spark.table(name).where(cut).collect())) == sorted(map(str, make(pts).where(cut).collect())) != []
    q = online.with_frozen_percentile(stream, bins).writeStream.format("memory").queryName("pct").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pct").count() == pts.count() and spark.table("pct").where("percentile IS NULL").count() == 0
