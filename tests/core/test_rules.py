"""Rules of readers, sinks, triage, votes and frozen scorers, against brute force where there is any."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions import scalars
from wattline.operators import contract, detect, evaluate, joins, models, profile, triage, workflow
from wattline.sources import readers, sinks


def test_votes_of_absent_models(spark):
    rows = [(1, "a", True), (2, "a", True), (2, "b", True), (2, "c", True), (3, "a", None), (4, "x", True), (5, "a", True), (5, "b", True)]
    got = {r.k: (r["any"], r.two, r["all"]) for r in evaluate.votes(spark.createDataFrame(rows, "k long, model string, is_anomaly boolean"), ["k"], ["a", "b", "c"]).collect()}
    assert got == {1: (True, False, False), 2: (True, True, True), 3: (False,) * 3, 4: (False,) * 3, 5: (True, True, False)}


def test_flags_labels_and_instants(spark):
    df = spark.createDataFrame([("True",), (" no ",), ("",), (None,), ("maybe",)], "x string")
    assert [r[0] for r in df.select(scalars.review_flag(F.col("x"))).collect()] == [True, False, None, None, None]
    named = spark.createDataFrame([(3, "solar"), (None, "solar"), (3, None), (None, None)], "n int, x string")
    assert [r[0] for r in named.select(scalars.category_label(F.col("n"), F.col("x"))).collect()] == ["solar (3)", "solar", "category 3", "uncategorised"]
    at = spark.createDataFrame([(0,), (1_688_000_000,)], "s long").select(scalars.iso_format(F.timestamp_seconds("s"), "Europe/Berlin"))
    assert [r[0] for r in at.collect()] == ["1970-01-01T01:00:00+01:00", "2023-06-29T02:53:20+02:00"]


def test_target_index_and_merge_order(spark, tmp_path):
    for day in ("01_02_2024", "02_02_2024"):
        (tmp_path / "d" / day).mkdir(parents=True)
    head = "timestamp," + ",".join(readers.MEASUREMENTS) + "\n"
    line = lambda at, x: f"{at},{x}" + "," * (len(readers.MEASUREMENTS) - 1) + "\n"
    (tmp_path / "d/01_02_2024/c1.csv").write_text(head + line("2024-02-01 00:00:00", 9) + line("2024-02-01 00:00:00", 1))
    (tmp_path / "d/02_02_2024/c1.csv").write_text(head + line("2024-02-01 00:00:00", 5) + line("2024-02-02 00:00:00", 7))
    rows = readers.day_folders(spark, str(tmp_path / "d"))
    got = readers.index_target(rows, "2024-02-01", "2024-02-03").collect()
    assert sorted((r.series_id, str(r.folder_date)) for r in got) == [("c1", "2024-02-01"), ("c1", "2024-02-02")]
    kept = readers.merged(rows).orderBy("timestamp").collect()
    assert [r.powerFactor for r in kept] == [9.0, 7.0]
    (tmp_path / "d/again/02_02_2024").mkdir(parents=True)
    (tmp_path / "d/again/02_02_2024/c1.csv").write_text(head)
    (tmp_path / "d/again/02_02_2024/c1.csv").write_text(head + line("2024-02-02 01:00:00", 2))
    with pytest.raises(ValueError, match="more than one file"):
        readers.index_target(readers.day_folders(spark, str(tmp_path / "d")), "2024-02-01", "2024-02-03")


def test_archives_skip_other_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("01_02_2024/c7.csv", "timestamp,vRMSMin\n2024-02-01 00:00:00,3\n2024-02-01 00:05:00,4\n")
    (tmp_path / "notes.txt").write_text("x")
    got = readers.archives(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.series_id, r.vRMSMin, r.position) for r in got] == [("c7", 3.0, 0), ("c7", 4.0, 1)] and got[0].powerFactor is None
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n")
    with pytest.raises(Exception, match="no timestamp column"):
        readers.archives(spark, str(tmp_path)).collect()


def test_inventory_training_input_and_reviews(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "dev1_3.csv").write_text("a\n1\n")
    got = readers.source_inventory(spark, str(tmp_path / "in")).first()
    assert got.series_id == "dev1_3" and got.n_bytes == 4
    assert readers.source_inventory(spark, str(tmp_path / "in"), r"/(?P<series_id>dev\d+)_\d+\.csv$").first().series_id == "dev1"
    assert readers.source_inventory(spark, str(tmp_path / "in"), r"/(?P<series_id>nix)$").first().series_id is None
    spark.range(3).write.parquet(str(tmp_path / "t/data.parquet"))
    assert readers.training_input(spark, str(tmp_path / "t"), ["id"]).count() == 3
    with pytest.raises(ValueError, match="lacks"):
        readers.training_input(spark, str(tmp_path / "t"), ["id", "v"])
    (tmp_path / "r.csv").write_text("case,ok,at\n1,true,2024-01-01 12:00:00\n2,,2024-01-01T12:00:00+01:00\n3,no,\n")
    rows = readers.review_flags(spark, str(tmp_path / "r.csv"), ["ok"], ["at"], "Europe/Berlin").withColumn("at", F.unix_seconds("at")).orderBy("case").collect()
    assert [r.ok for r in rows] == [True, None, False] and rows[0].at == rows[1].at == 1704106800 and rows[2].at is None


def test_score_discovery(spark, tmp_path):
    columns = [f.name for f in contract.SCORES]
    line = ",".join("m" if c == "model" else "TRUE" if c == "available" else "" for c in columns) + "\n"
    put = lambda name, head=",".join(columns) + "\n": (tmp_path / name).write_text(head + line)
    with pytest.raises(FileNotFoundError):
        readers.discover_scores(spark, str(tmp_path))
    put("x_scores_15min.csv")
    put("y_scores_15min.csv")
    names = lambda: [p.rpartition("/")[2] for p in readers.discover_scores(spark, str(tmp_path))]
    assert names() == ["x_scores_15min.csv", "y_scores_15min.csv"]
    put("ALL_METERS_scores_15min_part2.csv")
    put("ALL_METERS_scores_15min_part1.csv")
    assert names() == ["ALL_METERS_scores_15min_part1.csv", "ALL_METERS_scores_15min_part2.csv"]
    put("ALL_SCORES_15MIN.csv")
    put("scores_15min.csv")
    assert names() == ["scores_15min.csv", "ALL_SCORES_15MIN.csv"]
    got = readers.score_files(spark, str(tmp_path))
    assert got.count() == 2 and got.first().available is True and got.first().is_anomaly is False and got.schema["raw_score"].dataType.typeName() == "double"
    put("scores_15min.csv", "model\n")
    with pytest.raises(ValueError, match="lacks canonical columns"):
        readers.score_files(spark, str(tmp_path))


def test_rank_mapping_rejects(spark, tmp_path):
    def meta(*ids):
        (tmp_path / "m.json").write_text(json.dumps({"d": {"organization": "o", "channels": [{"id": i} for i in ids]}}))
        return readers.channel_metadata(spark, str(tmp_path / "m.json"))

    assert {r.id: r.file_index for r in readers.rank_mapping(meta("C5", "C2")).collect()} == {"C2": 0, "C5": 1}
    for ids in (("xx", "C2"), ("C2", "C2", "C5")):
        with pytest.raises(ValueError, match="invalid or repeated"):
            readers.rank_mapping(meta(*ids))


def test_named_sets_parts_and_rebuild(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, event_date string")
    with pytest.raises(ValueError, match="missing"):
        sinks.write_named({"events": a}, str(tmp_path / "no"))
    sinks.write_named(dict.fromkeys(sinks.STANDARD, a), str(tmp_path / "std"))
    assert spark.read.parquet(str(tmp_path / "std/events")).count() == 2
    with pytest.raises(ValueError, match="repeat"):
        sinks.merge_parts(a.union(a), ["k"], str(tmp_path / "m"))
    sinks.merge_parts(a, ["k"], str(tmp_path / "m"))
    for i in (0, 1):
        a.write.parquet(str(tmp_path / f"shards/s{i}"))
    (tmp_path / "shards/open").mkdir()
    sinks.rebuilt(spark, str(tmp_path / "shards"), {"n": lambda rows: rows.groupBy("k").count()}, str(tmp_path / "derived"))
    assert {r["count"] for r in spark.read.parquet(str(tmp_path / "derived/n")).collect()} == {2}


def test_one_to_one_and_window_bounds(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 5), (1, 6)], "k long, v long")
    assert joins.one_to_one(a, b.limit(1), ["k"]).count() == 2
    with pytest.raises(ValueError, match="right"):
        joins.one_to_one(a, b, ["k"])
    for width in (1, 25):
        with pytest.raises(ValueError, match="fit"):
            profile.windows(a, ["k"], "k", "k", width, 24)


POINTS = "series_id string, slot long, value double, lower double, upper double, median double, effect double, jump double, support long, excluded boolean, current_beyond boolean, jump_in double, percentile double, quality boolean, shape boolean, change boolean"


def grid(rng, n=120):
    rows, before = [], None
    for i in range(n):
        v = rng.choice([None, 5.0, 30.0, 30.0, 40.0, -30.0, 12.0])
        step = None if v is None or before is None else abs(v - before)
        rows.append(("a", i, v, 0.0, 10.0, 5.0, 1.0, 3.0, rng.choice([9, 9, 9, 2]), rng.random() < 0.05, rng.random() < 0.5, step, 100.0, False, rng.random() < 0.2, rng.random() < 0.03))
        before = v
    return rows


def brute_evidence(event, rows, least, observed):
    _, start, end, short, medium = event
    ok = [r[2] is not None and r[8] >= 6 and not r[9] for r in rows]
    over = [max(r[2] - r[4], r[3] - r[2]) if r[2] is not None else None for r in rows]
    side = [("up" if r[2] > r[4] else "down") if ok[i] and over[i] > r[6] else None for i, r in enumerate(rows)]
    runs, i = [], start
    while i < end:
        j = i + 1
        while side[i] and j < end and side[j] == side[i]:
            j += 1
        if side[i]:
            runs.append((i, j))
        i = j
    joint = short is not None and medium is not None and short >= 99 and medium >= 99
    peak_, onset_, confirm_, cores = False, False, False, []
    for i, j in runs:
        strong = max(over[i:j]) >= 2 * rows[i][6]
        abrupt = i > 0 and ok[i - 1] and rows[i][11] is not None and rows[i][11] > rows[i][7]
        confirmed = joint or np.mean([rows[k][10] for k in range(i, j)]) >= 0.5
        if j - i >= least:
            peak_, onset_, confirm_ = peak_ or strong, onset_ or abrupt, confirm_ or confirmed
            if strong and abrupt and confirmed:
                cores.append((i, j))
    ratio = float(np.mean(ok[start:end]))
    cores = cores if ratio >= observed else []
    fails = [ratio < observed, max([j - i for i, j in runs], default=0) < least, not peak_, not onset_, not confirm_]
    reasons = [name for f, name in zip(fails, triage.REASONS) if f]
    return cores, [triage.CONFIRMED] if cores else reasons or [triage.SAME_RUN]


def test_event_evidence_equals_brute_force_and_loses_nothing(spark):
    rng = random.Random(4)
    rows = grid(rng)
    events = [(f"e{i}", a, a + rng.randint(1, 30), rng.choice([None, 50.0, 99.0]), rng.choice([99.5, 99.0])) for i, a in enumerate(rng.choices(range(90), k=60))]
    ev = spark.createDataFrame([(*e[:1], "a", *e[1:], "quality" if i % 9 else "data_quality") for i, e in enumerate(events)], "event_id string, series_id string, start long, `end` long, short double, medium double, event_type string")
    points = spark.createDataFrame(rows, POINTS)
    got = {r.event_id: r for r in triage.event_evidence(ev, points, ["series_id"], "slot", least=2, observed=0.7).collect()}
    assert len(got) == len(events)
    for e in events:
        cores, reasons = brute_evidence(e, rows, 2, 0.7)
        assert ([(c.start, c.end) for c in got[e[0]].cores], list(got[e[0]].triage_reasons)) == (cores, reasons), e
    assert sum(bool(r.cores) for r in got.values()) > 5
    out = triage.classify(ev, points, ["series_id"], "slot", has_reference=F.col("start") > 5, least=2, observed=0.7)
    assert triage.lossless(ev, out) and not triage.lossless(ev, out.limit(3))
    for r in out.collect():
        want = "data_quality" if r.event_type == "data_quality" else "operating_change_review" if r.start <= 5 or not got[r.event_id].cores else "priority_alert"
        assert r.review_queue == want and r.core_slots == (sum(c.end - c.start for c in r.cores))
    with pytest.raises(ValueError, match="unique"):
        triage.classify(ev.union(ev), points, ["series_id"], "slot")


@pytest.mark.parametrize("mode", ["envelope_confirmed", "transition_guarded"])
def test_magnitude_events_equal_brute_force(spark, mode):
    rng = random.Random(7)
    rows = grid(rng, 300)
    legacy = [(s, s + rng.randint(1, 8)) for s in rng.sample(range(290), 25)]
    got = workflow.magnitude_events(spark.createDataFrame(rows, POINTS), ["series_id"], "slot", mode, spark.createDataFrame([("a", s, e) for s, e in legacy], "series_id string, start long, `end` long"), 24, least=2)
    over = [max(r[2] - r[4], r[3] - r[2]) if r[2] is not None else None for r in rows]
    hit = [o is not None and o > 1.0 and r[8] >= 6 for o, r in zip(over, rows)]
    old = {k for s, e in legacy for k in range(s, e)}
    want, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and hit[j]:
            j += 1
        if j - i >= 2 and not all(k in old for k in range(i, j)):
            jumped = any(k >= 0 and rows[k][11] is not None and rows[k][11] > rows[k][7] for k in (i, i - 1))
            change = any(rows[k][15] for k in range(max(0, i - 2), min(len(rows), i + 2)))
            current = np.mean([rows[k][10] for k in range(i, j)]) >= 0.5
            shape = any(rows[k][14] for k in range(i, j))
            peak = max(over[i:j])
            if (current or jumped or change) if mode == "envelope_confirmed" else peak > 2 and (jumped or change or (shape and current)):
                want.append((i, j))
        i = max(j, i + 1)
    assert sorted((r.start, r.end) for r in got.collect()) == want and len(want) > 10


def test_failing_series_become_status_rows(spark):
    days = [("good", d, [float((d * h) % 5) + 1 for h in range(8)], d < 12) for d in range(16)] + [("ragged", d, [1.0] * (3 + d % 2), d < 12) for d in range(16)] + [("short", 0, [1.0] * 8, True)]
    df = spark.createDataFrame(days, "series_id string, day long, values array<double>, is_train boolean")
    got = models.rpca_scores(df, least_days=10, features=2).collect()
    assert {r.status.split(":")[0] for r in got if r.series_id == "ragged"} == {"error"} and sum(r.series_id == "ragged" for r in got) == 1
    assert {r.status for r in got if r.series_id == "good"} == {"ok"} and {r.status for r in got if r.series_id == "short"} == {"insufficient_history"}
    assert all(r.first_feature_score is not None for r in got if r.series_id == "good")
    assert {r.status for r in models.rpca_scores(df).collect() if r.series_id == "good"} == {"insufficient_history"}
    points = models.rpca_points(df.where("series_id = 'good'"), least_days=10).collect()
    by_day = {r.day: r.score for r in got if r.series_id == "good"}
    assert len(points) == 128
    for d in range(16):
        rest = [p.residual for p in points if p.day == d]
        assert abs(np.sqrt(np.mean(np.square(rest))) - by_day[d]) < 1e-9


def test_frozen_packages(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(s, i, rng.normal(size=6).tolist()) for s in ("a", "b") for i in range(30)] + [("c", 25, [0.0] * 6)]
    win = spark.createDataFrame(rows, "series_id string, slot long, values array<double>")
    models.freeze(win, "series_id", "slot", "values", 20).write.parquet(str(tmp_path / "p"))
    packages = models.load_packages(spark.read.parquet(str(tmp_path / "p")), 20)
    assert packages.count() == 2
    got = models.score_frozen(win, packages, "series_id", "slot", "values").collect()
    assert {(r.series_id, r.status) for r in got} == {("a", "scored"), ("b", "scored"), ("c", "no_package")} and len(got) == 61
    x = np.array([v for s, _, v in rows if s == "a"])
    own = models.LinearAutoencoder().fit(x[:20])(x)
    assert all(abs(r.window_mse - own[r.slot].mean()) < 1e-9 for r in got if r.series_id == "a")
    for bad, why in ((packages.union(packages), "repeated"), (packages.withColumn("sha256", F.lit("0")), "damaged")):
        with pytest.raises(ValueError, match=why):
            models.load_packages(bad, 20)
    with pytest.raises(ValueError, match="newer"):
        models.load_packages(packages, 19)
