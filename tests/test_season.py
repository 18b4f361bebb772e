"""Rollups, looks ahead, the one-pass summary and streams, by hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kilojoule.operators import metrics as m
from kilojoule.operators import season
from kilojoule.operators.analysis import analyze
from kilojoule.streaming.live import content_id, latest, live_sessions, store


def test_improved(spark):
    c = spark.createDataFrame([(1, 7, 1, 1, 300), (1, 7, 1, 2, 400), (1, 8, 2, 1, 250), (1, 8, 2, 2, 500), (1, 8, 2, 3, 750)], "a int, activity_id int, added int, duration_s int, best_sum long")
    assert sorted((r.activity_id, r.duration_s, r.before) for r in season.improved(c, "a").collect() if r.activity_id == 8) == [(8, 2, 400), (8, 3, None)]


def test_season_loads(spark):
    a = spark.createDataFrame([(1, 3, 50.0, 9.0), (1, 5, None, 20.0), (1, 5, None, None), (1, 9, 99.0, None), (2, 9, 99.0, None)], "a int, day long, tss double, hr_tss double")
    got = {(r.a, r.day): r.load for r in season.season_loads(a, "a", 6).collect()}
    assert got == {(1, 3): 50, (1, 4): 0, (1, 5): 20, (1, 6): 0, (2, 6): 0}


@pytest.mark.parametrize(
    "own, sessions, to, note",
    [
        (3.0, [(1, 285, 0.70, None)], 8.0, "Raised: 4 h 45 min ride tomorrow"),
        (5.0, [(2, 180, 0.8, "A")], 11.0, "Carb-loading: 3 h A event in 2 days"),
        (6.0, [], 6.0, None),
        (5.5, [(1, 60, 0.9, None)], 5.5, None),
        (3.0, [(1, 60, 0.9, None), (1, 50, 0.9, None)], 5.5, "Raised: hard 50 min session tomorrow (IF 0.90)"),
        (3.0, [(1, 60, float("nan"), None)], 3.0, None),
        (3.0, [(2, 300, 0.9, None)], 3.0, None),
    ],
)
def test_raised(spark, own, sessions, to, note):
    rows = [(1, d, i, *rest) for i, (d, *rest) in enumerate(sessions)]
    ahead = season.planned_days(spark.createDataFrame(rows, "a int, day long, seq int, minutes int, intensity double, priority string"), "a")
    r = season.raised(spark.createDataFrame([(1, 0, own)], "a int, day long, own double"), ahead, "a").first()
    assert (r.to_g_per_kg, r.note) == (pytest.approx(to), note) and (r.reason is None) == (note is None)


def test_analyze(spark):
    rows = [(1, i, 200 if i < 60 else 100, 100, 8.0 if i else 0.0, i, False) for i in range(120)] + [(2, 0, 0, None, None, 0, True)]
    s = spark.createDataFrame(rows, "activity_id int, idx int, power int, heart_rate int, speed double, elapsed long, power_dropout boolean")
    r, none = analyze(s, m.Athlete(ftp=200.0, weight_kg=75.0, lthr=160.0)).orderBy("activity_id").collect()
    assert (r.recording_time_s, r.elapsed_time_s, r.moving_time_s, r.average_power, r.decoupling_pct, r.average_watts_per_kg) == (120, 120, 119, 150, 50, 2)
    assert r.efficiency_factor == pytest.approx(r.normalized_power / 100) and sum(r.power_zone_seconds) == 120 and r.hr_tss is None
    assert none.has_power is False and none.average_power is None and none.min_w_prime_balance is None and none.hr_zone_seconds is None
    bare = analyze(s.select("activity_id", "idx", "power", "heart_rate"), m.Athlete()).where("activity_id = 1").first()
    assert bare.has_power and bare.tss is None and bare.power_zone_seconds is None and bare.elapsed_time_s == 120


def test_analyze_shuffles_once(spark):
    s = spark.createDataFrame([(1, 0, 1, 1)], "activity_id int, idx int, power int, heart_rate int")
    plan = analyze(s, m.Athlete(ftp=200.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_live_sessions(spark, tmp_path):
    at = lambda t: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)
    rows = [(1, at(t), 100, None) for t in (0, 31, 63)] + [(2, at(5), 50, 90)]
    spark.createDataFrame(rows, "activity_id int, at timestamp, power int, heart_rate int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("activity_id int, at timestamp, power int, heart_rate int").parquet(str(tmp_path / "in"))
    q = live_sessions(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.activity_id, r.records) for r in spark.table("live").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_store_and_latest(spark, tmp_path):
    schema = "name string, added int, content binary"
    for i, rows in enumerate(([("a", 1, b"x"), ("b", 1, b"y")], [("c", 2, b"x")])):
        spark.createDataFrame([(n, a, bytearray(c)) for n, a, c in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("content_id", content_id(F.col("content")))
        assert store(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = latest(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted(r.name for r in got) == ["b", "c"] and all(len(r.content_id) == 24 for r in got)


def test_season_in_one_row(spark):
    import math

    from pyspark.sql import functions as F

    from kilojoule.operators import season

    loads = spark.createDataFrame([(1, 10, 100.0, None), (1, 12, None, 50.0), (1, 99, 500.0, None), (2, 99, 80.0, None)], "who int, day long, tss double, hr_tss double")
    ts = (10, 30, 60, 120, 180, 300, 420, 600, 900, 1200, 1800)
    good = [(1, t, 20000 / (t + 25) + 280) for t in ts]
    curves = spark.createDataFrame([*good, (1, 300, 100.0), (1, 60, float("nan")), (1, 120, math.inf), (1, 180, None), (3, 60, 400.0)], "who int, duration_s int, watts double")
    out = {r.who: r for r in season.season_summary(loads, curves, "who", 20).collect()}
    assert set(out) == {1, 2, 3} and (out[1].first_day, out[2].first_day, out[3].first_day) == (10, 20, None)
    ctl = sum(x * (1 - math.exp(-1 / 42)) * math.exp(-n / 42) for x, n in ((100, 10), (50, 8)))
    assert math.isclose(out[1].ctl, ctl) and out[2].ctl == 0 and out[3].ctl is None and out[2].season_curve is None
    assert len(out[1].season_curve) == len(ts) and math.isclose(out[1].season_curve[5].watts, 20000 / 325 + 280)
    assert abs(out[1].cp_3p.cp - 280) < 0.5 and abs(out[1].cp_3p.k + 25) < 1 and out[1].cp_2p.points == 7 and out[3].cp_2p is None and out[3].eftp is None and out[1].eftp.duration_s in ts
    zoned = spark.createDataFrame([("2024-01-01 20:00:00", "Asia/Tokyo"), ("2024-01-01 20:00:00", "UTC")], "at string, zone string").select(season.local_day(F.col("at").cast("timestamp"), F.col("zone")).alias("d")).collect()
    assert [r.d for r in zoned] == [19724, 19723]
    d = season.day_load(spark.createDataFrame([(1, 5, 2.5, 30), (1, 5, 1.0, 45), (1, 6, None, 20)], "k int, day int, load double, minutes int"), "k").orderBy("day").collect()
    assert [(r.load, r.training_min) for r in d] == [(3.5, 75), (None, 20)]
