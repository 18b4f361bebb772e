"""Strict JSON inputs, and counters of a stream against the batch report on the same rows."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from kilojoule.operators import dayplan
from kilojoule.operators.resample import ResampleConfig, resample
from kilojoule.sources import json_inputs as j
from kilojoule.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def test_settings(spark):
    rows = ['{"ftp": 250, "lthr": 165, "power_zones": [0.5, 1.0], "trimp": "female"}', "", "  ", "{}", '{"ftp": "high"}', '{"fpt": 250}', "[1]", "no json", None, '{"trimp": "child"}', '{"lthr": 160.5}', '{"power_zones": [0.5, null]}', '{"ftp": null}', '{"power_zones": 3}', '{"lthr": 99999999999}', '{"ftp": 1e2, "cp": -3.5}', '{"ftp": "250"}', '{"trimp": 5}']
    out = {r.id: r for r in j.settings(texts(spark, rows), "text").collect()}
    assert [i for i in out if out[i].error is None] == [0, 1, 2, 3, 12, 15] and len(out) == len(rows)
    assert (out[0].ftp, out[0].lthr, out[0].power_zones, out[0].trimp) == (250.0, 165, [0.5, 1.0], "women") and out[1].ftp is None and out[15].ftp == 100 and out[15].cp == -3.5
    assert out[4].error == "ftp: no number" and out[5].error == "the text: unknown key fpt" and out[6].error == out[7].error == "the text: no JSON object" and out[8].error == "no text"
    assert out[16].error == "the text: a value is of another type" and out[16].ftp is None and "one of male, female" in out[17].error
    assert out[10].error == "lthr: no whole number" and out[11].error == "power_zones: null in a list" and out[13].error == "power_zones: no list" and out[14].error == "lthr: no whole number" and out[4].lthr is None


def test_workouts(spark):
    step = lambda **target: {"duration_s": 60, "target": target}
    good = {"name": "A & B", "steps": [step(type="steady", pct=90), {"kind": "warmup", **step(type="ramp", **{"from": 40, "to": 70})}]}
    bad = [{"name": "x"}, {"steps": []}, {"name": "x", "steps": [step(type="steady")]}, {"name": "x", "steps": [step(type="wave", pct=3)]}, {"name": "x", "steps": [{**step(type="steady", pct=3), "odd": 1}]}, {"name": "x", "steps": [step(type="steady", pct=3, watts=9)]}, {"name": "x", "steps": [{"duration_s": -5, "target": {"type": "steady", "pct": 3}}]}]
    workouts, steps = j.workout_steps(texts(spark, map(json.dumps, [good, *bad, {"name": "none", "steps": []}])), "text", "id")
    out = {r.activity_id: r for r in workouts.collect()}
    assert [i for i in out if out[i].error is None] == [0, 8] and out[0].name == "A & B"
    assert "steps is missing" in out[1].error and "name is missing" in out[2].error and out[4].error == "steps[].target.type: one of steady, ramp is needed" and out[5].error == "steps[]: unknown key odd" and out[6].error == "steps[].target: unknown key watts"
    assert [tuple(r) for r in steps.orderBy("seq").collect()] == [(0, 0, "active", 60, 90.0, None), (0, 1, "warmup", 60, 40.0, 70.0)]


def test_fuel_days_to_plans(spark):
    ride = {"start_min": 600, "duration_min": 120, "intensity_factor": 0.7}
    rows = [{"body_mass_kg": 70, "sessions": [{**ride, "start_min": 900}, ride], "ahead": [{"sessions": [{**ride, "start_min": 500}, {**ride, "start_min": 400}]}]}, {"body_mass_kg": 70, "sessions": [], "wake_min": 400}, {"sessions": []}, {"body_mass_kg": 70, "sessions": [{**ride, "intensity": 1}]}, {"body_mass_kg": 70, "sessions": [], "ahead": [{"priority": "D"}]}]
    days, sessions = j.fuel_days(texts(spark, map(json.dumps, rows)), "text", "id")
    out = {r.plan_id: r for r in days.collect()}
    assert [i for i in out if out[i].error is None] == [0, 1] and out[0].tomorrow_start == 400 and out[1].wake_min == 400 and out[3].error == "sessions[]: unknown key intensity" and out[4].error == "ahead[].priority: one of A, B, C is needed"
    assert [(r.seq, r.start_min) for r in sessions.orderBy("seq").collect()] == [(0, 600), (1, 900)]
    plans, _, entries = dayplan.day_plan(days.where("error is null"), sessions)
    assert plans.count() == 2 and entries.where("plan_id = 0 and kind = 'during_session'").count() == 6


def test_fitness_requests(spark):
    rows = ['{"activities": [{"day": 3, "tss": 50.5, "curve": [[60, 300], [300, 250.5]]}, {"day": 4}], "end_day": 10}', '{"activities": [{"tss": 1}], "end_day": 1}', '{"activities": []}']
    out = j.strict(texts(spark, rows), "text", j.FITNESS).orderBy("id").collect()
    assert out[0].error is None and out[0].parsed.activities[0].curve == [[60.0, 300.0], [300.0, 250.5]] and out[0].parsed.activities[1].tss is None
    assert out[1].error == "activities[]: day is missing" and out[2].error == "the text: end_day is missing" and out[1].parsed is None


@pytest.fixture()
def rocks(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def run(spark, path, name, idle=None):
    stream = spark.readStream.schema("activity_id string, seq long, ts long, power int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = live.live_report(stream, idle_s=idle).writeStream.format("memory").queryName(name).outputMode("update")
    return q


def test_counters_of_a_stream_equal_the_batch_report(spark, rocks, tmp_path):
    rng, rows = random.Random(3), []
    for k in "abcd":
        t = 1000
        for i in range(200):
            t += rng.choice([1, 1, 1, 1, 0, 2, 5, 31, 32, 90, -4])
            rows.append((k, i, t, rng.choice([None, 100, 200, 3000])))
    rows.append(("one", 0, 5, 7))
    for part in range(3):
        some = [r for r in rows if r[1] // 67 == part]
        rng.shuffle(some)
        spark.createDataFrame(some, "activity_id string, seq long, ts long, power int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files count by their time
    q = run(spark, str(tmp_path / "in"), "reports").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    got = {}
    for r in spark.table("reports").collect():
        if r.activity_id not in got or r.records > got[r.activity_id].records:
            got[r.activity_id] = r
    none = [F.lit(None).cast(t).alias(c) for c, t in (("heart_rate", "int"), ("cadence", "int"), ("speed", "double"), ("altitude", "double"), ("distance", "double"))]
    _, report = resample(spark.createDataFrame(rows, "activity_id string, seq long, ts long, power int").select("*", *none), cfg=ResampleConfig())
    for r in report.collect():
        assert [got[r.activity_id][c] for c in live.COUNTERS] == [r[c] for c in live.COUNTERS], r.activity_id
        assert got[r.activity_id].segment == r.pauses
    assert len(got) == 5 and spark.table("reports").where("activity_id = 'a'").count() == 3


def test_idle_activities_are_closed(spark, rocks, tmp_path):
    add = lambda rows: spark.createDataFrame(rows, "activity_id string, seq long, ts long, power int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add([("a", 0, 10, 5), ("a", 1, 9, 5)])
    q = run(spark, str(tmp_path / "in"), "closing", idle=0).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("closing").where("closed").count():
                break
        closed = spark.table("closing").where("closed").first()
        assert (closed.records, closed.out_of_order, closed.last_ts) == (2, 1, 10)
        add([("a", 2, 3, 5)])
        for _ in range(60):
            time.sleep(1)
            if spark.table("closing").count() >= 3:
                break
        assert spark.table("closing").where("last_ts = 3").first().records == 1  # the activity began anew
    finally:
        q.stop()
