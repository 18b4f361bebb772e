"""Hand-computed values, and the rule that what SQL gives for a query is what the query gives."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from kilojoule.functions import metrics as fn
from kilojoule.operators import metrics as m
from kilojoule.operators.resample import ResampleConfig, resample
from kilojoule.plans import queries as plans

SF = "/root/testdata/sf0.001"


def samples(spark, power, hr=None):
    rows = [(1, i, int(p), None if hr is None else hr[i]) for i, p in enumerate(power)]
    return spark.createDataFrame(rows, "activity_id int, idx int, power int, heart_rate int")


@pytest.mark.parametrize("power, np, avg", [([100] * 60 + [300] * 60, 244.04, 200), (([400] * 60 + [100] * 60) * 10, 315.58, 250), ([0] * 29 + [300], 10, 10), ([0] * 120, 0, 0)])
def test_normalized_power(spark, power, np, avg):
    r = m.power_summary(samples(spark, power), 250.0).first()
    assert r.np == pytest.approx(np, abs=0.01) and r.avg_power == avg and (avg or r.vi is None)


def test_too_short_for_normalized_power(spark):
    assert m.power_summary(samples(spark, [200] * 29), 250.0).first().np is None


def test_heart_rate(spark):
    a = m.Athlete(lthr=160.0, max_hr=190.0, resting_hr=50.0)
    assert m.heart_rate_summary(samples(spark, [200] * 3600, [160] * 3600), a).first().hr_tss == pytest.approx(100)
    assert m.heart_rate_summary(samples(spark, [200] * 200, [140] * 100 + [147] * 100), a).first().decoupling == pytest.approx(4.7619, abs=1e-4)
    assert m.heart_rate_summary(samples(spark, [200], [150]), m.Athlete(lthr=40.0, max_hr=190.0, resting_hr=50.0)).first().hr_tss is None


def test_zones(spark):
    assert m.zone_seconds(samples(spark, [0, 100, 200, 250, 500]), "power", 250, fn.POWER_ZONES).first().zones == [2, 0, 1, 1, 0, 0, 1]


def test_curves(spark):
    s = samples(spark, [100, 400, 300, 100])
    for df in (m.power_curve(s), m.mean_max_at(s, [1, 2, 3, 4, 0, 9])):
        assert [r.best_sum for r in df.orderBy("duration_s").collect()] == [400, 700, 800, 900]
    e = m.envelope(m.power_curve(samples(spark, [980, 0, 980]))).orderBy("duration_s").collect()
    assert [round(r.envelope, 2) for r in e] == [980, 653.33, 653.33]
    c = spark.createDataFrame([(1, 7, 1, 1, 900), (1, 7, 1, 2, 1000), (1, 8, 2, 1, 300), (1, 8, 2, 2, 1000), (1, 8, 2, 3, 900)], "a int, activity_id int, added int, duration_s int, best_sum long")
    assert [r.source for r in m.season_curve(c, "a").orderBy("duration_s").collect()] == [7, 7, 8]


def test_w_balance(spark, monkeypatch):
    s = samples(spark, [1200, 1200, 1200, 100])
    got = [r.balance for r in m.w_prime_balance(s, 200.0, 10_000.0).orderBy("idx").collect()]
    assert got == pytest.approx([9000, 8000, 7000, 7029.85], abs=0.01)
    # the same as step by step, over many blocks
    power = ([900] * 5 + [0] * 40 + [250] * 10) * 12
    left, want = 10.0, []
    for p in power:
        left = left - (p - 200) if p >= 200 else 10 - (10 - left) * math.exp((p - 200) / 10)
        want.append(left)
    for block in (m.EXPONENT_BLOCK, 60.0):
        monkeypatch.setattr(m, "EXPONENT_BLOCK", block)
        assert [r.balance for r in m.w_prime_balance(samples(spark, power), 200.0, 10.0).orderBy("idx").collect()] == pytest.approx(want, abs=1e-6)
    assert m.w_prime_balance(s, 0.0).count() == 0
    r = m.least_balance(m.w_prime_balance(samples(spark, [1200] * 20), 200.0, 10_000.0)).first()
    assert (round(r.balance), r.idx) == (-10_000, 19)


def test_loads(spark):
    d = spark.createDataFrame([(1, 0, 50.0), (1, 2, 30.0), (1, 2, 20.0)], "a int, day long, load double")
    assert [r.load for r in m.daily_loads(d, "a").orderBy("day").collect()] == [50, 0, 50]
    two = spark.createDataFrame([(1, 0, 42.0), (1, 1, 0.0)], "a int, day long, load double")
    r = m.training_load(two, "a", m.LoadConfig(exponential=False, tsb_of_yesterday=True)).orderBy("day").collect()
    assert (r[0].ctl, r[0].atl, r[0].tsb, r[1].tsb) == pytest.approx((1, 6, 0, -5))


def test_fits(spark):
    points = spark.createDataFrame([(1, float(t), 250 + 18_000 / t) for t in (120, 300, 600, 1200)] + [(2, 120.0, 300.0), (2, 300.0, 280.0)], "a int, t double, p double")
    r = m.fit_2p(points, "a").collect()
    assert len(r) == 1 and (r[0].cp, r[0].w_prime, r[0].r2) == pytest.approx((250, 18_000, 1))
    flat = spark.createDataFrame([(1, t, w) for t, w in ((600, 150.0), (1200, 300.0), (1800, 250.0))], "a int, t int, p double")
    e = m.estimate_ftp(flat, "a").first()
    assert (round(e.eftp, 2), e.duration_s) == (288.89, 1200)


def test_workout(spark):
    steps = spark.createDataFrame([(1, 1, 3600, 100.0, 100.0), (2, 1, 2, 50.0, 50.0), (2, 2, 0, 9.0, 9.0), (2, 3, 1, 100.0, 100.0)], "activity_id int, seq int, duration_s int, from_pct double, to_pct double")
    r = m.power_summary(m.workout_profile(steps.where("activity_id = 1"), 250.0), 250.0).first()
    assert (r.tss, r.work_kj) == pytest.approx((100, 900))
    assert [r.power for r in m.workout_profile(steps.where("activity_id = 2"), 300.0).orderBy("idx").collect()] == [150, 150, 300]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_fuelling(spark):
    assert [one(spark, fn.carbs_g_per_kg(F.lit(float(x)))) for x in (0, 8, 25, 100, "nan")] == pytest.approx([3, 5, 7.75, 12, 3])
    assert [one(spark, fn.protein_g_per_kg(F.lit(float(x)))) for x in (0, 30, 90)] == pytest.approx([1.2, 1.6, 2.0])
    assert [one(spark, fn.in_ride_g_per_hour(F.lit(a), F.lit(b))) for a, b in ((44, 1.0), (65, 0.55), (65, 0.85), (90, 0.70), (150, 0.55), (240, 0.85))] == [0, 0, 30, 45, 45, 90]
    assert len(fn.curve_grid(3600)) == 73 and fn.curve_grid(3600)[-1] == 3600


def records(spark, rows):
    full = [(1, i, t, *v, *[None] * (6 - len(v))) for i, (t, *v) in enumerate(rows)]
    return spark.createDataFrame(full, "activity_id int, seq int, ts long, power int, heart_rate int, cadence int, speed double, altitude double, distance double")


def run(spark, rows, timer=None, **cfg):
    events = spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate(timer or [])], "activity_id int, seq int, ts long, kind string")
    s, r = resample(records(spark, rows), events, ResampleConfig(**cfg))
    return s.orderBy("idx").collect(), r.first()


def test_resample(spark):
    s, r = run(spark, [(100, 200), (102, 300), (200, 100)])
    assert [x.power for x in s] == [200, 250, 300, 100] and [x.elapsed for x in s] == [0, 1, 2, 100] and (r.gap_seconds_filled, r.paused_seconds) == (1, 97)
    s, r = run(spark, [(5, 100, 120, None), (5, 200, None, 90)])
    assert (s[0].power, s[0].heart_rate, s[0].cadence, r.duplicates, len(s)) == (200, 120, 90, 1, 1)
    s, r = run(spark, [(10, 1), (9, 99), (11, 2)])
    assert [x.power for x in s] == [1, 2] and r.out_of_order == 1
    assert len(run(spark, [(0, 100), (31, 100)])[0]) == 32
    s, r = run(spark, [(0, 100), (32, 100)])
    assert (len(s), r.pauses, r.paused_seconds) == (2, 1, 31)
    assert [x.power for x in run(spark, [(0, 100), (1, None), (100, 300)])[0]] == [100, 100, 300]
    s, r = run(spark, [(0, 100), *[(i, None) for i in range(1, 9)], (9, 280)])
    assert [x.power for x in s] == list(range(100, 281, 20)) and r.power_dropouts_repaired == 8
    s, r = run(spark, [(0, 100), *[(i, None) for i in range(1, 10)], (10, 100)])
    assert sum(x.power for x in s) == 200 and (r.power_dropout_seconds, r.power_dropouts_repaired) == (9, 0)
    assert [x.power for x in run(spark, [(0, None), (1, 150), (2, 160), (3, None)])[0]] == [150, 150, 160, 160]
    s, r = run(spark, [(0, 200), (1, 4000), (2, 300)])
    assert [x.power for x in s] == [200, 250, 300] and r.power_spikes == 1
    assert [x.power for x in run(spark, [(0, 200), (1, 4000), (2, 300)], max_power=None)[0]] == [200, 4000, 300]


def test_resample_with_timer(spark):
    rows = [(i, 100) for i in range(6)]
    assert len(run(spark, rows, [(2, "stop"), (4, "start")])[0]) == 6
    s, r = run(spark, rows, [(2, "stop"), (4, "start")], use_timer_events=True)
    assert [x.elapsed for x in s] == [0, 1, 4, 5] and (r.timer_paused_records, r.pauses) == (2, 1)
    s, r = run(spark, [(t, 100) for t in (0, 1, 2, 5)], [(3, "stop"), (4, "start")], use_timer_events=True)
    assert [x.elapsed for x in s] == [0, 1, 2, 5] and r.gaps_filled == 0
    assert len(run(spark, [(i, 100) for i in range(5)], [(2, "stop")], use_timer_events=True)[0]) == 2


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in plans.ORACLE_SQL.items():
        df = plans.QUERIES[name](spark, SF)
        r = con.sql(sql)
        assert sorted(df.columns) == sorted(r.columns), name
        cols = sorted(df.columns)
        assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(map(tuple, r.select(",".join(cols)).fetchall()), key=repr), name
