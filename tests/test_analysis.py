"""Summaries by settings of the day, curves over elapsed time, and fits against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilojoule.functions import fits
from kilojoule.operators import analysis
from kilojoule.operators import metrics as m
from kilojoule.operators.resample import resample


def samples(spark, rides):
    rows = [(k, i, *x) for k, ride in rides.items() for i, x in enumerate(ride)]
    return spark.createDataFrame(rows, "activity_id string, idx long, power int, heart_rate int")


def test_settings_of_the_day(spark):
    acts = spark.createDataFrame([("a", 1, 0), ("b", 1, 9), ("c", 1, 10), ("d", 1, 99), ("e", 2, 50), ("f", None, 5), ("g", 1, None)], "activity_id string, athlete_id int, day int")
    own = spark.createDataFrame([(1, 5, 200.0, 0), (1, 10, 250.0, 0), (1, 10, 260.0, 1), (2, 60, 300.0, 0)], "athlete_id int, from_day int, ftp double, added int")
    got = {r.activity_id: r.ftp for r in analysis.settings_on(acts, own).collect()}
    assert got == {"a": None, "b": 200.0, "c": 260.0, "d": 260.0, "e": None, "f": None, "g": None}


def test_settings_are_checked(spark):
    rows = [(1, None, None), (2, [0.5, 0.9, 1.2], "women"), (3, [0.5, 0.5], "men"), (4, [-1.0, 2.0], "men"), (5, [0.5, float("nan")], "odd"), (6, [], "men"), (7, [float(i + 1) for i in range(16)], "men"), (8, [0.5, None, 0.9], "men")]
    out = {r.athlete_id: r for r in analysis.checked_settings(spark.createDataFrame(rows, "athlete_id int, power_zones array<double>, trimp string")).collect()}
    assert [i for i in out if out[i].error is None] == [1, 2] and list(out[1].power_zones) == [0.55, 0.75, 0.9, 1.05, 1.2, 1.5] and out[1].trimp == "men"
    assert out[3].power_zones is None and len(out[3].hr_zones) == 6 and "trimp" in out[5].error and out[5].trimp is None


def test_an_hour_at_the_threshold(spark):
    x = samples(spark, {"r": [(250, None)] * 3600})
    for settings in (m.Athlete(ftp=250.0), analysis.checked_settings(spark.createDataFrame([("r", 250.0)], "activity_id string, ftp double"))):
        r = analysis.summarize(x, settings).first()
        assert r.average_power == 250 and math.isclose(r.tss, 100) and list(r.power_zone_seconds) == [0, 0, 0, 3600, 0, 0, 0]
        assert [p.duration_s for p in r.power_curve][-1] == 3600 and all(p.watts == 250 for p in r.power_curve) and r.hr_tss is None and r.hr_zone_seconds is None and r.cp_fit is None
        assert r.eftp.duration_s == 1800 and r.eftp.w_prime == 20000


def test_each_activity_by_its_own_settings(spark):
    rng = np.random.default_rng(2)
    rides = {k: [(int(p), int(h)) for p, h in zip(rng.integers(0, 500, 400), rng.integers(90, 190, 400))] for k in "abc"}
    x = samples(spark, rides)
    own = {"a": (220.0, 60.0, 150.0, 50.0, 190.0, 210.0, 15000.0, "men"), "b": (300.0, 80.0, 170.0, 40.0, 200.0, None, None, "women"), "c": (None, None, None, None, None, None, None, None)}
    table = analysis.checked_settings(spark.createDataFrame([(k, *v) for k, v in own.items()], "activity_id string, ftp double, weight_kg double, lthr double, resting_hr double, max_hr double, cp double, w_prime double, trimp string"))
    got = {r.activity_id: r for r in analysis.summarize(x, table).collect()}
    for k, (ftp, kg, lthr, rest, top, cp, w, kind) in own.items():
        one = analysis.summarize(x.where(F.col("activity_id") == k), m.Athlete(ftp=ftp, weight_kg=kg, lthr=lthr, resting_hr=rest, max_hr=top, cp=cp, w_prime=w, trimp=kind or "men")).first()
        assert one == got[k]
    assert got["c"].tss is None and got["c"].power_zone_seconds is None and got["c"].normalized_power is not None and got["c"].min_w_prime_balance is None


def test_zones_of_their_own(spark):
    x = samples(spark, {"r": [(100, 120), (187, 150), (188, None), (500, 200), (0, 90)]})
    own = spark.createDataFrame([("r", 250.0, 150.0, [0.5, 0.75])], "activity_id string, ftp double, lthr double, power_zones array<double>")
    r = analysis.analyze(x, analysis.checked_settings(own)).first()
    assert list(r.power_zone_seconds) == [2, 1, 2] and len(r.hr_zone_seconds) == 7 and sum(r.hr_zone_seconds) == 4


def test_without_settings_or_power(spark):
    x = samples(spark, {"r": [(200, 140)] * 40}).withColumn("power_dropout", F.lit(True))
    none = spark.createDataFrame([], "activity_id string, ftp double")
    r = analysis.summarize(x, analysis.checked_settings(none)).first()
    assert r.average_power is None and r.power_curve is None and r.eftp is None and r.average_hr == 140 and not r.has_power and r.hr_zone_seconds is None
    assert analysis.summarize(x.limit(0), m.Athlete(ftp=200.0)).count() == 0


def test_report_in_the_summary(spark):
    rows = [("r", i, 2 * i, 200) for i in range(60)]
    none = F.lit(None).cast("double")
    records = spark.createDataFrame(rows, "activity_id string, seq long, ts long, power int").select("*", *[none.alias(c) for c in ("heart_rate", "cadence", "speed", "altitude", "distance")])
    s, report = resample(records)
    r = analysis.summarize(s, m.Athlete(), report).first()
    assert r.recording_time_s == 119 and r.resample_report.gap_seconds_filled == 59 and r.resample_report.records == 60


@pytest.mark.parametrize("pause", [1, 37, 5000, 30000])
def test_pauses_are_zeros_without_rows(spark, pause):
    rng = np.random.default_rng(pause)
    power = rng.integers(0, 900, 300)
    at = np.cumsum(np.where(rng.random(300) < 0.05, pause + 1, 1))
    at -= at[0]
    dense = np.zeros(at[-1] + 1, np.int64)
    dense[at] = power
    sums = np.concatenate([[0], np.cumsum(dense)])
    durations = [1, 2, 7, 40, 299, 300, 301, 3600, 21600, len(dense), len(dense) + 1]
    want = {d: int((sums[d:] - sums[:-d]).max()) for d in durations if d <= len(dense)}
    df = spark.createDataFrame([("r", i, int(t), int(p)) for i, (t, p) in enumerate(zip(at, power))], "activity_id string, idx long, elapsed long, power int")
    assert {r.duration_s: r.best_sum for r in analysis.mean_max_elapsed(df, durations).collect()} == want
    whole = analysis.best_sums(df, [1, 5]).first()
    assert whole.length == len(dense) and whole.total == int(power.sum())


def plain_fit(t, p):
    w = p * t
    slope, intercept = np.polyfit(t, w, 1)
    s2, sxx = ((w - slope * t - intercept) ** 2).sum() / (len(t) - 2), ((t - t.mean()) ** 2).sum()
    off = p - intercept / t - slope
    return slope, intercept, 1 - (off**2).sum() / ((p - p.mean()) ** 2).sum(), math.sqrt((off**2).mean()), math.sqrt(s2 / sxx), math.sqrt(s2 * (1 / len(t) + t.mean() ** 2 / sxx))


def test_fits_in_one_pass_and_in_one_row(spark):
    rng = np.random.default_rng(5)
    t = np.array([120.0, 180, 300, 420, 600, 900, 1200])
    curves = {"noise": 18000 / t + 260 + rng.normal(0, 5, 7), "exact": 20000 / t + 280, "two": (20000 / t + 280)[:2], "falling": np.array([300.0, 250, 170, 120, 80, 50, 30])}
    rows = [(k, float(a), float(b)) for k, p in curves.items() for a, b in zip(t, p)] + [("noise", None, 3.0), ("noise", 4.0, None)]
    df = spark.createDataFrame(rows, "k string, t double, p double")
    by_group = {r.k: r for r in m.fit_2p(df, "k").collect()}
    assert set(by_group) == {"noise", "exact"}
    points = df.where("t is not null and p is not null").groupBy("k").agg(F.collect_list(F.struct("t", "p")).alias("x"))
    in_row = {r.k: r.f for r in points.select("k", fits.fit_2p(F.col("x")).alias("f")).collect()}
    assert in_row["two"] is None and in_row["falling"] is None
    for k in by_group:
        want, g, r = plain_fit(t, curves[k]), by_group[k], in_row[k]
        for got in ((g.cp, g.w_prime, g.r2, g.rmse, g.se_cp, g.se_w_prime), (r.cp, r.w_prime, r.r_squared, r.rmse, r.se_cp, r.se_w_prime)):
            assert np.allclose(got, want, rtol=1e-6, atol=2e-4)
    at = spark.range(1).select(fits.predict(F.lit(400.0), F.lit(280.0), F.lit(20000.0)).alias("a"), fits.predict(F.lit(10.0), F.lit(280.0), F.lit(20000.0), F.lit(-30.0)).alias("b")).first()
    assert at.a == 330 and at.b == 780


def test_estimated_ftp(spark):
    ride = [150] * 600 + [300] * 1200 + [150] * 600
    df = samples(spark, {"r": [(p, None) for p in ride]})
    r = analysis.curves(df).first()
    assert r.eftp.duration_s == 1200 and abs(r.eftp.eftp - 288.89) < 0.01 and r.eftp.watts == 300
    points = spark.createDataFrame([("r", 1200, 300.0), ("r", 1800, 250.0), ("s", 100, 900.0)], "k string, t int, p double")
    assert [(x.k, x.duration_s) for x in m.estimate_ftp(points, "k").collect()] == [("r", 1200)]


@pytest.mark.parametrize("cfg", [m.LoadConfig(), m.LoadConfig(exponential=False, tsb_of_yesterday=True), m.LoadConfig(1.0, 3.0, 50.0, 70.0, False), m.LoadConfig(42.0, 7.0, 60.0, 40.0)])
def test_loads_over_many_blocks(spark, cfg):
    rng = np.random.default_rng(1)
    loads = rng.integers(0, 300, 6000).astype(float)
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(loads)] + [("one", 5, 100.0)], "k string, day long, load double")
    share = lambda days: 1 - math.exp(-1 / days) if cfg.exponential else 1 / days
    ctl, atl, want = cfg.ctl0, cfg.atl0, []
    for x in loads:
        before = ctl - atl
        ctl, atl = ctl + (x - ctl) * share(cfg.ctl_days), atl + (x - atl) * share(cfg.atl_days)
        want.append((ctl, atl, before if cfg.tsb_of_yesterday else ctl - atl))
    got = [(r.ctl, r.atl, r.tsb) for r in m.training_load(df, "k", cfg).where("k = 'k'").orderBy("day").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_only_what_changed_is_worked_out_anew(spark, tmp_path):
    from kilojoule.operators import stored

    path = str(tmp_path / "summaries")
    rides = {f"{k}{i}": [(150 + 10 * i, 140)] * 40 for k in "abc" for i in range(2)}
    x = samples(spark, rides)
    acts = spark.createDataFrame([(f"{k}{i}", n, 10 * i) for n, k in enumerate("abc") for i in range(2)] + [("a0x", None, 0)], "activity_id string, athlete_id int, day int")
    own = lambda *rows: spark.createDataFrame(list(rows), "athlete_id int, from_day int, ftp double")
    first = own((0, 0, 200.0), (1, 0, 250.0), (2, 0, 300.0))
    files = lambda: {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert sorted(r[0] for r in stored.refresh(x, acts, first, path).collect()) == [0, 1, 2]
    before = files()
    assert stored.refresh(x, acts, first, path).count() == 0 and files() == before
    second = own((0, 0, 200.0), (1, 0, 250.0), (1, 5, 280.0), (2, 0, 300.0))
    assert [r[0] for r in stored.refresh(x, acts, second, path).collect()] == [1]
    after = files()
    keep = lambda fs: {f: t for f, t in fs.items() if "athlete_id=1" not in str(f)}
    assert keep(after) == keep(before) and set(after) != set(before)
    got = {r.activity_id: r.intensity_factor for r in spark.read.parquet(path).collect()}
    assert len(got) == 6 and math.isclose(got["b0"], 150 / 250) and math.isclose(got["b1"], 160 / 280)
    more = acts.where("activity_id <> 'c1'")
    assert [r[0] for r in stored.refresh(x, more, second, path).collect()] == [2] and spark.read.parquet(path).count() == 5
