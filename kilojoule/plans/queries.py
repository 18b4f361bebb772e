"""The engine's queries over the test tables, and the DuckDB SQL that gives the same rows.

The tables hold no rides, so views stand in for them: a user's events in order are a ride's seconds, hours are ticks to resample,
orders are daily loads and sessions, line items are workout steps. Doubles come out as whole thousandths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilojoule.functions import metrics as fn
from kilojoule.operators import metrics as m
from kilojoule.operators import dayplan, season
from kilojoule.operators.analysis import analyze, checked_settings, curves, mean_max_elapsed, settings_on, summarize
from kilojoule.operators.resample import ResampleConfig, resample
from kilojoule.sources import json_inputs

ATHLETE = m.Athlete(ftp=1000.0, weight_kg=72.0, lthr=150.0, max_hr=190.0, resting_hr=50.0, cp=1000.0, w_prime=20_000.0)
DURATIONS = list(fn.STANDARD_DURATIONS)
#: Durations at which sampled curves are kept.
GRID = fn.curve_grid(21_600)
#: The day, counted from 1970, that season_fitness ends on.
END_DAY = 10_000


def milli(c: Column | str) -> Column:
    """Thousandths, rounded half up."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1000 + 0.5).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rides(spark: SparkSession, sf_dir: str, users: Column | None = None) -> DataFrame:
    """A user's events as a ride's seconds, or those of several users, as `users` makes an id of them."""
    w = Window.partitionBy("activity_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("activity_id", F.col("user_id") if users is None else users)
    return e.select(
        "activity_id", (F.row_number().over(w) - 1).alias("idx"), F.floor(F.col("value") * 5).cast("int").alias("power"),
        (90 + F.get_json_object("props", "$.k").cast("int")).alias("heart_rate"), F.when(F.col("event_type") == "view", 0.0).otherwise(8.0).alias("speed"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "activity_id")
    w = Window.partitionBy("activity_id").orderBy("ts", "event_id")
    none = F.lit(None).cast("double")
    return e.select(
        "activity_id", F.row_number().over(w).alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long").alias("ts"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 6).cast("int")).alias("power"), (90 + F.get_json_object("props", "$.k").cast("int")).alias("heart_rate"),
        F.lit(None).cast("int").alias("cadence"), none.alias("speed"), none.alias("altitude"), none.alias("distance"),
    )


def activity_power(spark, d):
    p = m.power_summary(rides(spark, d), ATHLETE.ftp)
    return p.select("activity_id", "seconds", "moving_seconds", "max_power", *[milli(c).alias(c) for c in ("avg_power", "work_kj", "np", "intensity", "vi", "tss")])


def activity_heart_rate(spark, d):
    h = m.heart_rate_summary(rides(spark, d), ATHLETE)
    return h.select("activity_id", "max_hr", *[milli(c).alias(c) for c in ("avg_hr", "hr_tss", "decoupling")])


def activity_zones(spark, d):
    z = m.zones_of_activity(rides(spark, d), ATHLETE)
    names = [("power_zones", i) for i in range(7)] + [("hr_zones", i) for i in range(7)]
    return z.select("activity_id", *[F.col(n)[i].alias(f"{n[:2]}_z{i + 1}") for n, i in names])


def activity_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: power, heart rate, zones and least W' balance of every ride."""
    a = analyze(rides(spark, d), ATHLETE)
    names = {"normalized_power": "np", "intensity_factor": "intensity", "tss": "tss", "work_kj": "work_kj", "hr_tss": "hr_tss", "decoupling_pct": "decoupling", "min_w_prime_balance": "least_balance"}
    return a.select("activity_id", F.col("recording_time_s").alias("seconds"), "max_power", "max_hr", F.col("min_w_prime_at").alias("least_at"), *[milli(c).alias(n) for c, n in names.items()], (milli("normalized_power") * 1000 / milli("average_hr")).cast("long").alias("ef"), F.col("power_zone_seconds")[6].alias("po_z7"))


def activity_analysis(spark, d):
    """What activity_summary leaves out: times, shares and all zones."""
    a = analyze(rides(spark, d), ATHLETE)
    whole = [F.col(f"{n}_zone_seconds")[i].alias(f"{n[:2]}_z{i + 1}") for n in ("power", "hr") for i in range(7)]
    return a.select("activity_id", "elapsed_time_s", "moving_time_s", *[milli(c).alias(c) for c in ("average_power", "average_watts_per_kg", "variability_index", "average_hr", "efficiency_factor")], *whole)


def long_mean_max(spark, d):
    """Every tenth user's events as one ride, which is long enough for the long durations."""
    return m.mean_max_at(rides(spark, d, F.col("user_id") % 10), DURATIONS)


def long_power(spark, d):
    p = m.power_summary(rides(spark, d, F.col("user_id") % 10), ATHLETE.ftp)
    return p.select("activity_id", "seconds", "moving_seconds", "max_power", *[milli(c).alias(c) for c in ("avg_power", "work_kj", "np", "intensity", "vi", "tss")])


def long_fit(spark, d):
    """The fit and the estimate of rides of many minutes, by every second of their ranges."""
    s = curves(rides(spark, d, F.col("user_id") % 10))
    return s.select("activity_id", F.col("cp_fit.points").cast("long").alias("points"), *[milli(f"cp_fit.{c}").alias(c) for c in ("cp", "w_prime", "rmse")], F.col("eftp.duration_s").alias("eftp_s"), milli("eftp.eftp").alias("eftp"))


def resample_series(spark, d):
    s, _ = resample(ticks(spark, d), cfg=ResampleConfig(max_power=1000))
    return s.select("activity_id", "idx", "elapsed", "power", "power_dropout", "heart_rate", "state", "segment", "segment_start")


def resample_report(spark, d):
    return resample(ticks(spark, d), cfg=ResampleConfig(max_power=1000))[1].drop("timer_paused_records")


def timer_ticks(spark, d):
    """Purchases stop the timer, sign-ups start it again."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "activity_id")
    w = Window.partitionBy("activity_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "purchase", "stop").when(F.col("event_type") == "signup", "start")
    return e.select("activity_id", F.row_number().over(w).alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long").alias("ts"), kind.alias("kind")).where("kind is not null")


def timer_series(spark, d):
    """resample_series with the timer's pauses cut out."""
    s, _ = resample(ticks(spark, d), timer_ticks(spark, d), ResampleConfig(max_power=1000, use_timer_events=True))
    return s.select("activity_id", "idx", "elapsed", "power", "power_dropout", "heart_rate", "state", "segment", "segment_start")


def timer_report(spark, d):
    return resample(ticks(spark, d), timer_ticks(spark, d), ResampleConfig(max_power=1000, use_timer_events=True))[1]


def mean_max(spark, d):
    return m.mean_max_at(rides(spark, d), DURATIONS)


def full_power_curve(spark, d):
    return m.envelope(m.power_curve(rides(spark, d))).select("activity_id", "duration_s", "best_sum", milli("envelope").alias("envelope"))


def season_best(spark, d):
    c = m.mean_max_at(rides(spark, d), DURATIONS)
    return m.season_curve(c.withColumn("athlete_id", F.col("activity_id") % 10).withColumn("added", F.col("activity_id")), "athlete_id")


def improved_durations(spark, d):
    c = m.mean_max_at(rides(spark, d), DURATIONS)
    return season.improved(c.withColumn("athlete_id", F.col("activity_id") % 10).withColumn("added", F.col("activity_id")), "athlete_id")


def w_balance(spark, d):
    b = m.w_prime_balance(rides(spark, d), ATHLETE.cp, ATHLETE.w_prime)
    return m.least_balance(b).select("activity_id", F.col("idx").alias("least_at"), milli("balance").alias("least_balance"))


def loads(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.select("c_nationkey", F.col("o_orderkey").alias("seq"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), (F.floor(F.col("o_totalprice") * 100) / 1000000).alias("load"))


def daily_load(spark, d):
    return m.daily_loads(loads(spark, d), "c_nationkey", "seq").select("c_nationkey", "day", milli("load").alias("load"))


def fitness(spark, d):
    daily = m.daily_loads(loads(spark, d), "c_nationkey", "seq")
    today = m.training_load(daily, "c_nationkey").withColumnsRenamed({"ctl": "ctl0", "atl": "atl0", "tsb": "tsb0"})
    both = m.training_load(today, "c_nationkey", m.LoadConfig(exponential=False, tsb_of_yesterday=True))
    return both.select("c_nationkey", "day", *[milli(f"{c}0").alias(c) for c in ("ctl", "atl", "tsb")], milli("tsb").alias("tsb_yesterday"))


def season_summary(spark, d):
    """An athlete's form on a fixed day with the season's curve over elapsed time, its fit and estimate."""
    c = mean_max_elapsed(paused_rides(spark, d), GRID).select((F.col("activity_id") % 10).alias("athlete_id"), "duration_s", (F.col("best_sum") / F.col("duration_s")).alias("watts"))
    s = season.season_summary(plan(spark, d), c, "athlete_id", END_DAY)
    last = F.element_at("season_curve", -1)
    return s.select(
        "athlete_id", "first_day", *[milli(c).alias(c) for c in ("ctl", "atl", "tsb")], F.size("season_curve").cast("long").alias("durations"), last["duration_s"].alias("longest"), milli(last["watts"]).alias("watts"), F.col("cp_2p.points").cast("long").alias("points"),
        *[milli(f"cp_2p.{c}").alias(c) for c in ("cp", "w_prime", "rmse")], F.col("eftp.duration_s").alias("eftp_s"), milli("eftp.eftp").alias("eftp"),
    )


def day_loads(spark, d):
    """Orders as sessions: an athlete's load and minutes of each day."""
    k = F.col("o_orderkey")
    mass, minutes, intensity = F.lit(70.0), 30 + k % 300, (50 + k % 55) / 100
    work = fn.session_work_kj(F.lit(None).cast("double"), minutes, intensity, F.lit(250.0), mass)
    s = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("athlete_id"), season.local_day(F.col("o_orderdate").cast("timestamp"), "Asia/Tokyo").cast("long").alias("day"), minutes.alias("minutes"), fn.session_load(work, mass, intensity).alias("load"))
    return season.day_load(s, "athlete_id").select("athlete_id", "day", milli("load").alias("load"), "training_min")


def critical_power(spark, d):
    p = m.mean_max_at(rides(spark, d), DURATIONS).select("activity_id", F.col("duration_s").cast("double").alias("t"), (F.col("best_sum") / F.col("duration_s")).alias("p"))
    return m.fit_2p(p, "activity_id").select("activity_id", "n", *[milli(c).alias(c) for c in ("cp", "w_prime", "r2", "rmse")])


def eftp(spark, d):
    p = m.mean_max_at(rides(spark, d), DURATIONS).select("activity_id", (F.col("duration_s") * 40).alias("t"), (F.col("best_sum") / F.col("duration_s")).alias("p"))
    return m.estimate_ftp(p, "activity_id").select("activity_id", "duration_s", milli("eftp").alias("eftp"))


def planned_load(spark, d):
    # by order once, for the steps' sums and all that follows
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("activity_id"), F.col("l_linenumber").alias("seq"), "l_quantity").repartition("activity_id")
    steps = line.groupBy("activity_id", "seq").agg(F.sum("l_quantity").cast("int").alias("duration_s"))
    steps = steps.select("*", (40 + F.col("seq") * 12).cast("double").alias("from_pct"), (40 + F.col("seq") * 12 + F.col("duration_s") % 3 * 5).cast("double").alias("to_pct"))
    return m.power_summary(m.workout_profile(steps, 250.0), 250.0).select("activity_id", "seconds", *[milli(c).alias(c) for c in ("avg_power", "np", "tss", "work_kj")])


def workout_files(spark, d):
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("activity_id"), F.col("l_linenumber").alias("seq")).agg(F.sum("l_quantity").cast("int").alias("duration_s"))
    kind = F.when(F.col("seq") == 1, "warmup").when(F.col("seq") > 4, "cooldown").otherwise("active")
    steps = line.select("*", kind.alias("kind"), (40 + F.col("seq") * 12).cast("double").alias("from_pct"), F.when(F.col("seq") % 3 > 0, (40 + F.col("seq") * 12 + 5).cast("double")).alias("to_pct"))
    named = table(spark, d, "orders").select(F.col("o_orderkey").alias("activity_id"), F.concat(F.lit("<"), F.col("o_orderpriority"), F.lit("> & 'more'")).alias("name"))
    return m.to_zwo(named, steps)


def critical_power_3p(spark, d):
    p = m.mean_max_at(rides(spark, d), DURATIONS).select("activity_id", F.col("duration_s").cast("double").alias("t"), (F.col("best_sum") / F.col("duration_s")).alias("p"))
    return m.fit_3p(p, "activity_id").select("activity_id", "n", *[milli(c).alias(c) for c in ("cp", "w_prime", "k", "p_max", "r2", "rmse")])


def sessions(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (30 + k % 240).cast("double").alias("minutes"), ((50 + k % 55) / 100).alias("intensity"), (55 + k % 40).cast("double").alias("mass"), F.when(k % 3 == 0, (k % 2000).cast("double")).alias("planned"), (k % 14).cast("double").alias("gap"))


def fuelling_rules(spark, d):
    c = F.col
    s = sessions(spark, d)
    s = s.withColumn("work", fn.session_work_kj(c("planned"), c("minutes"), c("intensity"), F.lit(None).cast("double"), c("mass"))).withColumn("load", fn.session_load(c("work"), c("mass"), c("intensity")))
    rate, hours = fn.recovery_hours(c("load"), c("gap"))
    return s.select(
        "o_orderkey", milli("work").alias("work"), milli("load").alias("load"), milli(fn.carbs_g_per_kg(c("load"))).alias("carbs"), milli(fn.protein_g_per_kg(c("load"))).alias("protein"), fn.load_band(c("load")).alias("band"),
        milli(fn.pre_ride_hours(c("load"), c("gap"))).alias("pre_hours"), fn.in_ride_g_per_hour(c("minutes"), c("intensity")).alias("in_ride"), fn.mouth_rinse(c("minutes"), c("intensity")).alias("rinse"), milli(rate).alias("recovery_rate"), hours.cast("long").alias("recovery_hours"),
    )


def plan(spark, d):
    """Orders as planned sessions of ten athletes."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    known = o.select((F.col("o_custkey") % 10).alias("athlete_id"), "date", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), k.alias("seq"), (30 + k % 300).cast("int").alias("minutes"), ((50 + k % 55) / 100).alias("intensity"), F.when(k % 11 == 0, "A").when(k % 5 == 0, "B").alias("priority"))
    return known.withColumns({"tss": F.when(F.col("seq") % 7 > 0, F.col("minutes") / 2), "hr_tss": F.when(F.col("seq") % 14 > 0, F.col("minutes") / 4)})


def season_fitness(spark, d):
    """Fitness to a fixed day; activities after it don't count."""
    f = m.training_load(season.season_loads(plan(spark, d), "athlete_id", END_DAY), "athlete_id")
    return f.select("athlete_id", "day", *[milli(c).alias(c) for c in ("load", "ctl", "atl", "tsb")])


def week_loads(spark, d):
    return season.week_load(plan(spark, d), "athlete_id").select("athlete_id", "week", "sessions", milli("tss").alias("tss"))


def planned_days(spark, d):
    p = season.planned_days(plan(spark, d), "athlete_id")
    return p.select("athlete_id", "day", "longest", "priority", milli("mean_intensity").alias("mean_intensity"), F.col("key.seq").alias("key_seq"))


def raised_targets(spark, d):
    """What a session asks of the two days before, where a day's own target is 3 to 6.9 g/kg by its number; rest days are days, too."""
    p = plan(spark, d)
    days = m.daily_loads(p.select("athlete_id", "day", F.lit(0.0).alias("load")), "athlete_id").select("athlete_id", "day", ((30 + F.col("day") % 40) / 10).alias("own"))
    r = season.raised(days, season.planned_days(p, "athlete_id"), "athlete_id")
    return r.select("athlete_id", "day", milli("to_g_per_kg").alias("target"), "reason", "days_before", "note")


def rounded_grams(spark, d):
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("idx")).agg((F.floor(F.sum("l_quantity") * 16) / 16).alias("grams"))
    return m.round_grams(line, "plan_id").select("plan_id", "idx", "rounded")


def paused_rides(spark, d):
    """rides() with a pause of 50 seconds after every 20 samples."""
    r = rides(spark, d)
    return r.withColumn("elapsed", F.col("idx") + 50 * F.floor(F.col("idx") / 20))


def athlete_settings(spark, d):
    """Of ten athletes two settings each, from day 0 and day 15 on: nations stand in for them. Some leave out values, half have zones of their own."""
    n = F.col("n_nationkey")
    ftp = (800 + 20 * n).cast("double")
    return table(spark, d, "nation").where(n < 20).select(
        (n % 10).alias("athlete_id"), (F.floor(n / 10) * 15).alias("from_day"), ftp.alias("ftp"), (55 + n).cast("double").alias("weight_kg"), (140 + n).cast("double").alias("lthr"), (45 + n % 5).cast("double").alias("resting_hr"),
        (185 + n % 7).cast("double").alias("max_hr"), F.when(n % 3 > 0, ftp - 20).alias("cp"), F.when(n % 4 > 0, (15000 + 500 * n).cast("double")).alias("w_prime"), F.when(n % 2 == 1, "women").alias("trimp"),
        F.when(n % 2 == 1, F.array(*[F.lit(b) for b in (0.5, 0.8, 1.0, 1.3)])).alias("power_zones"),
    )


def athlete_summaries(spark, d):
    """Every ride by the settings that its athlete had on its day, curve over elapsed time, fit and estimate included."""
    r = paused_rides(spark, d)
    known = table(spark, d, "events").select(F.col("user_id").alias("activity_id")).distinct().select("activity_id", (F.col("activity_id") % 10).alias("athlete_id"), (F.col("activity_id") % 30).alias("day"))
    s = summarize(r, settings_on(known, checked_settings(athlete_settings(spark, d))))
    names = {"normalized_power": "np", "intensity_factor": "intensity", "tss": "tss", "average_watts_per_kg": "watts_per_kg", "min_w_prime_balance": "least_balance", "efficiency_factor": "ef", "decoupling_pct": "decoupling", "hr_tss": "hr_tss"}
    best = F.element_at(F.filter("power_curve", lambda x: x["duration_s"] <= 120), -1)
    return s.select(
        "activity_id", F.col("recording_time_s").alias("seconds"), F.col("elapsed_time_s").alias("elapsed"), F.col("moving_time_s").alias("moving"), *[milli(c).alias(n) for c, n in names.items()],
        *[F.get("power_zone_seconds", F.lit(i)).alias(f"po_z{i + 1}") for i in range(7)], *[F.get("hr_zone_seconds", F.lit(i)).alias(f"hr_z{i + 1}") for i in range(7)],
        F.size("power_curve").cast("long").alias("durations"), milli(best["watts"]).alias("best"), F.col("cp_fit.points").cast("long").alias("points"), *[milli(f"cp_fit.{c}").alias(c) for c in ("cp", "w_prime", "rmse", "se_cp")],
        F.col("eftp.duration_s").alias("eftp_s"), milli("eftp.eftp").alias("eftp"), milli("eftp.w_prime").alias("eftp_w_prime"),
    )


def elapsed_curve(spark, d):
    """Best sums over elapsed time, pauses as zeros, at every standard duration."""
    return mean_max_elapsed(paused_rides(spark, d), DURATIONS)


def season_elapsed(spark, d):
    """An athlete's best over elapsed time, with the ride that it is from."""
    c = mean_max_elapsed(paused_rides(spark, d), DURATIONS)
    return m.season_curve(c.withColumn("athlete_id", F.col("activity_id") % 10).withColumn("added", F.col("activity_id")), "athlete_id")


def day_inputs(spark, d):
    """Orders as days and their lines as sessions, of which some overlap."""
    k = F.col("o_orderkey")
    days = table(spark, d, "orders").select(k.alias("plan_id"), (55 + k % 40).cast("double").alias("mass"), (330 + k % 8 * 15).cast("int").alias("wake_min"), F.when(k % 3 == 0, 300 + k % 500).cast("int").alias("tomorrow_start"), F.when(k % 5 == 0, F.lit(7.54)).alias("raised_to"))
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("seq")).agg((F.sum("l_quantity").cast("int") * 2).alias("duration_min"))
    start = 330 + (F.col("seq") - 1) * 130 + F.col("plan_id") % 40
    return days, line.select("plan_id", "seq", start.cast("int").alias("start_min"), "duration_min", ((50 + (F.col("plan_id") + 7 * F.col("seq")) % 45) / 100).alias("intensity"), F.lit(None).cast("double").alias("planned_kj"))


def session_drafts(spark, d):
    """Each session among its neighbours on the clock."""
    s = dayplan.session_drafts(*day_inputs(spark, d))
    return s.select("plan_id", "index", "start_min", "end_min", milli("load").alias("load"), milli("pre_hours").alias("pre_hours"), "pre_time", "replaces_breakfast", milli("during_total").alias("during_total"), "next_start", milli("recovery_rate").alias("recovery_rate"), "recovery_wanted", "post_ride_dinner", "overlaps")


def day_budgets(spark, d):
    """Targets of each day and how its carbohydrate is dealt out; days whose sessions overlap have an error."""
    b = dayplan.day_budgets(*day_inputs(spark, d))
    return b.select("plan_id", "error", F.col("error_index").cast("long").alias("error_index"), "band", "training_min", "exceeds", *[milli(c).alias(c) for c in ("load", "target", "protein_g", "floors", "during", "first_recovery", "fixed", "budget")], F.size("kept").cast("long").alias("meals"), F.array_join(F.transform("hours", lambda h: h.cast("string")), ",").alias("hours"))


def day_timeline(spark, d):
    """What to eat when, in steps of five grams."""
    return dayplan.timeline(dayplan.day_budgets(*day_inputs(spark, d))).select("plan_id", F.col("idx").cast("long").alias("idx"), "time_min", "kind", "session", "hour", "carbs_g", "protein_g")


def json_settings(spark, d):
    """Settings as JSON text made of customers, some of them wrong, read strictly."""
    k = F.col("c_custkey")
    good = F.concat(F.lit('{"ftp": '), (200 + k % 150).cast("string"), F.lit(', "lthr": '), (140 + k % 40).cast("string"), F.lit(', "power_zones": [0.5, '), (k % 5 / 4 + 0.75).cast("string"), F.lit("]}"))
    text = F.when(k % 11 == 0, F.replace(good, F.lit("lthr"), F.lit("lhtr"))).when(k % 13 == 0, F.replace(good, F.lit('"ftp": '), F.lit('"ftp": "about '))).when(k % 17 == 0, F.concat(F.lit("["), good, F.lit("]"))).when(k % 19 == 0, F.lit(" ")).otherwise(good)
    s = json_inputs.settings(table(spark, d, "customer").select("c_custkey", text.alias("text")), "text")
    return s.select("c_custkey", milli("ftp").alias("ftp"), F.col("lthr").cast("long").alias("lthr"), milli(F.get("power_zones", F.lit(1))).alias("zone"), "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (long_mean_max, long_power, long_fit, season_summary, day_loads, timer_series, timer_report, json_settings, session_drafts, day_budgets, day_timeline, athlete_summaries, elapsed_curve, season_elapsed, activity_summary, activity_analysis, improved_durations, season_fitness, week_loads, planned_days, raised_targets, activity_power, activity_heart_rate, activity_zones, resample_series, resample_report, mean_max, full_power_curve, season_best, w_balance, daily_load, fitness, critical_power, critical_power_3p, eftp, planned_load, workout_files, fuelling_rules, rounded_grams)
}

_RIDES = """rides AS (SELECT user_id AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CAST(floor(value * 5) AS INTEGER) AS power,
    90 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS heart_rate, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE 8.0::DOUBLE END AS speed FROM events)"""
_MILLI = lambda e: f"CAST(floor(({e}) * 1000 + 0.5) AS BIGINT)"
_POWER = """np AS (SELECT activity_id, count(*) AS seconds, count(*) FILTER (speed > 0.5) AS moving_seconds, avg(power) AS avg_power, max(power) AS max_power, sum(power) / 1000 AS work_kj,
    sqrt(sqrt(avg(pow(s / 30, 4)) FILTER (n = 30))) AS np FROM (SELECT *, CAST(sum(power) OVER w AS DOUBLE) AS s, count(*) OVER w AS n FROM rides WINDOW w AS (PARTITION BY activity_id ORDER BY idx ROWS 29 PRECEDING)) GROUP BY 1)"""
_TRIMP = lambda h: f"(least(greatest(({h} - 50.0) / 140.0, 0), 1) * 0.64 * exp(1.92 * least(greatest(({h} - 50.0) / 140.0, 0), 1)) / 60)"
_HR = f"""hr AS (SELECT activity_id, avg(heart_rate) AS avg_hr, max(heart_rate) AS max_hr, sum({_TRIMP("heart_rate::DOUBLE")}) FILTER (speed > 0.5) / ({_TRIMP("150::DOUBLE")} * 3600) * 100 AS hr_tss,
    sum(power) FILTER (idx < n // 2) / sum(heart_rate) FILTER (idx < n // 2) AS r1, sum(power) FILTER (idx >= n // 2) / sum(heart_rate) FILTER (idx >= n // 2) AS r2
    FROM (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n FROM rides) GROUP BY 1)"""
_BALANCE = """steps AS (SELECT activity_id, idx, greatest(1000.0::DOUBLE - power, 0) / 20000 AS a, greatest(power - 1000.0::DOUBLE, 0) AS b FROM rides),
    cum AS (SELECT activity_id, idx, b, sum(a) OVER (PARTITION BY activity_id ORDER BY idx) AS big FROM steps),
    bal AS (SELECT activity_id, idx, 20000 - exp(-big) * sum(b * exp(big)) OVER (PARTITION BY activity_id ORDER BY idx) AS balance FROM cum),
    low AS (SELECT activity_id, min(balance) AS least_balance, arg_min(idx, (balance, idx)) AS least_at FROM bal GROUP BY 1)"""
_BEST = lambda ds: f"""d AS (SELECT unnest({ds}) AS duration_s), cum AS (SELECT activity_id, idx + 1 AS k, sum(power) OVER (PARTITION BY activity_id ORDER BY idx) AS total FROM rides UNION ALL SELECT DISTINCT activity_id, 0, 0 FROM rides),
    best AS (SELECT a.activity_id, d.duration_s, CAST(max(b.total - a.total) AS BIGINT) AS best_sum FROM cum a, d, cum b WHERE a.activity_id = b.activity_id AND b.k = a.k + d.duration_s GROUP BY 1, 2)"""  # noqa: E731
_ZONES = lambda c, ref, bounds: ", ".join(f"count(*) FILTER ({c} {'<= ' + str(b) + '::DOUBLE * ' + str(ref) if b else 'IS NOT NULL'}{' AND ' + c + ' > ' + str(a) + '::DOUBLE * ' + str(ref) if a else ''}) AS {('po' if c == 'power' else 'hr')}_z{i + 1}" for i, (a, b) in enumerate(zip((None, *bounds), (*bounds, None))))
_LOADS = """l AS (SELECT c_nationkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, sum(floor(o_totalprice * 100) / 1000000) AS load FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    days AS (SELECT c_nationkey, unnest(range(min(day), max(day) + 1)) AS day FROM l GROUP BY 1), daily AS (SELECT c_nationkey, days.day, coalesce(load, 0) AS load FROM days LEFT JOIN l USING (c_nationkey, day))"""
_TICKS = """t AS (SELECT user_id AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS ts, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 6) AS INTEGER) END AS raw,
      90 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS heart_rate FROM events),
    r AS (SELECT *, coalesce(raw > 1000, false) AS spike, CASE WHEN raw <= 1000 THEN raw END AS power, coalesce(ts < max(ts) OVER (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM t),
    g AS (SELECT activity_id, ts, arg_max(power, seq) FILTER (power IS NOT NULL) AS power, arg_max(heart_rate, seq) AS heart_rate FROM r WHERE NOT late GROUP BY 1, 2),
    p AS (SELECT *, lag(ts) OVER (PARTITION BY activity_id ORDER BY ts) AS prev FROM g),
    b AS (SELECT *, prev IS NULL OR ts - prev > 31 AS brk FROM p),
    s AS (SELECT *, sum(brk::INTEGER) OVER (PARTITION BY activity_id ORDER BY ts) - 1 AS segment FROM b),
    f AS (SELECT activity_id, segment, ts, unnest(CASE WHEN brk THEN [ts] ELSE range(prev + 1, ts + 1) END) AS x, power, heart_rate FROM s),
    q AS (SELECT activity_id, segment, x, x = ts AS recorded, CASE WHEN x = ts THEN power END AS power, CASE WHEN x = ts THEN heart_rate END AS heart_rate FROM f),
    k AS (SELECT *, count(power) OVER w AS run, last_value(power IGNORE NULLS) OVER w AS pa, last_value(CASE WHEN power IS NOT NULL THEN x END IGNORE NULLS) OVER w AS xa, first_value(power IGNORE NULLS) OVER v AS pb, first_value(CASE WHEN power IS NOT NULL THEN x END IGNORE NULLS) OVER v AS xb,
      last_value(heart_rate IGNORE NULLS) OVER w AS ha, last_value(CASE WHEN heart_rate IS NOT NULL THEN x END IGNORE NULLS) OVER w AS hxa, first_value(heart_rate IGNORE NULLS) OVER v AS hb, first_value(CASE WHEN heart_rate IS NOT NULL THEN x END IGNORE NULLS) OVER v AS hxb
      FROM q WINDOW w AS (PARTITION BY activity_id, segment ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY activity_id, segment ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    i AS (SELECT *, CASE WHEN power IS NOT NULL THEN power WHEN sum((recorded AND power IS NULL)::INTEGER) OVER (PARTITION BY activity_id, segment, run) > 8 THEN NULL
      ELSE coalesce(pa + (pb - pa)::DOUBLE * (x - xa) / greatest(xb - xa, 1), pa, pb) END AS pv, coalesce(ha + (hb - ha)::DOUBLE * (x - hxa) / greatest(hxb - hxa, 1), ha, hb) AS hv FROM k),
    o AS (SELECT *, CAST(floor(pv + 0.5) AS INTEGER) AS pw, CAST(floor(hv + 0.5) AS INTEGER) AS hw, row_number() OVER u - 1 AS idx, lag(x) OVER u AS before, lag(recorded) OVER u AS was, x - min(x) OVER (PARTITION BY activity_id) AS elapsed FROM i WINDOW u AS (PARTITION BY activity_id ORDER BY x))"""
_W = "(CASE WHEN planned >= 0 THEN planned ELSE minutes * 60 * greatest(intensity, 0) * (mass * 3) / 1000 END)"
_S = """s AS (SELECT o_orderkey, (30 + o_orderkey % 240)::DOUBLE AS minutes, (50 + o_orderkey % 55)::DOUBLE / 100 AS intensity, (55 + o_orderkey % 40)::DOUBLE AS mass, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 2000)::DOUBLE END AS planned, (o_orderkey % 14)::DOUBLE AS gap FROM orders)"""

_PLAN = """p AS (SELECT o_custkey % 10 AS athlete_id, CAST(o_orderdate AS DATE) AS date, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey AS seq, CAST(30 + o_orderkey % 300 AS INTEGER) AS minutes, (50 + o_orderkey % 55)::DOUBLE / 100 AS intensity,
    CASE WHEN o_orderkey % 11 = 0 THEN 'A' WHEN o_orderkey % 5 = 0 THEN 'B' END AS priority, CASE WHEN o_orderkey % 7 > 0 THEN (30 + o_orderkey % 300)::DOUBLE / 2 WHEN o_orderkey % 14 > 0 THEN (30 + o_orderkey % 300)::DOUBLE / 4 ELSE 0 END AS load, CASE WHEN o_orderkey % 7 > 0 THEN (30 + o_orderkey % 300)::DOUBLE / 2 ELSE 0 END AS tss FROM orders),
    pd AS (SELECT athlete_id, day, max(minutes) AS longest, min(priority) AS priority, sum(minutes * intensity) / sum(minutes) AS mean_intensity, arg_max(seq, (intensity, seq)) FILTER (minutes >= 45 AND intensity >= 0.80::DOUBLE) AS key_seq FROM p GROUP BY 1, 2)"""
_HM = lambda x: f"(CASE WHEN {x} < 60 THEN {x} || ' min' WHEN {x} % 60 = 0 THEN {x} // 60 || ' h' ELSE {x} // 60 || ' h ' || printf('%02d', {x} % 60) || ' min' END)"

_TIMED = """tn AS (SELECT user_id AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS ts, CASE event_type WHEN 'purchase' THEN 'stop' WHEN 'signup' THEN 'start' END AS kind FROM events),
    tw AS (SELECT *, lag(kind, 1, 'start') OVER (PARTITION BY activity_id ORDER BY seq) AS was FROM tn WHERE kind IS NOT NULL), tz AS (SELECT activity_id, ts AS stop, kind, lead(ts) OVER (PARTITION BY activity_id ORDER BY seq) AS start FROM tw WHERE kind <> was), pz AS (SELECT * FROM tz WHERE kind = 'stop'),
    """ + _TICKS.replace(
    "    r AS (SELECT *, coalesce(raw > 1000, false) AS spike,",
    "    tp AS (SELECT *, EXISTS (SELECT 1 FROM pz WHERE pz.activity_id = t.activity_id AND t.ts >= stop AND (start IS NULL OR t.ts < start)) AS paused FROM t),\n    r AS (SELECT *, coalesce(raw > 1000, false) AS spike,",
).replace("coalesce(ts < max(ts) OVER", "NOT paused AND coalesce(ts < max(CASE WHEN NOT paused THEN ts END) OVER").replace("AS late FROM t)", "AS late FROM tp)").replace("FROM r WHERE NOT late GROUP", "FROM r WHERE NOT late AND NOT paused GROUP").replace(
    "ts - prev > 31 AS brk FROM p)", "ts - prev > 31 OR EXISTS (SELECT 1 FROM pz WHERE pz.activity_id = p.activity_id AND stop > prev AND stop <= ts) AS brk FROM p)"
)
_STEPS = fn.fit_durations(120, 1200)
# best sums over elapsed time: a row for every second of it, pauses as 0
_ELAPSED = lambda ds: f"""paused AS (SELECT *, idx + 50 * (idx // 20) AS elapsed FROM rides), spine AS (SELECT activity_id, unnest(range(max(elapsed) + 1)) AS x FROM paused GROUP BY 1),
    cum AS (SELECT activity_id, x + 1 AS k, sum(coalesce(power, 0)) OVER (PARTITION BY activity_id ORDER BY x) AS total FROM spine LEFT JOIN (SELECT activity_id, elapsed AS x, power FROM paused) USING (activity_id, x) UNION ALL SELECT DISTINCT activity_id, 0, 0 FROM rides),
    d AS (SELECT unnest({ds}) AS duration_s), best AS (SELECT a.activity_id, CAST(d.duration_s AS INTEGER) AS duration_s, CAST(max(b.total - a.total) AS BIGINT) AS best_sum FROM cum a, d, cum b WHERE a.activity_id = b.activity_id AND b.k = a.k + d.duration_s GROUP BY 1, 2)"""  # noqa: E731
_KIND = lambda h: f"(least(greatest(({h} - resting) / (top - resting), 0), 1) * c1 * exp(c2 * least(greatest(({h} - resting) / (top - resting), 0), 1)) / 60)"
_OWN_ZONES = lambda value, ref, bounds, name: ", ".join(f"CASE WHEN len({bounds}) >= {i} THEN count(*) FILTER ({'true' if i == 0 else f'{value} > {bounds}[{i}] * {ref}'} AND (len({bounds}) <= {i} OR {value} <= {bounds}[{i + 1}] * {ref})) END AS {name}_z{i + 1}" for i in range(7))
_SUMMARIES = f"""WITH {_RIDES}, {_ELAPSED('range(1, 2 + (SELECT max(elapsed) FROM paused))')},
    st AS (SELECT n_nationkey % 10 AS athlete, n_nationkey // 10 * 15 AS from_day, (800 + 20 * n_nationkey)::DOUBLE AS ftp, (55 + n_nationkey)::DOUBLE AS kg, (140 + n_nationkey)::DOUBLE AS lthr, (45 + n_nationkey % 5)::DOUBLE AS resting, (185 + n_nationkey % 7)::DOUBLE AS top,
      CASE WHEN n_nationkey % 3 > 0 THEN 780 + 20 * n_nationkey ELSE 800 + 20 * n_nationkey END::DOUBLE AS cp, CASE WHEN n_nationkey % 4 > 0 THEN 15000 + 500 * n_nationkey ELSE 20000 END::DOUBLE AS wp, CASE WHEN n_nationkey % 2 = 1 THEN 0.86 ELSE 0.64 END::DOUBLE AS c1, CASE WHEN n_nationkey % 2 = 1 THEN 1.67 ELSE 1.92 END::DOUBLE AS c2,
      CASE WHEN n_nationkey % 2 = 1 THEN [0.5, 0.8, 1.0, 1.3]::DOUBLE[] ELSE {list(fn.POWER_ZONES)}::DOUBLE[] END AS pb, {list(fn.HR_ZONES)}::DOUBLE[] AS hb FROM nation WHERE n_nationkey < 20),
    act AS (SELECT DISTINCT user_id AS activity_id FROM events), own AS (SELECT activity_id, st.* FROM act JOIN st ON athlete = activity_id % 10 AND from_day <= activity_id % 30 QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY from_day DESC) = 1),
    x AS (SELECT p.*, own.* EXCLUDE (activity_id), count(*) OVER (PARTITION BY p.activity_id) AS n, CAST(sum(power) OVER w AS DOUBLE) AS s30, count(*) OVER w AS n30, CASE WHEN idx % 20 = 0 AND idx > 0 THEN 50 ELSE 0 END AS gap FROM paused p JOIN own USING (activity_id) WINDOW w AS (PARTITION BY p.activity_id ORDER BY idx ROWS 29 PRECEDING)),
    e AS (SELECT *, sum(greatest(cp - power, 0) / wp + gap * (cp / wp)) OVER (PARTITION BY activity_id ORDER BY idx) AS a FROM x),
    b AS (SELECT *, wp - exp(-a) * sum(greatest(power - cp, 0) * exp(a)) OVER (PARTITION BY activity_id ORDER BY idx) AS bal FROM e),
    g AS (SELECT activity_id, count(*) AS seconds, max(elapsed) + 1 AS elapsed, count(*) FILTER (speed > 0.5) AS moving, avg(power) AS ap, sqrt(sqrt(avg(pow(s30 / 30, 4)) FILTER (n30 = 30))) AS np, min(bal) AS bal, avg(heart_rate) AS ahr, any_value(ftp) AS ftp, any_value(kg) AS kg, any_value(wp) AS wp,
      sum({_KIND('heart_rate::DOUBLE')}) FILTER (speed > 0.5) / (any_value({_KIND('lthr')}) * 3600) * 100 AS hr_tss, sum(power) FILTER (idx < n // 2) / sum(heart_rate) FILTER (idx < n // 2) AS r1, sum(power) FILTER (idx >= n // 2) / sum(heart_rate) FILTER (idx >= n // 2) AS r2 FROM b GROUP BY 1),
    z AS (SELECT activity_id, {_OWN_ZONES('power', 'ftp', 'pb', 'po')}, {_OWN_ZONES('heart_rate', 'lthr', 'hb', 'hr')} FROM x GROUP BY activity_id, pb, hb),
    cv AS (SELECT activity_id, count(*) AS durations, arg_max(best_sum / duration_s, duration_s) FILTER (duration_s <= 120) AS best FROM best WHERE duration_s IN ({', '.join(map(str, DURATIONS))}) GROUP BY 1),
    fp AS (SELECT activity_id, duration_s::DOUBLE AS t, best_sum / duration_s AS p FROM best JOIN g USING (activity_id) WHERE duration_s IN ({', '.join(map(str, _STEPS))}) OR (duration_s = elapsed AND elapsed BETWEEN 120 AND 1200)),
    fl AS (SELECT activity_id, count(*) AS points, regr_slope(p * t, t) AS cp, regr_intercept(p * t, t) AS w_prime, regr_sxx(p * t, t) AS sxx FROM fp GROUP BY 1 HAVING count(*) >= 3),
    ff AS (SELECT activity_id, points, cp, w_prime, sqrt(sum(pow(p - (w_prime / t + cp), 2)) / points) AS rmse, sqrt(sum(pow(p * t - (cp * t + w_prime), 2)) / (points - 2) / sxx) AS se_cp FROM fl JOIN fp USING (activity_id) WHERE cp > 0 AND w_prime > 0 GROUP BY activity_id, points, cp, w_prime, sxx),
    ew AS (SELECT activity_id, CASE WHEN w_prime BETWEEN 5000 AND 50000 THEN w_prime ELSE wp END AS w FROM g LEFT JOIN ff USING (activity_id)),
    ef AS (SELECT activity_id, best_sum / duration_s - w / duration_s + w / 3600 AS eftp, duration_s AS eftp_s, w FROM best JOIN ew USING (activity_id) WHERE duration_s BETWEEN 180 AND 1800 QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY eftp DESC, duration_s DESC) = 1)
    SELECT activity_id, seconds, g.elapsed, moving, {_MILLI('np')} AS np, {_MILLI('np / ftp')} AS intensity, {_MILLI('moving * np * (np / ftp) / (ftp * 3600) * 100')} AS tss, {_MILLI('ap / kg')} AS watts_per_kg, {_MILLI('bal')} AS least_balance, {_MILLI('np / ahr')} AS ef, {_MILLI('(r1 - r2) / r1 * 100')} AS decoupling, {_MILLI('hr_tss')} AS hr_tss,
      z.* EXCLUDE (activity_id), durations, {_MILLI('best')} AS best, points, {_MILLI('ff.cp')} AS cp, {_MILLI('w_prime')} AS w_prime, {_MILLI('rmse')} AS rmse, {_MILLI('se_cp')} AS se_cp, eftp_s, {_MILLI('eftp')} AS eftp, {_MILLI('w')} AS eftp_w_prime
    FROM g JOIN z USING (activity_id) JOIN cv USING (activity_id) LEFT JOIN ff USING (activity_id) LEFT JOIN (SELECT activity_id, eftp, eftp_s, w FROM ef) USING (activity_id)"""

_DOWN = lambda x: f"(({x}) - ({x}) % 15)"
_UP = lambda x: f"(({x}) + 14 - (({x}) + 14) % 15)"
_SMALL = lambda k: f"{k} IN ('snack', 'evening_snack')"
_FLOOR = lambda k: f"(greatest(gkg * 0.1, 0.5::DOUBLE) / CASE WHEN {_SMALL(k)} THEN 2 ELSE 1 END * mass)"
_SNACK = lambda out, of: f"""{out}a AS (SELECT *, list_sort(list_concat(list_transform(kept, lambda m: m.t), feeds_at, [{_UP('wake')}])) AS ts FROM {of}),
    {out}b AS (SELECT * EXCLUDE (ts), list_max(list_filter(list_transform(range(1, len(ts)), lambda i: {{'long': ts[i + 1] - ts[i], 'i': i, 'a': ts[i], 'b': ts[i + 1]}}), lambda g: g.long > 210 AND len(list_filter(s, lambda x: x.st < g.b AND x.en > g.a)) = 0)) AS gap FROM {out}a),
    {out} AS (SELECT * EXCLUDE (kept, gap), CASE WHEN base / (feeds + len(kept)) > 0.4::DOUBLE + 1e-9 AND gap IS NOT NULL THEN list_append(kept, {{'k': 'snack', 't': {_DOWN('gap.a + gap.long // 2')}}}) ELSE kept END AS kept FROM {out}b)"""  # noqa: E731
_DRAFTS = f"""dy AS (SELECT o_orderkey AS plan_id, (55 + o_orderkey % 40)::DOUBLE AS mass, CAST(330 + o_orderkey % 8 * 15 AS INTEGER) AS wake, CASE WHEN o_orderkey % 3 = 0 THEN CAST(300 + o_orderkey % 500 AS INTEGER) END AS tomorrow, CASE WHEN o_orderkey % 5 = 0 THEN 7.54::DOUBLE END AS raised FROM orders),
    se AS (SELECT l_orderkey AS plan_id, l_linenumber AS seq, CAST(330 + (l_linenumber - 1) * 130 + l_orderkey % 40 AS INTEGER) AS st, CAST(sum(l_quantity) AS INTEGER) * 2 AS du, (50 + (l_orderkey + 7 * l_linenumber) % 45)::DOUBLE / 100 AS i FROM lineitem GROUP BY 1, 2),
    d1 AS (SELECT *, st + du AS en, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, lag(st + du) OVER w AS before, lead(st) OVER w AS later, du * 60 * i * (mass * 3) / 1000 / mass * least(greatest(i / 0.75, 0.6), 1.4) AS load FROM se JOIN dy USING (plan_id) WINDOW w AS (PARTITION BY plan_id ORDER BY seq)),
    d2 AS (SELECT *, coalesce(before, wake) AS early, least(greatest(load / 35, 0), 1) AS need, coalesce(later, tomorrow + 1440) AS nx, least(greatest((i - 0.55) / 0.30, 0), 1) AS sc FROM d1),
    d3 AS (SELECT *, greatest(floor(least(greatest(least(1 + 3 * need, greatest(greatest(st - early, 0) / 60, 1)), 1), 4) * 2) / 2, 1) AS hrs, floor(CASE WHEN du <= 45 THEN 0 WHEN du <= 75 THEN 30 * sc WHEN du <= 120 THEN 30 + 30 * sc WHEN du <= 150 THEN 45 + 15 * sc ELSE 60 + 30 * sc END + 0.5) AS rate, CASE WHEN nx IS NOT NULL THEN greatest(nx - en, 0) / 60 END AS gap FROM d2),
    d4 AS (SELECT *, least(greatest({_DOWN('greatest(st - CAST(floor(hrs * 60 + 0.5) AS INTEGER), 0)')}, {_UP('early')}), {_DOWN('st')}) AS pre, rate * du / 60 AS during, CASE WHEN gap < 8 THEN 1 + 0.2 * need ELSE 0 END::DOUBLE AS rec, CASE WHEN gap < 8 THEN CAST(greatest(floor(least(gap, 4)), 1) AS INTEGER) ELSE 0 END AS wanted FROM d3),
    dr AS (SELECT *, idx = 0 AND (st <= wake + 150 OR (hrs >= 2 AND abs(420 - pre) < 60)) AS rep, CASE WHEN 1110 >= greatest(pre - 60, 0) AND 1110 < en + 60 THEN {_UP('en + 30')} END AS din, coalesce(st < before, false) AS ovl FROM d4)"""
_BUDGETS = f"""{_DRAFTS},
    gr AS (SELECT plan_id, list({{'idx': idx, 'st': st, 'du': du, 'en': en, 'hrs': hrs, 'pre': pre, 'rate': rate, 'during': during, 'rec': rec, 'wanted': wanted, 'rep': rep, 'din': din, 'nx': nx, 'load': load}} ORDER BY idx) AS s, min(idx) FILTER (ovl) AS bad, sum(load ORDER BY idx) AS load, sum(du) AS mins FROM dr GROUP BY 1),
    b0 AS (SELECT dy.*, coalesce(s, []) AS s, bad, coalesce(load, 0) AS load, coalesce(mins, 0) AS mins FROM dy LEFT JOIN gr USING (plan_id)),
    b1 AS (SELECT *, floor((CASE WHEN load <= 0 THEN 3 WHEN load < 8 THEN 3 + load * ((5.0::DOUBLE - 3) / 8) WHEN load < 15 THEN 5 + (load - 8) * ((6.5::DOUBLE - 5) / 7) WHEN load < 35 THEN 6.5 + (load - 15) * ((9.0::DOUBLE - 6.5) / 20) WHEN load < 60 THEN 9 + (load - 35) * ((12.0::DOUBLE - 9) / 25) ELSE 12 END)::DOUBLE * 10 + 0.5) / 10 AS own, 1.2 + 0.8 * least(load / 60, 1) AS base FROM b0 WHERE bad IS NULL),
    b2 AS (SELECT *, greatest(own, coalesce(floor(raised * 10 + 0.5) / 10, 0)) AS gkg, (list_filter(list_transform(s, lambda x: x.din), lambda t: t IS NOT NULL))[-1] AS pd, coalesce(list_sum(list_transform(s, lambda x: (x.hrs >= 2 OR x.rep)::INTEGER + (x.din IS NULL)::INTEGER)), 0) AS feeds,
      flatten(list_transform(s, lambda x: CASE WHEN x.hrs >= 2 OR x.rep THEN [x.pre, coalesce(x.din, {_UP('x.en')})] ELSE [coalesce(x.din, {_UP('x.en')})] END)) AS feeds_at FROM b1),
    b3 AS (SELECT *, list_concat(list_transform(list_filter([{{'k': 'breakfast', 't': 420}}, {{'k': 'lunch', 't': 750}}, {{'k': 'dinner', 't': 1110}}, {{'k': 'evening_snack', 't': 1290}}], lambda m: NOT ((m.k = 'breakfast' AND len(list_filter(s, lambda x: x.rep)) > 0) OR (m.k = 'dinner' AND pd IS NOT NULL) OR coalesce(m.k = 'evening_snack' AND m.t < pd + 90, false)
        OR len(list_filter(s, lambda x: abs(m.t - x.pre) < 60 OR (x.din IS NULL AND abs(m.t - {_UP('x.en')}) < 60) OR (m.t >= greatest(x.st - 30, 0) AND m.t < x.en))) > 0)), lambda m: {{'k': m.k, 't': {_UP('m.t')}}}), CASE WHEN pd IS NULL THEN [] ELSE [{{'k': 'post_ride_dinner', 't': pd}}] END) AS stay FROM b2),
    b4 AS (SELECT * EXCLUDE (stay), CASE WHEN len(stay) > 0 THEN stay ELSE [{{'k': 'dinner', 't': {_UP('greatest(coalesce(list_max(list_transform(s, lambda x: ' + _UP('x.en') + ')), 0) + 60, 1110)')}}}] END AS kept FROM b3),
    {_SNACK('s1', 'b4')}, {_SNACK('s2', 's1')}, {_SNACK('s3', 's2')},
    f1 AS (SELECT *, gkg * mass AS target, list_sum(list_transform(kept, lambda m: {_FLOOR('m.k')})) AS floors, coalesce(list_sum(list_transform(s, lambda x: x.during)), 0) AS during, coalesce(list_sum(list_transform(s, lambda x: CASE WHEN x.wanted > 0 THEN x.rec * mass ELSE 0 END)), 0) AS first FROM s3),
    f2 AS (SELECT *, floors + during + len(s) * mass + first AS fixed FROM f1), f3 AS (SELECT *, fixed > target + 1e-9 AS exceeds, greatest(target - fixed, 0) AS b FROM f2),
    wa AS (SELECT plan_id, x.idx AS idx, greatest(x.hrs - 1, 0) * mass AS wish, b, x.pre AS pre, x.st AS st, mass FROM (SELECT plan_id, unnest(s) AS x, b, mass FROM f3)),
    wb AS (SELECT *, greatest(least(wish, b - coalesce(sum(wish) OVER (PARTITION BY plan_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS extra FROM wa),
    wc AS (SELECT plan_id, list(1 + extra / mass ORDER BY idx) AS pre, list(1 + extra / mass > 2 AND pre + 60 < greatest(st - 60, 0) ORDER BY idx) AS split, greatest(any_value(b) - sum(wish), 0) AS b2 FROM wb GROUP BY 1),
    f4 AS (SELECT f3.*, coalesce(wc.pre, []) AS pre_kg, coalesce(split, []) AS split, coalesce(b2, b) AS b2 FROM f3 LEFT JOIN wc USING (plan_id)),
    rc AS (SELECT plan_id, 0 AS i, b2 AS rest, CAST([] AS INTEGER[]) AS hours, s, mass FROM f4
      UNION ALL SELECT plan_id, i + 1, rest - CASE WHEN x.wanted > 0 THEN x.rec * mass * extra ELSE 0 END, list_append(hours, CASE WHEN x.wanted > 0 THEN extra + 1 ELSE x.wanted END), s, mass FROM (
        SELECT *, CASE WHEN x.wanted > 0 THEN least(CAST(floor(rest / (x.rec * mass)) AS INTEGER), CASE WHEN until IS NULL THEN x.wanted - 1 ELSE least(x.wanted - 1, greatest(CAST(ceil((until - coalesce(x.din, {_UP('x.en')})) / 60) AS INTEGER) - 1, 0)) END) ELSE 0 END AS extra FROM (
          SELECT *, s[i + 1] AS x, coalesce(s[i + 2].pre, CASE WHEN s[i + 1].nx IS NOT NULL THEN greatest(s[i + 1].nx - 60, 0) END) AS until FROM rc WHERE i < len(s)))),
    rd AS (SELECT plan_id, rest, hours FROM rc WHERE i = len(s)),
    f5 AS (SELECT f4.*, rest, hours, feeds + len(kept) AS fed, greatest(least(greatest(base, 0.3::DOUBLE * (feeds + len(kept))), 2), base) * mass AS protein FROM f4 JOIN rd USING (plan_id))"""
_ENTRY = lambda t, k, i, h, c, p: f"{{'t': CAST({t} AS INTEGER), 'k': {k}, 'i': CAST({i} AS INTEGER), 'h': CAST({h} AS INTEGER), 'c': CAST({c} AS DOUBLE), 'p': CAST({p} AS DOUBLE)}}"
_TIMELINE = f"""{_BUDGETS}, f6 AS (SELECT *, protein / fed AS each, list_sum(list_transform(kept, lambda m: CASE WHEN {_SMALL('m.k')} THEN 0.5 ELSE 1 END)) AS weights FROM f5),
    z AS (SELECT plan_id, list_concat(flatten(list_transform(s, lambda x: list_concat(
        [{_ENTRY('x.pre', "'pre_session'", 'x.idx', 'NULL', 'pre_kg[x.idx + 1] * mass * CASE WHEN split[x.idx + 1] THEN 0.75 ELSE 1 END', 'CASE WHEN x.hrs >= 2 OR x.rep THEN each ELSE 0 END')}],
        CASE WHEN split[x.idx + 1] THEN [{_ENTRY(_DOWN('greatest(x.st - 60, 0)'), "'pre_session_top_up'", 'x.idx', 'NULL', 'pre_kg[x.idx + 1] * mass - pre_kg[x.idx + 1] * mass * 0.75', '0')}] ELSE [] END,
        CASE WHEN x.rate > 0 AND (x.du - 1) // 30 > 0 THEN list_transform(range(1, (x.du - 1) // 30 + 1), lambda k: {_ENTRY('greatest(' + _DOWN('x.st + k * 30') + ', ' + _UP('x.st + 1') + ')', "'during_session'", 'x.idx', 'NULL', 'x.during / ((x.du - 1) // 30)', '0')}) ELSE [] END,
        CASE WHEN hours[x.idx + 1] > 0 THEN list_transform(range(0, hours[x.idx + 1]), lambda h: CASE WHEN h = 0 AND x.din IS NOT NULL THEN {_ENTRY('x.din', "'post_ride_dinner'", 'NULL', 'NULL', 'x.rec * mass', '0')} ELSE {_ENTRY('coalesce(x.din, ' + _UP('x.en') + ') + h * 60', "'recovery'", 'x.idx', 'h', 'x.rec * mass', 'CASE WHEN h = 0 THEN each ELSE 0 END')} END)
          WHEN x.din IS NULL THEN [{_ENTRY(_UP('x.en'), "'recovery'", 'x.idx', '0', '0', 'each')}] ELSE [] END))),
      list_transform(kept, lambda m: {_ENTRY('m.t', 'm.k', 'NULL', 'NULL', _FLOOR('m.k') + " + rest * CASE WHEN " + _SMALL('m.k') + " THEN 0.5 ELSE 1 END / weights", 'each')})) AS es FROM f6),
    y AS (SELECT plan_id, es[n] AS e, n FROM (SELECT plan_id, es, unnest(range(1, len(es) + 1)) AS n FROM z)),
    g1 AS (SELECT plan_id, e.t AS time_min, e.k AS kind, e.i AS session, e.h AS hour, min(n) AS n, sum(e.c) AS c, sum(e.p) AS p FROM y GROUP BY ALL),
    g2 AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY time_min, n) - 1 AS idx, floor(c / 5) AS cb, c / 5 - floor(c / 5) AS cr, floor(p / 5) AS pb, p / 5 - floor(p / 5) AS pr FROM g1),
    g3 AS (SELECT *, floor(sum(c) OVER v / 5 + 0.5) - sum(cb) OVER v AS cm, floor(sum(p) OVER v / 5 + 0.5) - sum(pb) OVER v AS pm, row_number() OVER (PARTITION BY plan_id ORDER BY cr DESC, idx) AS ck, row_number() OVER (PARTITION BY plan_id ORDER BY pr DESC, idx) AS pk FROM g2 WINDOW v AS (PARTITION BY plan_id))"""

ORACLE_SQL: dict[str, str] = {
    "json_settings": f"""SELECT c_custkey, CASE WHEN e IS NULL AND NOT blank THEN CAST((200 + c_custkey % 150) * 1000 AS BIGINT) END AS ftp, CASE WHEN e IS NULL AND NOT blank THEN CAST(140 + c_custkey % 40 AS BIGINT) END AS lthr, CASE WHEN e IS NULL AND NOT blank THEN {_MILLI('c_custkey % 5 / 4.0 + 0.75')} END AS zone, e AS error
        FROM (SELECT c_custkey, c_custkey % 19 = 0 AND c_custkey % 11 > 0 AND c_custkey % 13 > 0 AND c_custkey % 17 > 0 AS blank, CASE WHEN c_custkey % 11 = 0 THEN 'the text: unknown key lhtr' WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'the text: no JSON object' END AS e FROM customer)""",
    "session_drafts": f"WITH {_DRAFTS} SELECT plan_id, idx AS index, st AS start_min, en AS end_min, {_MILLI('load')} AS load, {_MILLI('hrs')} AS pre_hours, pre AS pre_time, rep AS replaces_breakfast, {_MILLI('during')} AS during_total, nx AS next_start, {_MILLI('rec')} AS recovery_rate, wanted AS recovery_wanted, din AS post_ride_dinner, ovl AS \"overlaps\" FROM dr",
    "day_budgets": f"WITH RECURSIVE {_BUDGETS} SELECT plan_id, CASE WHEN bad IS NOT NULL THEN 'overlap' END AS error, CAST(bad AS BIGINT) AS error_index, CASE WHEN gkg < 5 THEN 'light' WHEN gkg < 6.5 THEN 'moderate' WHEN gkg < 9 THEN 'high' WHEN gkg >= 9 THEN 'very_high' END AS band, f5.mins AS training_min, exceeds, {', '.join(_MILLI(c) + ' AS ' + n for c, n in (('f5.load', 'load'), ('target', 'target'), ('protein', 'protein_g'), ('floors', 'floors'), ('during', 'during'), ('first', 'first_recovery'), ('fixed', 'fixed'), ('rest', 'budget')))}, len(kept) AS meals, array_to_string(hours, ',') AS hours FROM (SELECT plan_id, bad FROM b0) LEFT JOIN (SELECT * EXCLUDE (bad) FROM f5) f5 USING (plan_id)",
    "day_timeline": f"WITH RECURSIVE {_TIMELINE} SELECT plan_id, idx, time_min, kind, session, hour, CAST((cb + (ck <= cm)::INTEGER) * 5 AS BIGINT) AS carbs_g, CAST((pb + (pk <= pm)::INTEGER) * 5 AS BIGINT) AS protein_g FROM g3",
    "athlete_summaries": _SUMMARIES,
    "elapsed_curve": f"WITH {_RIDES}, {_ELAPSED(DURATIONS)} SELECT * FROM best",
    "season_elapsed": f"WITH {_RIDES}, {_ELAPSED(DURATIONS)} SELECT activity_id % 10 AS athlete_id, duration_s, max(best_sum) AS best_sum, arg_max(activity_id, (best_sum, -activity_id)) AS source FROM best GROUP BY 1, 2",
    "activity_analysis": f"WITH {_RIDES}, {_POWER}, {_HR}, z AS (SELECT activity_id, {_ZONES('power', 1000, fn.POWER_ZONES)}, {_ZONES('heart_rate', 150, fn.HR_ZONES)} FROM rides GROUP BY 1) SELECT z.*, seconds AS elapsed_time_s, moving_seconds AS moving_time_s, {_MILLI('avg_power')} AS average_power, {_MILLI('avg_power / 72')} AS average_watts_per_kg, {_MILLI('np / avg_power')} AS variability_index, {_MILLI('avg_hr')} AS average_hr, {_MILLI('np / avg_hr')} AS efficiency_factor FROM np JOIN hr USING (activity_id) JOIN z USING (activity_id)",
    "improved_durations": f"WITH {_RIDES}, {_BEST(DURATIONS)}, i AS (SELECT activity_id % 10 AS athlete_id, activity_id, duration_s, best_sum, max(best_sum) OVER (PARTITION BY activity_id % 10, duration_s ORDER BY activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best) SELECT * FROM i WHERE before IS NULL OR best_sum > before",
    "season_fitness": f"WITH RECURSIVE {_PLAN}, s AS (SELECT athlete_id, day, sum(load) AS load FROM p GROUP BY 1, 2), daily AS (SELECT athlete_id, d.day, coalesce(load, 0) AS load FROM (SELECT athlete_id, unnest(range(least(min(day), {END_DAY}), {END_DAY} + 1)) AS day FROM p GROUP BY 1) d LEFT JOIN s USING (athlete_id, day)), n AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY day) AS k FROM daily), f AS (SELECT athlete_id, 0::BIGINT AS k, 0::BIGINT AS day, 0.0::DOUBLE AS load, 0.0::DOUBLE AS ctl, 0.0::DOUBLE AS atl FROM n WHERE k = 1 UNION ALL SELECT n.athlete_id, n.k, n.day, n.load, f.ctl + (n.load - f.ctl) * (1 - exp(-1 / 42.0::DOUBLE)), f.atl + (n.load - f.atl) * (1 - exp(-1 / 7.0::DOUBLE)) FROM f JOIN n ON n.athlete_id = f.athlete_id AND n.k = f.k + 1) SELECT athlete_id, day, {_MILLI('load')} AS load, {_MILLI('ctl')} AS ctl, {_MILLI('atl')} AS atl, {_MILLI('ctl - atl')} AS tsb FROM f WHERE k > 0",
    "week_loads": f"WITH {_PLAN} SELECT athlete_id, CAST(date_trunc('week', date) AS DATE) AS week, count(*) AS sessions, {_MILLI('sum(tss)')} AS tss FROM p GROUP BY 1, 2",
    "planned_days": f"WITH {_PLAN} SELECT athlete_id, day, longest, priority, {_MILLI('mean_intensity')} AS mean_intensity, key_seq FROM pd",
    "raised_targets": f"""WITH {_PLAN}, days AS (SELECT athlete_id, unnest(range(min(day), max(day) + 1)) AS day FROM p GROUP BY 1), o AS (SELECT athlete_id, day, (30 + day % 40)::DOUBLE / 10 AS own FROM days),
        c AS (SELECT o.*, 1 AS rank, 10 + 2 * least(greatest((longest - 90) / 180::DOUBLE, 0), 1) AS g, 'carb_load' AS reason, 1 AS k, longest AS mn, NULL::DOUBLE AS i FROM o JOIN pd ON pd.athlete_id = o.athlete_id AND pd.day = o.day + 1 WHERE priority = 'A' AND longest > 90
          UNION ALL SELECT o.*, 2, CASE WHEN longest >= 240 THEN 8 ELSE 5 + 2 * (longest - 90) / 150::DOUBLE END, CASE WHEN longest >= 240 THEN 'very_long_session_tomorrow' ELSE 'long_session_tomorrow' END, 1, longest, NULL FROM o JOIN pd ON pd.athlete_id = o.athlete_id AND pd.day = o.day + 1 WHERE longest > 90
          UNION ALL SELECT o.*, 4, 5.5, 'key_session_tomorrow', 1, p.minutes, p.intensity FROM o JOIN pd ON pd.athlete_id = o.athlete_id AND pd.day = o.day + 1 JOIN p ON p.seq = key_seq
          UNION ALL SELECT o.*, 5, 10 + 2 * least(greatest((longest - 90) / 180::DOUBLE, 0), 1), 'carb_load', 2, longest, NULL FROM o JOIN pd ON pd.athlete_id = o.athlete_id AND pd.day = o.day + 2 WHERE priority = 'A' AND longest > 90),
        b AS (SELECT * FROM c WHERE g > own + 1e-9 QUALIFY row_number() OVER (PARTITION BY athlete_id, day ORDER BY g DESC, rank) = 1)
        SELECT athlete_id, day, {_MILLI('coalesce(g, own)')} AS target, reason, k AS days_before, CASE WHEN reason = 'carb_load' THEN 'Carb-loading: ' || {_HM('mn')} || CASE k WHEN 1 THEN ' A event tomorrow' ELSE ' A event in 2 days' END WHEN reason = 'key_session_tomorrow' THEN 'Raised: hard ' || {_HM('mn')} || ' session tomorrow (IF ' || printf('%.2f', i) || ')' WHEN reason IS NOT NULL THEN 'Raised: ' || {_HM('mn')} || ' ride tomorrow' END AS note
        FROM o LEFT JOIN (SELECT athlete_id, day, g, reason, k, mn, i FROM b) USING (athlete_id, day)""",
    "activity_power": f"WITH {_RIDES}, {_POWER} SELECT activity_id, seconds, moving_seconds, max_power, {_MILLI('avg_power')} AS avg_power, {_MILLI('work_kj')} AS work_kj, {_MILLI('np')} AS np, {_MILLI('np / 1000')} AS intensity, {_MILLI('np / avg_power')} AS vi, {_MILLI('moving_seconds * np * (np / 1000) / (1000.0::DOUBLE * 3600) * 100')} AS tss FROM np",
    "activity_heart_rate": f"WITH {_RIDES}, {_HR} SELECT activity_id, max_hr, {_MILLI('avg_hr')} AS avg_hr, {_MILLI('hr_tss')} AS hr_tss, {_MILLI('(r1 - r2) / r1 * 100')} AS decoupling FROM hr",
    "activity_zones": f"WITH {_RIDES} SELECT activity_id, {_ZONES('power', 1000, fn.POWER_ZONES)}, {_ZONES('heart_rate', 150, fn.HR_ZONES)} FROM rides GROUP BY 1",
    "activity_summary": f"WITH {_RIDES}, {_POWER}, {_HR}, {_BALANCE} SELECT activity_id, seconds, max_power, max_hr, least_at, {_MILLI('np')} AS np, {_MILLI('np / 1000')} AS intensity, {_MILLI('moving_seconds * np * (np / 1000) / (1000.0::DOUBLE * 3600) * 100')} AS tss, {_MILLI('work_kj')} AS work_kj, {_MILLI('hr_tss')} AS hr_tss, {_MILLI('(r1 - r2) / r1 * 100')} AS decoupling, {_MILLI('least_balance')} AS least_balance, {_MILLI('np')} * 1000 // {_MILLI('avg_hr')} AS ef, (SELECT count(*) FROM rides x WHERE x.activity_id = np.activity_id AND x.power > 1.5::DOUBLE * 1000) AS po_z7 FROM np JOIN hr USING (activity_id) JOIN low USING (activity_id)",
    "resample_series": f"WITH {_TICKS} SELECT activity_id, idx, elapsed, coalesce(pw, 0) AS power, pw IS NULL AS power_dropout, hw AS heart_rate, CASE WHEN recorded THEN 'recorded' ELSE 'filled' END AS state, segment, coalesce(x - before > 1, true) AS segment_start FROM o",
    "resample_report": f"WITH {_TICKS}, c AS (SELECT activity_id, count(*) AS records, count(*) FILTER (late) AS out_of_order, count(*) FILTER (spike) AS power_spikes, count(*) FILTER (NOT late) AS kept FROM r GROUP BY 1), m AS (SELECT activity_id, count(*) FILTER (recorded) AS n, count(*) FILTER (NOT recorded AND was) AS gaps_filled, count(*) FILTER (NOT recorded) AS gap_seconds_filled, count(*) FILTER (x - before > 1) AS pauses, coalesce(sum(x - before - 1) FILTER (x - before > 1), 0)::BIGINT AS paused_seconds, count(*) FILTER (recorded AND power IS NULL AND pw IS NOT NULL) AS power_dropouts_repaired, CASE WHEN count(pw) > 0 THEN count(*) FILTER (pw IS NULL) ELSE 0 END AS power_dropout_seconds, count(*) FILTER (recorded AND heart_rate IS NULL AND hw IS NOT NULL) AS hr_dropouts_repaired FROM o GROUP BY 1) SELECT activity_id, records, kept - n AS duplicates, out_of_order, power_spikes, gaps_filled, gap_seconds_filled, pauses, paused_seconds, power_dropouts_repaired, power_dropout_seconds, hr_dropouts_repaired FROM c JOIN m USING (activity_id)",
    "mean_max": f"WITH {_RIDES}, {_BEST(DURATIONS)} SELECT * FROM best",
    "full_power_curve": f"WITH {_RIDES}, {_BEST('range(1, 1 + (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)))')} SELECT *, {_MILLI('max(best_sum / duration_s) OVER (PARTITION BY activity_id ORDER BY duration_s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS envelope FROM best",
    "season_best": f"WITH {_RIDES}, {_BEST(DURATIONS)} SELECT activity_id % 10 AS athlete_id, duration_s, max(best_sum) AS best_sum, arg_max(activity_id, (best_sum, -activity_id)) AS source FROM best GROUP BY 1, 2",
    "w_balance": f"WITH {_RIDES}, {_BALANCE} SELECT activity_id, least_at, {_MILLI('least_balance')} AS least_balance FROM low",
    "daily_load": f"WITH {_LOADS} SELECT c_nationkey, day, {_MILLI('load')} AS load FROM daily",
    "fitness": f"WITH RECURSIVE {_LOADS}, n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY day) AS k FROM daily), f AS (SELECT c_nationkey, 0::BIGINT AS k, 0::BIGINT AS day, 0.0::DOUBLE AS ctl, 0.0::DOUBLE AS atl, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS a2, 0.0::DOUBLE AS y FROM n WHERE k = 1 UNION ALL SELECT n.c_nationkey, n.k, n.day, f.ctl + (n.load - f.ctl) * (1 - exp(-1 / 42.0::DOUBLE)), f.atl + (n.load - f.atl) * (1 - exp(-1 / 7.0::DOUBLE)), f.c2 + (n.load - f.c2) * (1 / 42.0::DOUBLE), f.a2 + (n.load - f.a2) * (1 / 7.0::DOUBLE), f.c2 - f.a2 FROM f JOIN n ON n.c_nationkey = f.c_nationkey AND n.k = f.k + 1) SELECT c_nationkey, day, {_MILLI('ctl')} AS ctl, {_MILLI('atl')} AS atl, {_MILLI('ctl - atl')} AS tsb, {_MILLI('y')} AS tsb_yesterday FROM f WHERE k > 0",
    "critical_power": f"WITH {_RIDES}, {_BEST(DURATIONS)}, p AS (SELECT activity_id, duration_s::DOUBLE AS t, best_sum / duration_s AS p FROM best), l AS (SELECT activity_id, count(*) AS n, regr_slope(p * t, t) AS cp, regr_intercept(p * t, t) AS w_prime, avg(p) AS mean FROM p GROUP BY 1 HAVING count(*) >= 3 AND regr_slope(p * t, t) > 0 AND regr_intercept(p * t, t) > 0), s AS (SELECT activity_id, n, cp, w_prime, sum(pow(p - (w_prime / t + cp), 2)) AS ss, sum(pow(p - mean, 2)) AS tot FROM p JOIN l USING (activity_id) GROUP BY 1, 2, 3, 4) SELECT activity_id, n, {_MILLI('cp')} AS cp, {_MILLI('w_prime')} AS w_prime, {_MILLI('CASE WHEN tot > 0 THEN 1 - ss / tot ELSE 1 END')} AS r2, {_MILLI('sqrt(ss / n)')} AS rmse FROM s",
    "eftp": f"WITH {_RIDES}, {_BEST(DURATIONS)}, p AS (SELECT activity_id, duration_s * 40 AS t, best_sum / duration_s AS p FROM best), l AS (SELECT activity_id, regr_intercept(p * t, t) AS w FROM p WHERE t BETWEEN 120 AND 1200 GROUP BY 1 HAVING count(*) >= 3 AND regr_slope(p * t, t) > 0 AND regr_intercept(p * t, t) > 0), e AS (SELECT activity_id, t, p - v / t + v / 3600 AS e FROM (SELECT p.*, CASE WHEN w BETWEEN 5000 AND 50000 THEN w ELSE 20000.0::DOUBLE END AS v FROM p LEFT JOIN l USING (activity_id) WHERE t BETWEEN 180 AND 1800)) SELECT activity_id, arg_max(t, (e, t)) AS duration_s, {_MILLI('max(e)')} AS eftp FROM e GROUP BY 1",
    "planned_load": f"WITH st AS (SELECT l_orderkey AS activity_id, l_linenumber AS seq, CAST(sum(l_quantity) AS INTEGER) AS dur FROM lineitem GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg, (40 + seq * 12)::DOUBLE AS f, (40 + seq * 12 + dur % 3 * 5)::DOUBLE AS t FROM st), rides AS (SELECT activity_id, beg + k AS idx, CAST(floor((f + (t - f) * (k + 0.5::DOUBLE) / dur) / 100 * 250 + 0.5) AS INTEGER) AS power, 8.0::DOUBLE AS speed FROM (SELECT *, unnest(range(0, dur)) AS k FROM b)), {_POWER} SELECT activity_id, seconds, {_MILLI('avg_power')} AS avg_power, {_MILLI('np')} AS np, {_MILLI('seconds * np * (np / 250) / (250.0::DOUBLE * 3600) * 100')} AS tss, {_MILLI('work_kj')} AS work_kj FROM np",
    "fuelling_rules": f"WITH {_S}, w AS (SELECT *, {_W} AS work FROM s), l AS (SELECT *, work / mass * least(greatest(intensity / 0.75, 0.6), 1.4) AS load FROM w), q AS (SELECT *, least(greatest(load / 35, 0), 1) AS dem, least(greatest((intensity - 0.55) / 0.30::DOUBLE, 0), 1) AS z FROM l) SELECT o_orderkey, {_MILLI('work')} AS work, {_MILLI('load')} AS load, {_MILLI('CASE WHEN load <= 0 THEN 3 WHEN load < 8 THEN 3 + load * (2.0::DOUBLE / 8) WHEN load < 15 THEN 5 + (load - 8) * (1.5::DOUBLE / 7) WHEN load < 35 THEN 6.5 + (load - 15) * (2.5::DOUBLE / 20) WHEN load < 60 THEN 9 + (load - 35) * (3.0::DOUBLE / 25) ELSE 12 END')} AS carbs, {_MILLI('1.2 + 0.8 * least(greatest(load / 60, 0), 1)')} AS protein, CASE WHEN load < 8 THEN 'light' WHEN load < 15 THEN 'moderate' WHEN load < 35 THEN 'high' ELSE 'very_high' END AS band, {_MILLI('least(greatest(least(1 + 3 * dem, greatest(gap, 1)), 1), 4)')} AS pre_hours, CAST(floor(CASE WHEN minutes <= 45 THEN 0 WHEN minutes <= 75 THEN 30 * z WHEN minutes <= 120 THEN 30 + 30 * z WHEN minutes <= 150 THEN 45 + 15 * z ELSE 60 + 30 * z END + 0.5) AS BIGINT) AS in_ride, minutes BETWEEN 46 AND 75 AND intensity >= 0.85::DOUBLE AS rinse, {_MILLI('CASE WHEN gap < 8 THEN 1 + 0.2 * dem ELSE 0 END')} AS recovery_rate, CASE WHEN gap < 8 THEN CAST(greatest(floor(least(greatest(gap, 0), 4)), 1) AS BIGINT) ELSE 0 END AS recovery_hours FROM q",
    "workout_files": """WITH st AS (SELECT l_orderkey AS activity_id, l_linenumber AS seq, CAST(sum(l_quantity) AS INTEGER) AS dur, 40 + l_linenumber * 12 AS pct FROM lineitem GROUP BY 1, 2),
        ln AS (SELECT activity_id, seq, '    <' || CASE WHEN seq % 3 = 0 THEN 'SteadyState' WHEN seq = 1 THEN 'Warmup' WHEN seq > 4 THEN 'Cooldown' ELSE 'Ramp' END || ' Duration="' || dur || '" ' ||
          CASE WHEN seq % 3 = 0 THEN 'Power="' || printf('%.3f', pct / 100) ELSE 'PowerLow="' || printf('%.3f', pct / 100) || '" PowerHigh="' || printf('%.3f', (pct + 5) / 100) END || '"/>' || chr(10) AS line FROM st),
        body AS (SELECT activity_id, string_agg(line, '' ORDER BY seq) AS body FROM ln GROUP BY 1)
        SELECT o_orderkey AS activity_id, '<workout_file>' || chr(10) || '  <author>kilojoule</author>' || chr(10) || '  <name>&lt;' || o_orderpriority || '&gt; &amp; &apos;more&apos;</name>' || chr(10) ||
          '  <description>Exported from kilojoule</description>' || chr(10) || '  <sportType>bike</sportType>' || chr(10) || '  <tags/>' || chr(10) || '  <workout>' || chr(10) || coalesce(body, '') || '  </workout>' || chr(10) || '</workout_file>' || chr(10) AS zwo
        FROM orders LEFT JOIN body ON o_orderkey = activity_id""",
    "rounded_grams": "WITH g AS (SELECT l_orderkey AS plan_id, l_linenumber AS idx, floor(sum(l_quantity) * 16) / 16 AS grams FROM lineitem GROUP BY 1, 2), b AS (SELECT *, floor(grams / 5) AS base, grams / 5 - floor(grams / 5) AS rem FROM g), r AS (SELECT *, floor(sum(grams) OVER w / 5 + 0.5) - sum(base) OVER w AS missing, row_number() OVER (PARTITION BY plan_id ORDER BY rem DESC, idx) AS k FROM b WINDOW w AS (PARTITION BY plan_id)) SELECT plan_id, idx, CAST((base + (k <= missing)::INTEGER) * 5 AS BIGINT) AS rounded FROM r",
}
ORACLE_SQL["timer_series"] = ORACLE_SQL["resample_series"].replace(_TICKS, _TIMED)
_COUNTED = ("gaps_filled", "gap_seconds_filled", "pauses", "paused_seconds", "power_dropouts_repaired", "power_dropout_seconds", "hr_dropouts_repaired")
ORACLE_SQL["timer_report"] = (
    ORACLE_SQL["resample_report"].replace(_TICKS, _TIMED).replace("count(*) FILTER (NOT late) AS kept", "count(*) FILTER (NOT late AND NOT paused) AS kept, count(*) FILTER (paused) AS timer_paused_records").replace("kept - n AS", "timer_paused_records, kept - coalesce(n, 0) AS")
    .replace(", ".join(_COUNTED) + " FROM c JOIN m USING", ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTED) + " FROM c LEFT JOIN m USING")
)
ORACLE_SQL["season_summary"] = f"""WITH RECURSIVE {_RIDES}, {_ELAPSED(GRID)}, {_PLAN}, s AS (SELECT athlete_id, day, sum(load) AS load FROM p GROUP BY 1, 2), daily AS (SELECT athlete_id, d.day, coalesce(load, 0) AS load FROM (SELECT athlete_id, unnest(range(least(min(day), {END_DAY}), {END_DAY} + 1)) AS day FROM p GROUP BY 1) d LEFT JOIN s USING (athlete_id, day)), n AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY day) AS k FROM daily), f AS (SELECT athlete_id, 0::BIGINT AS k, 0::BIGINT AS day, 0.0::DOUBLE AS load, 0.0::DOUBLE AS ctl, 0.0::DOUBLE AS atl FROM n WHERE k = 1 UNION ALL SELECT n.athlete_id, n.k, n.day, n.load, f.ctl + (n.load - f.ctl) * (1 - exp(-1 / 42.0::DOUBLE)), f.atl + (n.load - f.atl) * (1 - exp(-1 / 7.0::DOUBLE)) FROM f JOIN n ON n.athlete_id = f.athlete_id AND n.k = f.k + 1),
    fo AS (SELECT athlete_id, (SELECT min(day) FROM daily WHERE daily.athlete_id = f.athlete_id) AS first_day, ctl, atl FROM f WHERE k > 0 AND day = {END_DAY}),
    sc AS (SELECT activity_id % 10 AS athlete_id, duration_s, max(best_sum / duration_s) AS watts FROM best GROUP BY 1, 2), sl AS (SELECT athlete_id, count(*) AS durations, max(duration_s)::BIGINT AS longest, arg_max(watts, duration_s) AS watts FROM sc GROUP BY 1),
    fl AS (SELECT athlete_id, count(*) AS points, regr_slope(watts * duration_s, duration_s) AS cp, regr_intercept(watts * duration_s, duration_s) AS w_prime FROM sc WHERE duration_s BETWEEN 120 AND 1200 GROUP BY 1 HAVING count(*) >= 3),
    ff AS (SELECT athlete_id, points, cp, w_prime, sqrt(avg(pow(watts - (w_prime / duration_s + cp), 2))) AS rmse FROM fl JOIN sc USING (athlete_id) WHERE duration_s BETWEEN 120 AND 1200 AND cp > 0 AND w_prime > 0 GROUP BY 1, 2, 3, 4),
    se AS (SELECT athlete_id, watts - w / duration_s + w / 3600 AS eftp, duration_s::BIGINT AS eftp_s FROM sc JOIN (SELECT athlete_id, CASE WHEN w_prime BETWEEN 5000 AND 50000 THEN w_prime ELSE 20000 END AS w FROM sl LEFT JOIN ff USING (athlete_id)) USING (athlete_id) WHERE duration_s BETWEEN 180 AND 1800 QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY eftp DESC, duration_s DESC) = 1)
    SELECT athlete_id, first_day, {_MILLI('ctl')} AS ctl, {_MILLI('atl')} AS atl, {_MILLI('ctl - atl')} AS tsb, durations, longest, {_MILLI('watts')} AS watts, points, {_MILLI('cp')} AS cp, {_MILLI('w_prime')} AS w_prime, {_MILLI('rmse')} AS rmse, eftp_s, {_MILLI('eftp')} AS eftp
    FROM fo FULL JOIN sl USING (athlete_id) LEFT JOIN ff USING (athlete_id) LEFT JOIN se USING (athlete_id)"""
ORACLE_SQL["day_loads"] = f"""WITH x AS (SELECT o_custkey % 10 AS athlete_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, 30 + o_orderkey % 300 AS minutes, (50 + o_orderkey % 55)::DOUBLE / 100 AS i FROM orders)
    SELECT athlete_id, day, {_MILLI('sum(minutes * 60 * greatest(i, 0) * 250 / 1000 / 70 * least(greatest(i / 0.75::DOUBLE, 0.6::DOUBLE), 1.4::DOUBLE))')} AS load, sum(minutes)::BIGINT AS training_min FROM x GROUP BY 1, 2"""
_LONG = _RIDES.replace("user_id", "user_id % 10")
ORACLE_SQL["long_mean_max"] = ORACLE_SQL["mean_max"].replace(_RIDES, _LONG)
ORACLE_SQL["long_power"] = ORACLE_SQL["activity_power"].replace(_RIDES, _LONG)
ORACLE_SQL["long_fit"] = f"""WITH {_LONG}, len AS (SELECT activity_id, count(*) AS n FROM rides GROUP BY 1), {_BEST("range(1, 1801)")}, p AS (SELECT activity_id, duration_s AS t, best_sum / duration_s AS p FROM best JOIN len USING (activity_id) WHERE duration_s IN ({', '.join(map(str, _STEPS))}) OR (duration_s = n AND n BETWEEN 120 AND 1200)),
    l AS (SELECT activity_id, count(*) AS points, regr_slope(p * t, t) AS cp, regr_intercept(p * t, t) AS w FROM p GROUP BY 1 HAVING count(*) >= 3), f AS (SELECT activity_id, points, cp, w, sqrt(avg(pow(p - (w / t + cp), 2))) AS rmse FROM l JOIN p USING (activity_id) WHERE cp > 0 AND w > 0 GROUP BY 1, 2, 3, 4),
    e AS (SELECT activity_id, duration_s::BIGINT AS eftp_s, best_sum / duration_s - v / duration_s + v / 3600 AS eftp FROM best JOIN (SELECT activity_id, CASE WHEN w BETWEEN 5000 AND 50000 THEN w ELSE 20000 END AS v FROM len LEFT JOIN f USING (activity_id)) USING (activity_id) WHERE duration_s BETWEEN 180 AND 1800 QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY eftp DESC, duration_s DESC) = 1)
    SELECT len.activity_id, points, {_MILLI('cp')} AS cp, {_MILLI('w')} AS w_prime, {_MILLI('rmse')} AS rmse, eftp_s, {_MILLI('eftp')} AS eftp FROM len LEFT JOIN f USING (activity_id) LEFT JOIN e USING (activity_id)"""
