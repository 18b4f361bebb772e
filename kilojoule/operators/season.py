"""Rollups over a season and looks ahead over planned days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kilojoule.functions import fits
from kilojoule.functions.metrics import positive
from kilojoule.operators.metrics import DEFAULT_W_PRIME, LoadConfig, fit_3p, training_load

#: What a session counts as whose intensity isn't a number, and one of no known intensity.
MODERATE, UNKNOWN = 0.75, 0.65


def improved(curves: DataFrame, by: str) -> DataFrame:
    """(by, activity_id, duration_s, best_sum, before): the durations that an activity raised above all added earlier; before is null for a new one."""
    w = Window.partitionBy(by, "duration_s").orderBy("added", "activity_id").rowsBetween(Window.unboundedPreceding, -1)
    return curves.withColumn("before", F.max("best_sum").over(w)).where("before is null or best_sum > before").select(by, "activity_id", "duration_s", "best_sum", "before")


def season_loads(activities: DataFrame, by: str, end_day: int) -> DataFrame:
    """(by, day, load) of activities (by, day, tss, hr_tss), every day from a key's first to end_day; later ones don't count.

    A load is the tss, else the hr_tss, else 0. A key whose first day is after end_day has that one day.
    """
    load = F.when(F.col("day") <= end_day, F.coalesce("tss", "hr_tss", F.lit(0.0))).otherwise(0.0)
    sums = activities.select(by, F.least("day", F.lit(end_day)).cast("long").alias("day"), load.alias("load")).groupBy(by, "day").agg(F.sum("load").alias("load"))
    following = F.coalesce(F.lead("day").over(Window.partitionBy(by).orderBy("day")), F.lit(end_day + 1).cast("long"))
    filled = sums.withColumn("following", following).select(by, "load", F.posexplode(F.sequence("day", F.col("following") - 1)).alias("k", "day"))
    return filled.select(by, "day", F.when(F.col("k") == 0, F.col("load")).otherwise(0.0).alias("load"))


def mean_intensity(minutes: Column | None = None, over: WindowSpec | None = None) -> Column:
    """Aggregate over sessions, or over a window of them: the mean intensity by minutes; NaN counts as MODERATE, null as UNKNOWN; null without minutes."""
    known = F.coalesce(F.nanvl("intensity", F.lit(MODERATE)), F.lit(UNKNOWN))
    minutes = F.col("minutes") if minutes is None else minutes
    total = lambda c: F.sum(c) if over is None else F.sum(c).over(over)
    return total(minutes * known) / positive(total(minutes))


def planned_days(sessions: DataFrame, by: str) -> DataFrame:
    """(by, day, longest, priority, mean_intensity, key) of sessions (by, day, seq, minutes, intensity, priority).

    priority is the highest of A, B and C; key the most intense session of 45 minutes and 0.80 or more, the last of equals. The mean's
    sums go in the order of seq.
    """
    hard = (F.col("minutes") >= 45) & (F.col("intensity") >= 0.80) & ~F.isnan("intensity")
    day = Window.partitionBy(by, "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sessions.withColumn("_mean", mean_intensity(over=day)).groupBy(by, "day").agg(
        F.max("minutes").alias("longest"), F.min("priority").alias("priority"), F.max("_mean").alias("mean_intensity"), F.max(F.when(hard, F.struct("intensity", "seq", "minutes"))).alias("key")
    )


def week_load(sessions: DataFrame, by: str) -> DataFrame:
    """(by, week, tss, sessions) from sessions (by, date, tss); week is its Monday, an unknown tss counts 0."""
    return sessions.groupBy(by, F.date_trunc("week", "date").cast("date").alias("week")).agg(F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), F.count("*").alias("sessions"))


def _share(minutes: Column, span: float) -> Column:
    return F.least(F.greatest((minutes - 90) / span, F.lit(0.0)), F.lit(1.0))


def _hours(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return F.when(h == 0, F.format_string("%d min", m)).when(m == 0, F.format_string("%d h", h)).otherwise(F.format_string("%d h %02d min", h, m))


def raised(days: DataFrame, ahead: DataFrame, by: str) -> DataFrame:
    """days (by, day, own) with what the next two days, of planned_days(), ask for: to_g_per_kg, reason, days_before, note.

    reason is null where nothing asks for more than own, and to_g_per_kg is own then; of rules that ask the same the first one counts.
    A planned day is dealt to the two days before it, so that one shuffle by key and day does instead of a join for each distance.
    """
    before = F.explode(F.array([F.struct((F.col("day") - k).alias("day"), F.lit(k).alias("k")) for k in (1, 2)]))
    dealt = ahead.select(by, F.struct("longest", (F.coalesce("priority", F.lit("")) == "A").alias("event"), "key").alias("plan"), before.alias("b"))
    near = dealt.groupBy(by, F.col("b.day").alias("day")).agg(*[F.max(F.when(F.col("b.k") == k, F.col("plan"))).alias(f"in{k}") for k in (1, 2)])

    def asks(rank: int, when: Column, grams: Column, reason: str, k: int, minutes: Column, intensity: Column = F.lit(None).cast("double")) -> Column:
        return F.when(when, F.struct(grams.cast("double").alias("grams"), F.lit(-rank).alias("rank"), F.lit(reason).alias("reason"), F.lit(k).alias("k"), minutes.cast("int").alias("minutes"), intensity.cast("double").alias("intensity")))

    def event(rank: int, k: int) -> Column:
        long = F.col(f"in{k}.longest")
        return asks(rank, F.col(f"in{k}.event") & (long > 90), 10 + 2 * _share(long, 180), "carb_load", k, long)

    long, key = F.col("in1.longest"), F.col("in1.key")
    rules = [
        event(1, 1), asks(2, long >= 240, F.lit(8.0), "very_long_session_tomorrow", 1, long), asks(3, (long > 90) & (long < 240), 5 + 2 * _share(long, 150), "long_session_tomorrow", 1, long),
        asks(4, key.isNotNull(), F.lit(5.5), "key_session_tomorrow", 1, key["minutes"], key["intensity"]), event(5, 2),
    ]
    best = days.join(near, [by, "day"], "left").withColumn("best", F.array_max(F.array(*rules)))
    best = best.withColumn("best", F.when(F.col("best.grams") > F.col("own") + 1e-9, F.col("best")))
    minutes = _hours(F.col("best.minutes"))
    note = (
        F.when(F.col("best.reason") == "carb_load", F.concat(F.lit("Carb-loading: "), minutes, F.when(F.col("best.k") == 1, " A event tomorrow").otherwise(" A event in 2 days")))
        .when(F.col("best.reason") == "key_session_tomorrow", F.concat(F.lit("Raised: hard "), minutes, F.lit(" session tomorrow (IF "), F.format_number("best.intensity", 2), F.lit(")")))
        .when(F.col("best").isNotNull(), F.concat(F.lit("Raised: "), minutes, F.lit(" ride tomorrow")))
    )
    return best.select(by, "day", "own", F.coalesce("best.grams", "own").alias("to_g_per_kg"), F.col("best.reason").alias("reason"), F.col("best.k").alias("days_before"), note.alias("note"))


def season_summary(loads: DataFrame, curves: DataFrame, by: str, end_day: int, fallback: float = DEFAULT_W_PRIME, cfg: LoadConfig = LoadConfig()) -> DataFrame:
    """A row for each key with first_day, ctl, atl and tsb of end_day, season_curve, cp_2p, cp_3p and eftp.

    loads are as season_loads() takes them; curves (by, duration_s, watts) are activities' sampled curves, of which the best finite watts of
    each duration make the season's, whenever they were. The fits take its points from 120 and from 10 to 1200 s, the estimate those
    from 180 to 1800 s. A key that one of the two lacks has nulls for it. A curve's points, some dozens, are in one row.
    """
    days = training_load(season_loads(loads, by, end_day), by, cfg)
    form = days.groupBy(by).agg(F.min("day").alias("first_day"), *[F.max(F.when(F.col("day") == end_day, F.col(c))).alias(c) for c in ("ctl", "atl", "tsb")])
    best = curves.where(F.col("watts").isNotNull() & ~F.isnan("watts") & (F.abs("watts") < float("inf"))).groupBy(by, "duration_s").agg(F.max("watts").alias("watts"))
    points = best.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("duration_s").cast("double").alias("t"), F.col("watts").alias("p")))).alias("points"))
    points = points.withColumn("cp_2p", fits.fit_2p(F.filter("points", lambda x: x["t"].between(*fits.TWO_PARAMETER))))
    curve = F.transform("points", lambda x: F.struct(x["t"].cast("long").alias("duration_s"), x["p"].alias("watts")))
    points = points.select(by, curve.alias("season_curve"), "cp_2p", fits.eftp(F.col("points"), F.col("cp_2p.w_prime"), F.lit(float(fallback))).alias("eftp"))
    long = fit_3p(best.where(F.col("duration_s").between(*fits.THREE_PARAMETER)).select(by, F.col("duration_s").cast("double").alias("t"), F.col("watts").alias("p")), by)
    long = long.select(by, F.struct("cp", "w_prime", "k", "p_max", "r2", "rmse", "n").alias("cp_3p"))
    return form.join(points.join(long.hint("merge"), by, "left").hint("merge"), by, "full").select(by, "first_day", "ctl", "atl", "tsb", "season_curve", "cp_2p", "cp_3p", "eftp")


def day_load(sessions: DataFrame, by: str) -> DataFrame:
    """(by, day, load, training_min) of sessions (by, day, load, minutes): a day's load in kJ/kg and its minutes of training."""
    return sessions.groupBy(by, "day").agg(F.sum("load").alias("load"), F.sum("minutes").cast("long").alias("training_min"))


def local_day(at: Column, zone: Column | str) -> Column:
    """The calendar day, counted from 1970, that an instant has in a time zone."""
    return F.unix_date(F.to_date(F.from_utc_timestamp(at, zone)))
