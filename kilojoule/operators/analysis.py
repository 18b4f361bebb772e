"""The summary of each activity by its athlete's settings of the day: every window shares one shuffle and the aggregation needs none of its own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.functions import fits
from kilojoule.functions.metrics import HR_ZONES, POWER_ZONES, STANDARD_DURATIONS, TRIMP, fit_durations, intensity_factor, positive, trimp_of, tss
from kilojoule.operators.metrics import DEFAULT_W_PRIME, Athlete, by, moving, normalized_power, with_balance, with_rolling

#: Numbers of an athlete's settings; with them go trimp (`men` or `women`), power_zones and hr_zones.
NUMBERS = ("ftp", "weight_kg", "lthr", "resting_hr", "max_hr", "cp", "w_prime")
#: Most bounds of zones.
MOST_BOUNDS = 15


def zones_error(bounds: Column, name: str) -> Column:
    """What is wrong with upper bounds of zones, else null: they are finite, positive and rising, MOST_BOUNDS at most. Null bounds are fine."""
    odd = F.exists(bounds, lambda b: b.isNull() | F.isnan(b) | (b <= 0) | (b == float("inf")))
    falls = F.array_sort(F.array_distinct(bounds)) != bounds
    return F.when(odd | falls | (F.size(bounds) == 0), f"{name} must be finite, positive and rising").when(F.size(bounds) > MOST_BOUNDS, f"{name} has more than {MOST_BOUNDS} bounds")


def checked_settings(settings: DataFrame) -> DataFrame:
    """settings with all their columns in place, absent ones null, default zones and coefficients for null ones, and `error` (null if none).

    Zones that are wrong are null, so metrics by them are, too, and the others stay.
    """
    own = lambda c, kind: F.col(c).cast(kind) if c in settings.columns else F.lit(None).cast(kind)
    problems, zones = [], []
    for name, usual in (("power_zones", POWER_ZONES), ("hr_zones", HR_ZONES)):
        wrong = zones_error(own(name, "array<double>"), name)
        problems.append(wrong)
        zones.append(F.when(wrong.isNull(), F.coalesce(own(name, "array<double>"), F.array([F.lit(float(b)) for b in usual]))).alias(name))
    kind = F.coalesce(own("trimp", "string"), F.lit("men"))
    problems.append(F.when(~kind.isin(list(TRIMP)), "trimp must be one of men, women"))
    keep = [c for c in settings.columns if c not in (*NUMBERS, "trimp", "power_zones", "hr_zones", "error")]
    out = settings.select(*keep, *[own(c, "double").alias(c) for c in NUMBERS], F.when(kind.isin(list(TRIMP)), kind).alias("trimp"), *zones, F.concat_ws("; ", *problems).alias("error"))
    return out.withColumn("error", F.when(F.col("error") != "", F.col("error")))


def settings_on(activities: DataFrame, settings: DataFrame) -> DataFrame:
    """Each activity (activity_id, athlete_id, day) with its athlete's settings (athlete_id, from_day and the rest) of the day: the last
    that began by then. Without any the settings are null. Two that begin on one day: the greater `added`, if there is one, counts."""
    w = Window.partitionBy("athlete_id", "from_day").orderBy(F.desc("added") if "added" in settings.columns else F.desc("from_day"))
    once = settings.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn", "added")
    spans = once.withColumn("_until", F.lead("from_day").over(Window.partitionBy("athlete_id").orderBy("from_day"))).withColumnRenamed("athlete_id", "_athlete")
    valid = (F.col("athlete_id") == F.col("_athlete")) & (F.col("day") >= F.col("from_day")) & (F.col("_until").isNull() | (F.col("day") < F.col("_until")))
    return activities.join(spans, valid, "left").drop("_athlete", "_until", "from_day")


def _zone(value: Column, reference: Column, bounds: Column) -> Column:
    """How many bounds times the reference are below the value; null for null."""
    above = [F.coalesce(~(value <= F.get(bounds, F.lit(i)) * reference), F.lit(False)).cast("int") for i in range(MOST_BOUNDS)]
    return F.when(value.isNotNull(), sum(above[1:], above[0]))


def analyze(samples: DataFrame, athlete: Athlete | DataFrame, moving_load: bool = True, least_speed: float = 0.5) -> DataFrame:
    """A row for each activity of samples (activity_id, idx, power, heart_rate, and, if there are, speed, elapsed, power_dropout).

    `athlete` is one for all activities or a table (activity_id and settings as of checked_settings()), of which an activity has one
    row at most. Power metrics are null without any recorded power, those of a missing or non-positive threshold too. The critical power
    falls back to the FTP, W' to 20 kJ. summarize() adds curves and fits.
    """
    own = lambda name, kind: F.col(name) if name in samples.columns else F.lit(None).cast(kind)
    most = MOST_BOUNDS
    if isinstance(athlete, Athlete):
        constant = {**{c: F.lit(getattr(athlete, c)).cast("double") for c in NUMBERS}, "trimp": F.lit(athlete.trimp)}
        zones = {"power_zones": F.array([F.lit(b) for b in POWER_ZONES]), "hr_zones": F.array([F.lit(b) for b in HR_ZONES])}
        constant |= zones
        setting, rows, held, most = (lambda c: constant[c]), samples, [], len(POWER_ZONES)
        after = setting
    else:
        named = athlete.select("activity_id", *[F.col(c).alias(f"_{c}") for c in (*NUMBERS, "trimp", "power_zones", "hr_zones")])
        setting = after = lambda c: F.col(f"_{c}")
        rows = samples.join(named, "activity_id", "left")
        rows = rows.withColumns({f"_n_{z}": F.size(f"_{z}") for z in ("power_zones", "hr_zones")})
        held = [f"_{c}" for c in ("ftp", "weight_kg", "lthr", "resting_hr", "max_hr", "trimp", "n_power_zones", "n_hr_zones")]
    cp, w_prime = F.coalesce(positive(F.coalesce(setting("cp"), setting("ftp"))), F.lit(0.0)), F.coalesce(positive(setting("w_prime")), F.lit(DEFAULT_W_PRIME))
    rows = with_balance(with_rolling(rows), cp, w_prime).withColumn("late", F.col("idx") >= F.floor(F.count("*").over(by()) / 2))

    load_of = lambda hr, s: trimp_of(hr, s("resting_hr"), s("max_hr"), s("trimp"))
    rides = moving(own("speed", "double"), least_speed)
    counted = F.when(rides, F.col("heart_rate")) if moving_load else F.col("heart_rate")
    # what is added up is worked out row by row first: an aggregation of all these rules is more code than the JVM compiles
    rows = rows.select(
        "activity_id", "idx", "power", "heart_rate", "rolling", "balance", *held, F.coalesce(own("elapsed", "long"), F.col("idx")).alias("at"), rides.alias("rides"), F.coalesce(~own("power_dropout", "boolean"), F.lit("power_dropout" not in samples.columns)).alias("known"),
        load_of(counted, setting).alias("impulse"), F.when(F.col("heart_rate").isNotNull(), F.col("late")).alias("late"), _zone(F.col("power"), setting("ftp"), setting("power_zones")).alias("pz"), _zone(F.col("heart_rate"), setting("lthr"), setting("hr_zones")).alias("hz"),
    )
    half = lambda c, late: F.sum(F.when(F.col("late") == late, F.col(c)))
    ratio = lambda late: half("power", late) / positive(half("heart_rate", late))
    in_zones = [F.array([F.count_if(F.col(zone) == i) for i in range(most + 1)]).alias(name) for zone, name in (("pz", "in_power_zones"), ("hz", "in_hr_zones"))]
    out = rows.groupBy("activity_id").agg(
        F.count("*").alias("recording_time_s"), (F.max("at") + 1).alias("elapsed_time_s"), F.count_if("rides").alias("moving_time_s"), F.bool_or("known").alias("has_power"),
        F.avg("power").alias("average_power"), F.max("power").alias("max_power"), (F.sum("power") / 1000).alias("work_kj"), normalized_power().alias("normalized_power"),
        F.min(F.when(F.col("balance").isNotNull(), F.struct("balance", "idx"))).alias("least"), F.avg("heart_rate").alias("average_hr"), F.max("heart_rate").alias("max_hr"), F.sum("impulse").alias("impulse"),
        ratio(False).alias("r1"), ratio(True).alias("r2"), *in_zones, *[F.max(x).alias(x) for x in held],
    )
    c = F.col
    powered = lambda x: F.when(c("has_power"), x)
    load = c("moving_time_s") if moving_load else c("recording_time_s")
    ftp, lthr = after("ftp"), after("lthr")
    hour = load_of(lthr, after) * 3600
    bounds = lambda z: F.lit(most) if isinstance(athlete, Athlete) else after(f"n_{z}")
    seconds = lambda z: F.when(bounds(z) >= 0, F.slice(f"in_{z}", F.lit(1), bounds(z) + 1))
    return out.select(
        "activity_id", "recording_time_s", "elapsed_time_s", "moving_time_s", "has_power", *[powered(c(x)).alias(x) for x in ("average_power", "max_power", "normalized_power", "work_kj")],
        powered(intensity_factor(c("normalized_power"), ftp)).alias("intensity_factor"), powered(c("normalized_power") / positive(c("average_power"))).alias("variability_index"),
        powered(tss(load, c("normalized_power"), ftp)).alias("tss"), powered(c("average_power") / positive(after("weight_kg"))).alias("average_watts_per_kg"),
        powered(F.when(ftp > 0, seconds("power_zones"))).alias("power_zone_seconds"), powered(c("least.balance")).alias("min_w_prime_balance"), powered(c("least.idx")).alias("min_w_prime_at"),
        "average_hr", "max_hr", powered(c("normalized_power") / positive(c("average_hr"))).alias("efficiency_factor"), powered((c("r1") - c("r2")) / positive(c("r1")) * 100).alias("decoupling_pct"),
        F.when(c("average_hr").isNotNull() & lthr.isNotNull(), seconds("hr_zones")).alias("hr_zone_seconds"), F.when((after("resting_hr") < lthr) & (lthr < after("max_hr")), c("impulse") / hour * 100).alias("hr_tss"),
    )


def best_sums(samples: DataFrame, durations: Sequence[int]) -> DataFrame:
    """(activity_id, length, total, best): the best sums of power over each of the durations (null where longer than the activity), over
    elapsed time if samples have `elapsed`; `length` is the whole activity's, whose best sum is its total.

    Pauses count as seconds of 0 but aren't rows: one longer than the longest duration is cut to it, since no window reaches across.
    """
    wanted = np.array(sorted({int(d) for d in durations if d > 0}), np.int64)
    at = "elapsed" if "elapsed" in samples.columns else "idx"

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, power = np.asarray(table.column("at"), np.int64), np.asarray(table.column("power"), np.int64)
        step = np.minimum(np.diff(at), wanted[-1] + 1) if len(wanted) else np.diff(at)
        place = np.concatenate([[0], np.cumsum(step)])
        sums = np.zeros(place[-1] + 2, np.int64)
        sums[place + 1] = power
        np.cumsum(sums, out=sums)
        best = [int((sums[d:] - sums[:-d]).max()) if d < len(sums) else None for d in wanted]
        kind = table.schema.field("activity_id").type
        return pa.table({"activity_id": pa.array([table.column("activity_id")[0].as_py()], kind), "length": pa.array([int(at[-1] - at[0]) + 1]), "total": pa.array([int(sums[-1])]), "best": pa.array([best], pa.list_(pa.int64()))})

    kind = samples.schema["activity_id"].dataType.simpleString()
    rows = samples.select("activity_id", F.col(at).cast("long").alias("at"), F.coalesce(F.col("power").cast("long"), F.lit(0).cast("long")).alias("power"))
    return rows.groupBy("activity_id").applyInArrow(kernel, f"activity_id {kind}, length long, total long, best array<long>")


def mean_max_elapsed(samples: DataFrame, durations: Sequence[int]) -> DataFrame:
    """(activity_id, duration_s, best_sum) over elapsed time, pauses as zeros; durations longer than the activity are left out."""
    wanted = sorted({int(d) for d in durations if d > 0})
    rows = best_sums(samples, wanted).select("activity_id", F.explode(F.arrays_zip(F.array([F.lit(d) for d in wanted]).alias("duration_s"), F.col("best").alias("best_sum"))).alias("p"))
    return rows.where("p.best_sum is not null").select("activity_id", "p.duration_s", "p.best_sum")


def curves(samples: DataFrame, w_prime: DataFrame | float = DEFAULT_W_PRIME) -> DataFrame:
    """(activity_id, power_curve, cp_fit, eftp) of each activity's best sums over elapsed time.

    power_curve has the standard durations that it covers, cp_fit the two-parameter fit of fits.fit_2p() and eftp that of fits.eftp() with
    every second of its range; `w_prime`, one or a table (activity_id, w_prime), is the fallback of the latter.
    """
    low, high = fits.TWO_PARAMETER
    steps, each = fit_durations(low, high), range(fits.EFTP_RANGE[0], fits.EFTP_RANGE[1] + 1)
    wanted = sorted({*STANDARD_DURATIONS, *steps, *each})
    number = {d: i for i, d in enumerate(wanted)}
    best = best_sums(samples, wanted)
    own = F.lit(float(w_prime)) if isinstance(w_prime, (int, float)) else F.coalesce(positive(F.col("w_prime")), F.lit(DEFAULT_W_PRIME))
    if not isinstance(w_prime, (int, float)):
        best = best.join(w_prime.select("activity_id", "w_prime"), "activity_id", "left")

    def points(durations: Sequence[int]) -> Column:
        places = F.array([F.struct(F.lit(number[d]).alias("i"), F.lit(float(d)).alias("t")) for d in durations])
        known = F.filter(places, lambda x: F.get("best", x["i"]).isNotNull())
        return F.transform(known, lambda x: F.struct(x["t"].alias("t"), (F.get("best", x["i"]) / x["t"]).alias("p")))

    first = number[each[0]]  # from there on there is every second
    run = F.transform(F.slice("best", first + 1, len(each)), lambda b, i: F.struct((i + each[0]).cast("double").alias("t"), (b / (i + each[0])).alias("p")))
    # the activity's own length ends the fit's points
    last = F.when(F.col("length").between(low, high) & ~F.col("length").isin(steps), F.array(F.struct(F.col("length").cast("double").alias("t"), (F.col("total") / F.col("length")).alias("p")))).otherwise(F.array().cast("array<struct<t:double,p:double>>"))
    fit = best.select("*", points(STANDARD_DURATIONS).alias("power_curve"), F.concat(points(steps), last).alias("fitted"), F.filter(run, lambda x: x["p"].isNotNull()).alias("run"))
    fit = fit.withColumn("cp_fit", fits.fit_2p(F.col("fitted")))
    curve = F.transform("power_curve", lambda x: F.struct(x["t"].cast("long").alias("duration_s"), x["p"].alias("watts")))
    return fit.select("activity_id", curve.alias("power_curve"), "cp_fit", fits.eftp(F.col("run"), F.col("cp_fit.w_prime"), own).alias("eftp"))


def summarize(samples: DataFrame, settings: Athlete | DataFrame, report: DataFrame | None = None, moving_load: bool = True, least_speed: float = 0.5) -> DataFrame:
    """analyze() with power_curve, cp_fit and eftp of curves() (null without power) and, if it is given, the report of resample() as a struct."""
    rows = analyze(samples, settings, moving_load, least_speed)
    fallback = (settings.w_prime or DEFAULT_W_PRIME) if isinstance(settings, Athlete) else settings
    own = curves(samples, fallback)
    out = rows.join(own.hint("merge"), "activity_id", "left")
    out = out.withColumns({c: F.when(F.col("has_power"), F.col(c)) for c in ("power_curve", "cp_fit", "eftp")})
    if report is not None:
        counters = F.struct(*[c for c in report.columns if c != "activity_id"]).alias("resample_report")
        out = out.join(report.select("activity_id", counters).hint("merge"), "activity_id", "left")
    return out
