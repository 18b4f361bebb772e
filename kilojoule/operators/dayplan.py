"""A day's fuelling around its sessions: drafts, meals that stay, the carbohydrate budget, and the timeline in whole steps of grams.

Sessions are rows with windows by plan, since each looks at its neighbours on the clock. A plan's few sessions and meals then sit in
arrays of one row, so that its budget needs no further shuffle, and the timeline is rows again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.functions import metrics as fn
from kilojoule.operators import season
from kilojoule.operators.metrics import daily_loads, sums_in_order
from kilojoule.operators.season import mean_intensity

# Minutes after midnight of waking and of the usual meals.
WAKE = 390
MEALS = (("breakfast", 420), ("lunch", 750), ("dinner", 1110), ("evening_snack", 1290))
# Windows and delays in minutes; protein, g/kg, of a feeding at least and at most, and of a day at most.
MERGE_WINDOW, EARLY, TOP_UP_LEAD, DINNER_DELAY, SNACK_AFTER_DINNER, SNACK_GAP, FEED_INTERVAL = 60, 150, 60, 30, 90, 210, 30
LEAST_PROTEIN, MOST_PROTEIN, DAY_PROTEIN = 0.3, 0.4, 2.0
#: A pre-ride meal of more g/kg is split, and how much of it the top-up has.
SPLIT_ABOVE, TOP_UP_SHARE = 2.0, 0.25
#: Protein snacks of a day at most.
SNACKS = 3
_MEAL = "array<struct<kind:string,time:int>>"


def with_defaults(days: DataFrame) -> DataFrame:
    """days (plan_id, mass and, if there are, ftp, wake_min, meals, tomorrow_start, raised_to) with all of these columns.

    meals is array<struct<kind, time>> in the order of the day; null ones are the usual four. tomorrow_start is the next day's first
    session in minutes after that day's midnight, raised_to the g/kg that the days ahead ask for.
    """
    own = lambda c, kind: F.col(c).cast(kind) if c in days.columns else F.lit(None).cast(kind)
    usual = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("time")) for k, t in MEALS])
    return days.select(
        "plan_id", F.col("mass").cast("double").alias("mass"), own("ftp", "double").alias("ftp"), F.coalesce(own("wake_min", "int"), F.lit(WAKE)).alias("wake_min"), F.coalesce(own("meals", _MEAL), usual).alias("meals"),
        own("tomorrow_start", "int").alias("tomorrow_start"), own("raised_to", "double").alias("raised_to"),
    )


def _meal_time(kind: str) -> Column:
    return F.get(F.filter("meals", lambda x: x["kind"] == kind), F.lit(0))["time"]


def session_drafts(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row for each session (plan_id, seq, start_min, duration_min, intensity, planned_kj) of a day, before amounts are settled.

    `index` counts a day's sessions by seq. Each has its load, the hours before it (in halves, as far as waking or the session before
    leave them) and pre_time of its pre-ride meal, what it replaces, g an hour and in total during it, when the next one begins (today, or
    tomorrow past 1440), the rate and hours of its recovery, and the time of a dinner that follows it. `overlaps` marks one that begins
    before the one before it ends, be it that they overlap or aren't in order. Sessions of unknown days are left out.
    """
    w = Window.partitionBy("plan_id").orderBy("seq")
    c = F.col
    end = (c("start_min") + c("duration_min")).cast("int")
    rows = sessions.join(with_defaults(days).hint("merge"), "plan_id")
    rows = rows.withColumn("index", (F.row_number().over(w) - 1).cast("int")).withColumn("end_min", end).withColumn("before", F.lag(end).over(w)).withColumn("later", F.lead("start_min").over(w))
    work = fn.session_work_kj(c("planned_kj"), c("duration_min"), c("intensity"), F.when(c("ftp") < float("inf"), c("ftp")), c("mass"))
    earliest = F.coalesce("before", "wake_min")
    rows = rows.withColumn("load", fn.session_load(work, c("mass"), c("intensity"))).withColumn("earliest", earliest)
    available = F.greatest(c("start_min") - c("earliest"), F.lit(0)) / 60
    hours = F.greatest(F.floor(fn.pre_ride_hours(c("load"), available) * 2) / 2, F.lit(1.0))
    rows = rows.withColumn("pre_hours", hours)
    lead = F.floor(c("pre_hours") * 60 + 0.5).cast("int")
    pre_time = F.least(F.greatest(fn.floor15(F.greatest(c("start_min") - lead, F.lit(0))), fn.ceil15(c("earliest"))), fn.floor15(c("start_min")))
    rate = fn.in_ride_g_per_hour(c("duration_min"), c("intensity")).cast("double")
    next_start = F.coalesce(c("later"), c("tomorrow_start") + 1440).cast("int")
    rows = rows.withColumn("pre_time", pre_time).withColumn("g_per_hour", rate).withColumn("next_start", next_start)
    gap = F.when(c("next_start").isNotNull(), F.greatest(c("next_start") - c("end_min"), F.lit(0)) / 60)
    recovery, wanted = fn.recovery_hours(c("load"), gap)
    breakfast, dinner = _meal_time("breakfast"), _meal_time("dinner")
    replaces = (c("index") == 0) & ((c("start_min") <= c("wake_min") + EARLY) | ((c("pre_hours") >= 2) & F.coalesce(F.abs(breakfast - c("pre_time")) < MERGE_WINDOW, F.lit(False))))
    evening = (dinner >= F.greatest(c("pre_time") - MERGE_WINDOW, F.lit(0))) & (dinner < c("end_min") + MERGE_WINDOW)
    return rows.select(
        "plan_id", "index", "start_min", "duration_min", "end_min", "intensity", "load", "pre_hours", "pre_time", replaces.alias("replaces_breakfast"), "g_per_hour", (c("g_per_hour") * c("duration_min") / 60).alias("during_total"),
        fn.multiple_transportable(c("g_per_hour")).alias("multiple_transportable"), fn.mouth_rinse(c("duration_min"), c("intensity")).alias("mouth_rinse"), F.when(c("g_per_hour") > 0, FEED_INTERVAL).otherwise(0).alias("feed_interval"),
        "next_start", recovery.alias("recovery_rate"), wanted.cast("int").alias("recovery_wanted"), F.when(evening, fn.ceil15(c("end_min") + DINNER_DELAY)).alias("post_ride_dinner"), F.coalesce(c("start_min") < c("before"), F.lit(False)).alias("overlaps"),
    )


def _recovery_start(s: Column) -> Column:
    return F.coalesce(s["post_ride_dinner"], fn.ceil15(s["end_min"]))


def _is_meal(s: Column) -> Column:
    """A pre-ride meal two hours out, or in breakfast's place, has protein."""
    return (s["pre_hours"] >= 2) | s["replaces_breakfast"]


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))


def _kept_meals() -> Column:
    """Of the row's meals those that no session displaces, and the dinner after the last evening session."""
    s, dinner = F.col("s"), F.col("post_dinner")

    def stays(m: Column) -> Column:
        t, kind = m["time"], m["kind"]
        gone = (
            ((kind == "breakfast") & F.exists(s, lambda x: x["replaces_breakfast"]))
            | ((kind == "dinner") & dinner.isNotNull())
            | F.coalesce((kind == "evening_snack") & (t < dinner + SNACK_AFTER_DINNER), F.lit(False))
            | F.exists(s, lambda x: (F.abs(t - x["pre_time"]) < MERGE_WINDOW) | (x["post_ride_dinner"].isNull() & (F.abs(t - fn.ceil15(x["end_min"])) < MERGE_WINDOW)))
            | F.exists(s, lambda x: (t >= F.greatest(x["start_min"] - 30, F.lit(0))) & (t < x["end_min"]))
        )
        return ~gone

    meal = lambda kind, time: F.struct(F.lit(kind).alias("kind"), time.cast("int").alias("time"))
    kept = F.transform(F.filter("meals", stays), lambda m: F.struct(m["kind"].alias("kind"), fn.ceil15(m["time"]).alias("time")))
    kept = F.concat(kept, F.when(dinner.isNotNull(), F.array(meal("post_ride_dinner", dinner))).otherwise(F.array().cast(_MEAL)))
    last = F.coalesce(F.array_max(F.transform(s, lambda x: fn.ceil15(x["end_min"]))), F.lit(0))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(meal("dinner", fn.ceil15(F.greatest(last + MERGE_WINDOW, F.lit(1110))))))


def _with_snack(rows: DataFrame) -> DataFrame:
    """One more protein snack in the middle of the longest gap, of equals the last, where a feeding would need too much protein."""
    s = F.col("s")
    feeds = F.flatten(F.transform(s, lambda x: F.when(_is_meal(x), F.array(x["pre_time"], _recovery_start(x))).otherwise(F.array(_recovery_start(x)))))
    rows = rows.withColumn("times", F.array_sort(F.concat(F.transform("kept", lambda m: m["time"]), feeds, F.array(fn.ceil15(F.col("wake_min"))))))
    rows = rows.withColumn("gaps", F.transform(F.slice("times", F.lit(2), F.size("times") - 1), lambda b, i: F.struct((b - F.get("times", i)).alias("long"), i.alias("i"), F.get("times", i).alias("a"), b.alias("b"))))
    free = F.filter("gaps", lambda g: (g["long"] > SNACK_GAP) & ~F.exists("s", lambda x: (x["start_min"] < g["b"]) & (x["end_min"] > g["a"])))
    rows = rows.withColumn("gap", F.array_max(free))
    needed = F.col("base_protein") / (F.col("feeds") + F.size("kept")) > MOST_PROTEIN + 1e-9
    snack = F.struct(F.lit("snack").alias("kind"), fn.floor15(F.col("gap.a") + F.floor(F.col("gap.long") / 2)).alias("time"))
    return rows.withColumn("kept", F.when(needed & F.col("gap").isNotNull(), F.concat("kept", F.array(snack))).otherwise(F.col("kept"))).drop("times", "gaps", "gap")


def _topped_up(rows: DataFrame) -> DataFrame:
    """What the budget leaves for pre-ride meals, in order: each takes what it wants from what those before it leave."""
    s, mass = F.col("s"), F.col("mass")
    wish = lambda x: F.greatest(x["pre_hours"] - 1, F.lit(0.0)) * mass
    left = lambda i: F.greatest(F.col("budget") - _sum(F.slice(s, F.lit(1), i), wish), F.lit(0.0))
    rows = rows.withColumn("pre", F.transform(s, lambda x, i: 1 + F.least(wish(x), left(i)) / mass))
    return rows.withColumn("budget", left(F.size(s)))


def _recovering(rows: DataFrame) -> DataFrame:
    """The hours of recovery feeds of each session: the first is fixed, others as the budget and the next pre-ride meal allow."""
    s = F.col("s")
    per_hour = lambda x: x["recovery_rate"] * F.col("mass")
    following = lambda x: F.coalesce(F.get(s, x["index"] + 1)["pre_time"], F.when(x["next_start"].isNotNull(), F.greatest(x["next_start"] - 60, F.lit(0))))
    # hours h = 1, 2, .. that begin before the next meal
    fit = lambda x: F.when(following(x).isNull(), x["recovery_wanted"] - 1).otherwise(F.least(x["recovery_wanted"] - 1, F.greatest(F.ceil((following(x) - _recovery_start(x)) / 60) - 1, F.lit(0))).cast("int"))
    fed = lambda x: (x["recovery_wanted"] > 0) & (per_hour(x) > 0)

    def take(a: Column, x: Column) -> Column:
        extra = F.when(fed(x), F.least(F.floor(a["left"] / F.when(per_hour(x) > 0, per_hour(x))).cast("int"), fit(x))).otherwise(0)
        hours = F.when(fed(x), extra + 1).otherwise(x["recovery_wanted"])
        return F.struct((a["left"] - F.when(fed(x), per_hour(x) * extra).otherwise(0.0)).alias("left"), F.concat(a["hours"], F.array(hours)).alias("hours"))

    folded = F.aggregate(s, F.struct(F.col("budget").alias("left"), F.array().cast("array<int>").alias("hours")), take)
    return rows.withColumn("folded", folded).withColumn("budget", F.col("folded.left")).withColumn("hours", F.col("folded.hours")).drop("folded")


def _entry(time: Column, kind: Column | str, carbs: Column, protein: Column, session: Column | None = None, hour: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        time.cast("int").alias("time_min"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if session is None else session).cast("int").alias("session"), (none if hour is None else hour).cast("int").alias("hour"),
        carbs.cast("double").alias("carbs"), protein.cast("double").alias("protein"),
    )


_ENTRIES = "array<struct<time_min:int,kind:string,session:int,hour:int,carbs:double,protein:double>>"


def _timeline() -> Column:
    """All entries of a row in the order in which they are made, amounts exact."""
    mass, each, zero = F.col("mass"), F.col("per_feeding"), F.lit(0.0)
    none = F.array().cast(_ENTRIES)

    def of_session(x: Column, i: Column) -> Column:
        pre = F.get("pre", i) * mass
        split = F.get("split", i)
        meal = F.when(split, pre * (1 - TOP_UP_SHARE)).otherwise(pre)
        entries = F.array(_entry(x["pre_time"], "pre_session", meal, F.when(_is_meal(x), each).otherwise(0.0), i))
        top_up = F.when(split, F.array(_entry(fn.floor15(F.greatest(x["start_min"] - TOP_UP_LEAD, F.lit(0))), "pre_session_top_up", pre - meal, zero, i))).otherwise(none)
        count = F.when(x["feed_interval"] > 0, F.floor(F.greatest(x["duration_min"] - 1, F.lit(0)) / FEED_INTERVAL)).otherwise(0).cast("int")
        feed = lambda k: _entry(F.greatest(fn.floor15(x["start_min"] + k * FEED_INTERVAL), fn.ceil15(x["start_min"] + 1)), "during_session", x["during_total"] / count, zero, i)
        during = F.when((count > 0) & (x["during_total"] > 0), F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), feed)).otherwise(none)
        hours, start, carbs = F.get("hours", i), _recovery_start(x), x["recovery_rate"] * mass
        dined = x["post_ride_dinner"].isNotNull()
        hourly = lambda h: F.when((h == 0) & dined, _entry(start, "post_ride_dinner", carbs, zero)).otherwise(_entry(start + h * 60, "recovery", carbs, F.when(h == 0, each).otherwise(0.0), i, h))
        fed = F.transform(F.sequence(F.lit(0), F.greatest(hours - 1, F.lit(0))), hourly)
        alone = F.when(dined, none).otherwise(F.array(_entry(start, "recovery", zero, each, i, F.lit(0))))
        return F.concat(entries, top_up, during, F.when(hours > 0, fed).otherwise(alone))

    weight = lambda m: F.when(m["kind"].isin("evening_snack", "snack"), 0.5).otherwise(1.0)
    at_table = F.transform("kept", lambda m: _entry(m["time"], m["kind"], fn.meal_floor(m["kind"], F.col("carbs_g_per_kg")) * mass + F.col("budget") * weight(m) / F.col("weights"), each))
    return F.concat(F.flatten(F.transform("s", of_session)), at_table)


def day_budgets(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row for each day with its targets and how the carbohydrate is dealt out: floors of the meals that stay, during sessions, one
    g/kg before each and the first hour of recovery are fixed (exceeds, if they are more than the target); pre-ride meals, recovery hours
    and meals take the rest in turn. `error` says why there is no plan, all else is null then; error_index is the overlapping session's.
    """
    drafts = session_drafts(days, sessions)
    fields = [c for c in drafts.columns if c not in ("plan_id", "index")]
    # a day's sessions, a few
    gathered = drafts.groupBy("plan_id").agg(
        F.sort_array(F.collect_list(F.struct("index", *fields))).alias("s"), F.min(F.when(F.col("overlaps"), F.col("index"))).alias("error_index"), mean_intensity(F.col("duration_min")).alias("mean_intensity"),
    )
    kind = dict(gathered.dtypes)["s"]
    rows = with_defaults(days).join(gathered.hint("merge"), "plan_id", "left").withColumn("s", F.coalesce("s", F.array().cast(kind)))
    wrong = ~F.coalesce((F.col("mass") > 0) & (F.col("mass") < float("inf")), F.lit(False))
    rows = rows.withColumn("error", F.when(wrong, "invalid_body_mass").when(F.col("error_index").isNotNull(), "overlap")).withColumn("error_index", F.when(F.col("error") == "overlap", F.col("error_index")))
    rows = rows.withColumn("load", _sum(F.col("s"), lambda x: x["load"])).withColumn("training_min", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["duration_min"]))
    rows = rows.withColumn("own_carbs_g_per_kg", fn.round_tenth(fn.carbs_g_per_kg(F.col("load")))).withColumn("carbs_g_per_kg", F.greatest("own_carbs_g_per_kg", F.coalesce(fn.round_tenth(F.col("raised_to")), F.lit(0.0))))
    rows = rows.withColumn("target", F.col("carbs_g_per_kg") * F.col("mass")).withColumn("base_protein", fn.protein_g_per_kg(F.col("load")))
    rows = rows.withColumn("post_dinner", F.get(F.reverse(F.filter(F.transform("s", lambda x: x["post_ride_dinner"]), lambda t: t.isNotNull())), F.lit(0)))
    rows = rows.withColumn("kept", _kept_meals())
    rows = rows.withColumn("feeds", F.aggregate("s", F.lit(0), lambda a, x: a + _is_meal(x).cast("int") + x["post_ride_dinner"].isNull().cast("int")))
    rows = reduce(lambda out, _: _with_snack(out), range(SNACKS), rows)

    mass = F.col("mass")
    rows = rows.withColumns({"floors": _sum(F.col("kept"), lambda m: fn.meal_floor(m["kind"], F.col("carbs_g_per_kg")) * mass), "during": _sum(F.col("s"), lambda x: x["during_total"]), "pre_least": _sum(F.col("s"), lambda x: mass)})
    rows = rows.withColumn("first_recovery", _sum(F.filter("s", lambda x: x["recovery_wanted"] > 0), lambda x: x["recovery_rate"] * mass))
    rows = rows.withColumn("fixed", F.col("floors") + F.col("during") + F.col("pre_least") + F.col("first_recovery"))
    rows = rows.withColumn("exceeds", F.col("fixed") > F.col("target") + 1e-9).withColumn("budget", F.greatest(F.col("target") - F.col("fixed"), F.lit(0.0)))
    rows = _recovering(_topped_up(rows))
    rows = rows.withColumn("split", F.transform("s", lambda x, i: (F.get("pre", i) > SPLIT_ABOVE) & (x["pre_time"] + TOP_UP_LEAD < F.greatest(x["start_min"] - TOP_UP_LEAD, F.lit(0)))))
    feedings = F.col("feeds") + F.size("kept")
    protein = F.greatest(F.least(F.greatest(F.col("base_protein"), LEAST_PROTEIN * feedings), F.lit(DAY_PROTEIN)), F.col("base_protein"))
    rows = rows.withColumn("protein_g_per_kg", protein).withColumn("protein_g", F.col("protein_g_per_kg") * mass).withColumn("per_feeding", F.col("protein_g") / feedings)
    rows = rows.withColumn("weights", _sum(F.col("kept"), lambda m: F.when(m["kind"].isin("evening_snack", "snack"), 0.5).otherwise(1.0))).withColumn("band", fn.band_for_carbs(F.col("carbs_g_per_kg")))
    names = ["load", "training_min", "mean_intensity", "band", "own_carbs_g_per_kg", "carbs_g_per_kg", "target", "protein_g_per_kg", "protein_g", "per_feeding", "exceeds", "floors", "during", "pre_least", "first_recovery", "fixed", "budget", "weights", "kept", "s", "pre", "split", "hours"]
    return rows.select("plan_id", "mass", "error", "error_index", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in names])


def session_plans(budgets: DataFrame) -> DataFrame:
    """A row for each session of day_budgets(): its draft, the g/kg before it that the budget leaves, whether that is split, and the hours of recovery."""
    rows = budgets.where("error is null").select("plan_id", F.posexplode("s").alias("i", "x"), "pre", "split", "hours")
    kept = ("start_min", "duration_min", "load", "pre_hours", "pre_time", "replaces_breakfast", "g_per_hour", "during_total", "multiple_transportable", "mouth_rinse", "feed_interval", "recovery_rate", "post_ride_dinner")
    return rows.select("plan_id", F.col("i").alias("session"), *[F.col("x")[c].alias(c) for c in kept], F.get("pre", F.col("i")).alias("pre_g_per_kg"), F.get("split", F.col("i")).alias("pre_split"), F.get("hours", F.col("i")).alias("recovery_hours"), F.lit(LEAST_PROTEIN).alias("recovery_protein_g_per_kg"))


def timeline(budgets: DataFrame, step: int = 5) -> DataFrame:
    """(plan_id, idx, time_min, kind, session, hour, carbs_g, protein_g) of what to eat when, a plan's entries in order of time.

    Entries of one kind and time are one. Grams are multiples of the step that add up to the rounded total, by largest remainder. Times past
    1440 are after midnight. Sums go in the order in which entries are made, a
    plan's in that of the remainders of carbohydrate.
    """
    rows = budgets.where("error is null").select("plan_id", F.posexplode(_timeline()).alias("made", "e")).select("plan_id", "made", "e.*")
    merged = sums_in_order(rows, ["plan_id", "time_min", "kind", "session", "hour"], "made", "carbs", "protein")
    w = Window.partitionBy("plan_id")
    merged = merged.withColumn("idx", F.row_number().over(w.orderBy("time_min", "made")) - 1)
    base = {c: F.floor(F.col(c) / step) for c in ("carbs", "protein")}
    by_rest = {c: w.orderBy(F.desc(F.col(c) / step - b), "idx") for c, b in base.items()}
    whole = by_rest["carbs"].rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = merged.withColumns({f"missing_{c}": F.floor(F.sum(c).over(whole) / step + 0.5) - F.sum(b).over(whole) for c, b in base.items()})
    for c, b in base.items():
        given = F.row_number().over(by_rest[c]) <= F.col(f"missing_{c}")
        merged = merged.withColumn(f"{c}_g", ((b + given.cast("int")) * step).cast("long"))
    return merged.select("plan_id", "idx", "time_min", "kind", "session", "hour", "carbs_g", "protein_g")


def day_plan(days: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans, sessions, entries): day_budgets() with carbs_planned_g, session_plans() and timeline().

    A day without sessions has its meals only; one with an error has a row in plans and none in the others.
    """
    budgets = day_budgets(days, sessions)
    entries = timeline(budgets)
    planned = entries.groupBy("plan_id").agg(F.sum("carbs_g").alias("carbs_planned_g"))
    return budgets.drop("s", "kept", "pre", "split", "hours", "weights").join(planned.hint("merge"), "plan_id", "left"), session_plans(budgets), entries


def fuel_week(athletes: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """day_plan() of every day from an athlete's first to the last planned session, rest days included; plan_id is (athlete_id, day).

    athletes are (athlete_id, mass and, if there are, ftp, wake_min, meals), sessions (athlete_id, day, seq, start_min, duration_min,
    intensity, planned_kj, priority). What the next two days ask for raises a day's target, plans carry why (reason, days_before, note),
    and the next day's first session decides about recovery. Sessions of unknown athletes are left out.
    """
    known = sessions.join(athletes.select("athlete_id", F.col("mass").cast("double").alias("mass"), (F.col("ftp") if "ftp" in athletes.columns else F.lit(None)).cast("double").alias("ftp")).hint("merge"), "athlete_id")
    c = F.col
    work = fn.session_work_kj(c("planned_kj"), c("duration_min"), c("intensity"), F.when(c("ftp") < float("inf"), c("ftp")), c("mass"))
    loads = daily_loads(known.select("athlete_id", "day", "seq", fn.session_load(work, c("mass"), c("intensity")).alias("load")), "athlete_id", "seq")
    own = loads.select("athlete_id", "day", fn.round_tenth(fn.carbs_g_per_kg(c("load"))).alias("own"))
    ahead = season.planned_days(known.select("athlete_id", "day", "seq", c("duration_min").alias("minutes"), "intensity", "priority"), "athlete_id")
    raised = season.raised(own, ahead, "athlete_id")
    following = known.groupBy("athlete_id", (c("day") - 1).alias("day")).agg(F.min("start_min").alias("tomorrow_start"))
    plan_id = F.struct("athlete_id", F.col("day").cast("long").alias("day"))
    extra = [x for x in ("ftp", "wake_min", "meals") if x in athletes.columns]
    days = raised.join(following.hint("merge"), ["athlete_id", "day"], "left").join(athletes.select("athlete_id", "mass", *extra).hint("merge"), "athlete_id")
    days = days.select(plan_id.alias("plan_id"), "mass", *extra, "tomorrow_start", F.when(c("reason").isNotNull(), c("to_g_per_kg")).alias("raised_to"), "reason", "days_before", "note")
    own_sessions = known.select(plan_id.alias("plan_id"), "seq", "start_min", "duration_min", "intensity", "planned_kj")
    plans, each, entries = day_plan(days, own_sessions)
    return plans.join(days.select("plan_id", "reason", "days_before", "note").hint("merge"), "plan_id", "left"), each, entries
