"""Metrics of activities from their samples: aggregations, windows, and Arrow kernels where windows can't say it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilojoule.functions.fits import EFTP_RANGE, TWO_PARAMETER, eftp
from kilojoule.functions.metrics import HR_ZONES, POWER_ZONES, intensity_factor, positive, trimp, tss, zone_of

NP_WINDOW = 30
DEFAULT_W_PRIME = 20_000.0
#: Length of the blocks of W' balance, as an exponent.
EXPONENT_BLOCK = 300.0


def by():
    return Window.partitionBy("activity_id")


def in_order():
    return by().orderBy("idx")


@dataclass(frozen=True)
class Athlete:
    ftp: float | None = None
    weight_kg: float | None = None
    lthr: float | None = None
    max_hr: float | None = None
    resting_hr: float | None = None
    cp: float | None = None
    w_prime: float | None = None
    trimp: str = "men"


def moving(speed: Column, least: float = 0.5) -> Column:
    """A second counts as moving where its speed is unknown or above `least`."""
    return F.coalesce(speed > least, F.lit(True))


def with_rolling(samples: DataFrame) -> DataFrame:
    """samples with `rolling`, the sum of power over the last 30 rows, null before there are 30."""
    n = F.count("*").over(in_order().rowsBetween(-(NP_WINDOW - 1), 0))
    return samples.withColumn("rolling", F.when(n == NP_WINDOW, F.sum("power").over(in_order().rowsBetween(-(NP_WINDOW - 1), 0))))


def normalized_power() -> Column:
    """Aggregate over with_rolling(): the fourth root of the mean fourth power of 30-second means."""
    return F.sqrt(F.sqrt(F.avg(F.pow(F.col("rolling") / NP_WINDOW, F.lit(4.0)))))


def power_summary(samples: DataFrame, ftp: float | None, moving_load: bool = True) -> DataFrame:
    """activity_id, seconds, moving_seconds, avg_power, max_power, work_kj, np, intensity, vi, tss; all null without any power."""
    rows = with_rolling(samples)
    has = F.bool_or(~F.col("power_dropout")) if "power_dropout" in samples.columns else F.lit(True)
    speed = F.col("speed") if "speed" in samples.columns else F.lit(None).cast("double")
    out = rows.groupBy("activity_id").agg(
        F.count("*").alias("seconds"), F.count_if(moving(speed)).alias("moving_seconds"), has.alias("has_power"), F.avg("power").alias("avg_power"), F.max("power").alias("max_power"), (F.sum("power") / 1000).alias("work_kj"), normalized_power().alias("np"),
    )
    ftp_ = F.lit(ftp).cast("double")
    only = lambda c: F.when(F.col("has_power"), c)
    out = out.select("activity_id", "seconds", "moving_seconds", *[only(F.col(c)).alias(c) for c in ("avg_power", "max_power", "work_kj", "np")])
    load = F.col("moving_seconds") if moving_load else F.col("seconds")
    return out.withColumns({"intensity": intensity_factor(F.col("np"), ftp_), "vi": F.col("np") / positive(F.col("avg_power")), "tss": tss(load, F.col("np"), ftp_)})


def heart_rate_summary(samples: DataFrame, athlete: Athlete, moving_load: bool = True) -> DataFrame:
    """activity_id, avg_hr, max_hr, hr_tss, decoupling (%): over rows with a heart rate; halves are by row count."""
    half = F.floor(F.count("*").over(by()) / 2)
    rows = samples.withColumn("late", F.col("idx") >= half)
    known = F.col("heart_rate").isNotNull()
    part = lambda c, late: F.sum(F.when(known & (F.col("late") == late), F.col(c)))
    ratio = lambda late: part("power", late) / positive(part("heart_rate", late))
    rest, lthr, top = (F.lit(x).cast("double") for x in (athlete.resting_hr, athlete.lthr, athlete.max_hr))
    speed = F.col("speed") if "speed" in samples.columns else F.lit(None).cast("double")
    counted = F.when(moving(speed), F.col("heart_rate")) if moving_load else F.col("heart_rate")
    hour = trimp(lthr, rest, top, athlete.trimp) * 3600
    ok = (rest < lthr) & (lthr < top)
    out = rows.groupBy("activity_id").agg(F.avg("heart_rate").alias("avg_hr"), F.max("heart_rate").alias("max_hr"), F.sum(trimp(counted, rest, top, athlete.trimp)).alias("impulse"), ratio(False).alias("r1"), ratio(True).alias("r2"))
    return out.select("activity_id", "avg_hr", "max_hr", F.when(ok, F.col("impulse") / hour * 100).alias("hr_tss"), ((F.col("r1") - F.col("r2")) / positive(F.col("r1")) * 100).alias("decoupling"))


def zone_seconds(samples: DataFrame, column: str, reference: float, bounds: Sequence[float]) -> DataFrame:
    """(activity_id, zones): seconds in each zone; nulls are in none."""
    zone = zone_of(F.col(column), F.lit(reference), tuple(bounds))
    return samples.groupBy("activity_id").agg(F.array([F.count_if(zone == i) for i in range(len(bounds) + 1)]).alias("zones"))


def mean_max_at(samples: DataFrame, durations: Sequence[int]) -> DataFrame:
    """(activity_id, duration_s, best_sum): the best sum of power over each duration; durations longer than the activity are left out.

    A running sum and its lag for each duration: one sort, whatever the number of durations.
    """
    total = samples.withColumn("total", F.sum("power").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    wanted = sorted({d for d in durations if d > 0})
    sums = total.select("activity_id", "idx", *[F.when(F.col("idx") >= d - 1, F.col("total") - F.coalesce(F.lag("total", d).over(in_order()), F.lit(0))).alias(f"d{d}") for d in wanted])
    best = sums.groupBy("activity_id").agg(*[F.max(f"d{d}").alias(f"d{d}") for d in wanted])
    pairs = F.array([F.struct(F.lit(d).alias("duration_s"), F.col(f"d{d}").cast("long").alias("best_sum")) for d in wanted])
    return best.select("activity_id", F.explode(pairs).alias("p")).select("activity_id", "p.*").where("best_sum is not null")


def power_curve(samples: DataFrame) -> DataFrame:
    """(activity_id, duration_s, best_sum) for every duration: a kernel over an activity's running sums, each activity in a task."""

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        sums = np.concatenate([[0], np.cumsum(np.asarray(table.column("power"), np.int64))])
        n = len(sums) - 1
        best = np.fromiter(((sums[d:] - sums[: n + 1 - d]).max() for d in range(1, n + 1)), np.int64, n)
        return pa.table({"activity_id": pa.array([table.column("activity_id")[0].as_py()] * n, table.schema.field("activity_id").type), "duration_s": pa.array(np.arange(1, n + 1)), "best_sum": pa.array(best)})

    kind = samples.schema["activity_id"].dataType.simpleString()
    return samples.select("activity_id", "idx", F.col("power").cast("long")).groupBy("activity_id").applyInArrow(kernel, f"activity_id {kind}, duration_s long, best_sum long")


def envelope(curve: DataFrame) -> DataFrame:
    """The curve with `envelope`, the best watts over a duration or any longer one."""
    w = by().orderBy(F.desc("duration_s")).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("envelope", F.max(F.col("best_sum") / F.col("duration_s")).over(w))


def with_balance(samples: DataFrame, cp: float | Column, w_prime: float | Column = DEFAULT_W_PRIME) -> DataFrame:
    """samples with `balance`, what is left of W' after each row; a pause is one step at 0 W. Null if either isn't positive and finite.

    What is expended is a linear recurrence, e_t = e_(t-1) * exp(-a_t) + b_t, so e_t = exp(-A_t) * sum(b_i * exp(A_i)) with running
    sums. Rows are in blocks of EXPONENT_BLOCK along A, each with sums of its own so that no exponential overflows; a block takes over
    what the one before left, and what is older has decayed below the least digit.
    """
    cp, w_prime = (F.lit(x).cast("double") if not isinstance(x, Column) else x for x in (cp, w_prime))
    usable = lambda x: F.when((x > 0) & (x < float("inf")), x)
    cp, w_prime = usable(cp), usable(w_prime)
    gap = F.coalesce(F.col("elapsed") - F.lag("elapsed").over(in_order()) - 1, F.lit(0)) if "elapsed" in samples.columns else F.lit(0)
    a = F.greatest(cp - F.col("power"), F.lit(0.0)) / w_prime + F.col("_gap") * (cp / w_prime)
    rows = samples.withColumn("_gap", gap).withColumn("_a", F.sum(a).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("_a") / EXPONENT_BLOCK), F.lit(0))).withColumn("_a", F.col("_a") - F.col("_block") * EXPONENT_BLOCK)
    rows = rows.withColumn("_b", F.greatest(F.col("power") - cp, F.lit(0.0)) * F.exp("_a"))
    own = F.sum("_b").over(Window.partitionBy("activity_id", "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_b").over(by().orderBy("_block").rangeBetween(-1, -1)), F.lit(0.0)) * math.exp(-EXPONENT_BLOCK)
    rows = rows.withColumn("_own", own).withColumn("_before", before)
    return rows.withColumn("balance", w_prime - F.exp(-F.col("_a")) * (F.col("_own") + F.col("_before"))).drop("_gap", "_a", "_block", "_b", "_own", "_before")


def w_prime_balance(samples: DataFrame, cp: float, w_prime: float = DEFAULT_W_PRIME) -> DataFrame:
    """(activity_id, idx, balance) of with_balance(); no rows if cp or w_prime isn't positive."""
    return with_balance(samples, cp, w_prime).where("balance is not null").select("activity_id", "idx", "balance")


def least_balance(balance: DataFrame) -> DataFrame:
    """(activity_id, balance, idx) of the first least balance."""
    return balance.groupBy("activity_id").agg(F.min(F.struct("balance", "idx")).alias("m")).select("activity_id", "m.*")


def sums_in_order(rows: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """The first row by `order` of each key, with `values` summed over the key's rows.

    Doubles are added in that order, so a sum's last digit doesn't depend on how the rows are dealt out.
    """
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({**{v: F.sum(v).over(whole) for v in values}, "_turn": F.row_number().over(w)}).where("_turn = 1").drop("_turn")


def daily_loads(loads: DataFrame, by: str, order: str | None = None) -> DataFrame:
    """(by, day, load): loads summed by day, every day from the first to the last of its key, days without any 0.

    A day's loads are added in the order of the column `order`, in any order without one.
    """
    loads = loads.withColumn("day", F.col("day").cast("long"))
    sums = sums_in_order(loads, [by, "day"], order, "load") if order else loads.groupBy(by, "day").agg(F.sum("load").alias("load"))
    following = F.coalesce(F.lead("day").over(Window.partitionBy(by).orderBy("day")), F.col("day") + 1)
    filled = sums.withColumn("following", following).select(by, "load", F.posexplode(F.sequence("day", F.col("following") - 1)).alias("k", "day"))
    return filled.select(by, "day", F.when(F.col("k") == 0, F.coalesce("load", F.lit(0.0))).otherwise(0.0).alias("load"))


@dataclass(frozen=True)
class LoadConfig:
    ctl_days: float = 42.0
    atl_days: float = 7.0
    ctl0: float = 0.0
    atl0: float = 0.0
    exponential: bool = True
    tsb_of_yesterday: bool = False


def _decaying(rows: DataFrame, by: str, value: str, keep: float, out: str) -> DataFrame:
    """rows (by, _turn, value) with `out`, the sum of all values so far, each times `keep` for every turn since; in blocks, see with_balance()."""
    if keep <= 0:
        return rows.withColumn(out, F.col(value))
    at = F.col("_turn") * -math.log(keep)
    rows = rows.withColumn("_block", F.floor(at / EXPONENT_BLOCK)).withColumn("_a", at - F.col("_block") * EXPONENT_BLOCK).withColumn("_b", F.col(value) * F.exp("_a"))
    own = F.sum("_b").over(Window.partitionBy(by, "_block").orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_b").over(Window.partitionBy(by).orderBy("_block").rangeBetween(-1, -1)), F.lit(0.0)) * math.exp(-EXPONENT_BLOCK)
    return rows.withColumn("_own", own).withColumn("_before", before).withColumn(out, F.exp(-F.col("_a")) * (F.col("_own") + F.col("_before"))).drop("_block", "_a", "_b", "_own", "_before")


def training_load(daily: DataFrame, by: str, cfg: LoadConfig = LoadConfig()) -> DataFrame:
    """daily (by, day, load) with ctl, atl and tsb, exponentially weighted means over a key's days in order.

    Running sums and no loop: all windows share one partitioning by the key, also those of several settings after one another.
    """
    share = lambda days: 1 - math.exp(-1 / days) if cfg.exponential else 1 / days
    rows = daily.withColumn("_turn", F.row_number().over(Window.partitionBy(by).orderBy("day")) - 1)
    for name, days, seed in (("ctl", cfg.ctl_days, cfg.ctl0), ("atl", cfg.atl_days, cfg.atl0)):
        w = share(days)
        seeded = F.lit(seed) * F.pow(F.lit(1 - w), F.col("_turn") + 1) if seed else F.lit(0.0)
        rows = _decaying(rows, by, "load", 1 - w, name).withColumn(name, F.col(name) * w + seeded)
    form = F.col("ctl") - F.col("atl")
    if cfg.tsb_of_yesterday:
        form = F.coalesce(F.lag(form).over(Window.partitionBy(by).orderBy("day")), F.lit(cfg.ctl0 - cfg.atl0))
    return rows.withColumn("tsb", form).drop("_turn")


def season_curve(curves: DataFrame, by: str) -> DataFrame:
    """(by, duration_s, best_sum, source) from (by, activity_id, added, duration_s, best_sum): the earliest added wins ties."""
    best = F.max(F.struct("best_sum", (-F.col("added")).alias("first"), F.col("activity_id").alias("source")))
    return curves.groupBy(by, "duration_s").agg(best.alias("b")).select(by, "duration_s", "b.best_sum", "b.source")


def _fit_sums(when: Column | None = None) -> list[Column]:
    """Aggregates over points (t, p) that fit_2p() needs: counts, means and centred sums of times, works, powers and inverse times."""
    when = F.lit(True) if when is None else when
    t, p = F.when(when & F.col("p").isNotNull(), F.col("t")), F.when(when & F.col("t").isNotNull(), F.col("p"))
    w, u = p * t, 1 / t
    out = {"n": F.count(t), "mt": F.avg(t), "mw": F.avg(w), "mp": F.avg(p), "mu": F.avg(u), "vt": F.var_pop(t), "vw": F.var_pop(w), "vp": F.var_pop(p), "vu": F.var_pop(u), "ctw": F.covar_pop(t, w), "cpu": F.covar_pop(p, u)}
    return [c.alias(f"_{k}") for k, c in out.items()]


def _fitted(sums: DataFrame) -> DataFrame:
    """sums with cp, w_prime, r2, rmse, se_cp, se_w_prime and n of the line through works; all but n null if there are fewer than 3
    points or either value isn't positive. r2 (1 if all powers are equal) and rmse are those of the powers that it gives, from the same sums."""
    c = lambda k: F.col(f"_{k}")
    n = c("n")
    rows = sums.withColumn("cp", F.when((n >= 3) & (c("vt") > 0), c("ctw") / c("vt"))).withColumn("w_prime", c("mw") - F.col("cp") * c("mt"))
    rows = rows.withColumn("_ok", (F.col("cp") > 0) & (F.col("w_prime") > 0)).withColumns({k: F.when(F.col("_ok"), F.col(k)) for k in ("cp", "w_prime")})
    aside = c("mp") - F.col("w_prime") * c("mu") - F.col("cp")
    off = F.greatest(c("vp") - 2 * F.col("w_prime") * c("cpu") + F.col("w_prime") * F.col("w_prime") * c("vu"), F.lit(0.0)) + aside * aside
    s2 = F.when(F.col("_ok"), F.greatest(c("vw") - c("ctw") * c("ctw") / c("vt"), F.lit(0.0)) * n / (n - 2))
    rows = rows.withColumns({"_off": off, "_s2": s2})
    return rows.withColumns(
        {"r2": F.when(F.col("_ok"), F.when(c("vp") > 0, 1 - c("off") / c("vp")).otherwise(1.0)), "rmse": F.sqrt("_off"), "se_cp": F.sqrt(c("s2") / (n * c("vt"))), "se_w_prime": F.sqrt(c("s2") * (1 / n + c("mt") * c("mt") / (n * c("vt")))), "n": n}
    )


def fit_2p(points: DataFrame, by: str) -> DataFrame:
    """(by, cp, w_prime, r2, rmse, n, se_cp, se_w_prime) of work = W' + CP * t from (by, t, p), in one aggregation; no row for fewer than
    3 points or if either isn't positive."""
    return _fitted(points.groupBy(by).agg(*_fit_sums())).where("_ok").select(by, "cp", "w_prime", "r2", "rmse", "n", "se_cp", "se_w_prime")


def _line_for(t: np.ndarray, p: np.ndarray, k: float) -> tuple[float, float] | None:
    """(cp, w_prime) of p = w_prime / (t - k) + cp by least squares."""
    x = 1 / (t - k)
    mx, mp = x.mean(), p.mean()
    sxx = ((x - mx) ** 2).sum()
    if len(t) < 3 or not sxx > 0:
        return None
    w_prime = ((x - mx) * (p - mp)).sum() / sxx
    return mp - w_prime * mx, w_prime


def _best_k(t: np.ndarray, p: np.ndarray, low: float = -600.0, high: float = -0.01, steps: int = 80) -> float:
    """The k of least squared error, by golden section; equal errors keep the right part."""

    def error(k: float) -> float:
        line = _line_for(t, p, k)
        return float("inf") if line is None else float(((p - line[1] / (t - k) - line[0]) ** 2).sum())

    ratio = (5**0.5 - 1) / 2
    inner = [high - (high - low) * ratio, low + (high - low) * ratio]
    errors = [error(k) for k in inner]
    for _ in range(steps):
        if errors[0] < errors[1]:
            high = inner[1]
            inner = [high - (high - low) * ratio, inner[0]]
            errors = [error(inner[0]), errors[0]]
        else:
            low = inner[0]
            inner = [inner[1], low + (high - low) * ratio]
            errors = [errors[1], error(inner[1])]
    return (low + high) / 2


def fit_3p(points: DataFrame, by: str) -> DataFrame:
    """(by, cp, w_prime, k, p_max, r2, rmse, n) of p = W' / (t - k) + CP from (by, t, p); no row for fewer than 4 points or if either isn't positive.

    A group is one curve's points at the durations of a fit, some dozens.
    """

    def fit(group):
        t, p = group["t"].to_numpy(float), group["p"].to_numpy(float)
        out = group[[by]].head(1)
        k = _best_k(t, p) if len(t) >= 4 else 0.0
        line = _line_for(t, p, k) if len(t) >= 4 else None
        if line is None or not (line[0] > 0 and line[1] > 0):
            return out.head(0).assign(cp=0.0, w_prime=0.0, k=0.0, p_max=0.0, r2=0.0, rmse=0.0, n=0)
        cp, w_prime = line
        off, spread = ((p - w_prime / (t - k) - cp) ** 2).sum(), ((p - p.mean()) ** 2).sum()
        return out.assign(cp=cp, w_prime=w_prime, k=k, p_max=cp - w_prime / k, r2=1 - off / spread if spread > 0 else 1.0, rmse=(off / len(t)) ** 0.5, n=len(t))

    kind = points.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, cp double, w_prime double, k double, p_max double, r2 double, rmse double, n long"
    return points.where("t is not null and p is not null").select(by, F.col("t").cast("double").alias("t"), F.col("p").cast("double").alias("p")).groupBy(by).applyInPandas(fit, schema)


def estimate_ftp(points: DataFrame, by: str, fallback: float = DEFAULT_W_PRIME) -> DataFrame:
    """(by, eftp, duration_s, watts, w_prime): the best power over an hour that any point from 180 to 1800 s stands for; ties take the
    longest. The fit of the points from 120 to 1200 s and the search share one aggregation; a group is one curve's points."""
    own = F.collect_list(F.when(F.col("t").between(*EFTP_RANGE) & F.col("p").isNotNull(), F.struct(F.col("t").cast("double").alias("t"), F.col("p").cast("double").alias("p"))))
    rows = _fitted(points.groupBy(by).agg(own.alias("_points"), *_fit_sums(F.col("t").between(*TWO_PARAMETER))))
    return rows.withColumn("best", eftp(F.col("_points"), F.col("w_prime"), F.lit(float(fallback)))).where("best is not null").select(by, "best.*")


def workout_profile(steps: DataFrame, ftp: float) -> DataFrame:
    """(activity_id, idx, power) a second from steps (activity_id, seq, duration_s, from_pct, to_pct); ramps are sampled mid-second."""
    w = Window.partitionBy("activity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("begin", F.coalesce(F.sum("duration_s").over(w), F.lit(0))).where("duration_s > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("duration_s").cast("int") - 1)).alias("k"))
    pct = F.col("from_pct") + (F.col("to_pct") - F.col("from_pct")) * (F.col("k") + 0.5) / F.col("duration_s")
    watts = F.least(F.floor(F.greatest(pct, F.lit(0.0)) / 100 * ftp + 0.5), F.lit(65535)).cast("int")
    return rows.select("activity_id", (F.col("begin") + F.col("k")).cast("int").alias("idx"), watts.alias("power"))


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        c = F.replace(c, F.lit(sign), F.lit(f"&{name};"))
    return F.regexp_replace(c, r"\p{Cc}", "")


def to_zwo(workouts: DataFrame, steps: DataFrame) -> DataFrame:
    """(activity_id, zwo): workouts (activity_id, name) as XML, from steps (activity_id, seq, kind, duration_s, from_pct, to_pct).

    A step whose to_pct is null is steady at from_pct; a ramp is a warm-up or a cool-down where its kind (warmup, cooldown) says so. A
    workout without steps has an empty list; a null name is empty.
    """
    part = lambda pct: F.format_string("%.3f", F.col(pct) / 100)
    quoted = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    tag = F.when(F.col("kind") == "warmup", "Warmup").when(F.col("kind") == "cooldown", "Cooldown").otherwise("Ramp")
    lasting = quoted("Duration", F.col("duration_s").cast("string"))
    steady = F.concat(F.lit("    <SteadyState"), lasting, quoted("Power", part("from_pct")), F.lit("/>\n"))
    ramp = F.concat(F.lit("    <"), tag, lasting, quoted("PowerLow", part("from_pct")), quoted("PowerHigh", part("to_pct")), F.lit("/>\n"))
    lines = steps.select("activity_id", "seq", F.when(F.col("to_pct").isNull(), steady).otherwise(ramp).alias("line"))
    # a workout's steps, some dozens
    body = lines.groupBy("activity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "").alias("body"))
    head = F.concat(F.lit("<workout_file>\n  <author>kilojoule</author>\n  <name>"), _escaped(F.coalesce("name", F.lit(""))), F.lit("</name>\n  <description>Exported from kilojoule</description>\n  <sportType>bike</sportType>\n  <tags/>\n  <workout>\n"))
    return workouts.join(body, "activity_id", "left").select("activity_id", F.concat(head, F.coalesce("body", F.lit("")), F.lit("  </workout>\n</workout_file>\n")).alias("zwo"))


def round_grams(entries: DataFrame, by: str, step: int = 5) -> DataFrame:
    """entries (by, idx, grams) with `rounded`: multiples of the step that add up to the rounded total, by largest remainder."""
    w = Window.partitionBy(by)
    rows = entries.withColumn("base", F.floor(F.col("grams") / step)).withColumn("rem", F.col("grams") / step - F.col("base"))
    rows = rows.withColumn("missing", F.floor(F.sum("grams").over(w) / step + 0.5) - F.sum("base").over(w))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rem"), "idx"))
    return rows.withColumn("rounded", ((F.col("base") + (rank <= F.col("missing")).cast("int")) * step).cast("long")).drop("base", "rem", "missing")


def zones_of_activity(samples: DataFrame, athlete: Athlete) -> DataFrame:
    """(activity_id, power_zones, hr_zones) with the common seven-zone bounds, in one aggregation."""
    parts = (("power", athlete.ftp, POWER_ZONES), ("heart_rate", athlete.lthr, HR_ZONES))
    rows = samples.select("activity_id", *[zone_of(F.col(c), F.lit(ref), bounds).alias(c) for c, ref, bounds in parts])
    counts = [F.array([F.count_if(F.col(c) == i) for i in range(len(bounds) + 1)]).alias(name) for (c, _, bounds), name in zip(parts, ("power_zones", "hr_zones"))]
    return rows.groupBy("activity_id").agg(*counts)
