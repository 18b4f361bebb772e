"""Scalar rules as Columns: power and heart-rate formulas, zones, and the fuelling rules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of zones as shares of the reference, and the coefficients of hrTSS.
POWER_ZONES = (0.55, 0.75, 0.90, 1.05, 1.20, 1.50)
HR_ZONES = (0.81, 0.89, 0.93, 0.99, 1.02, 1.06)
TRIMP = {"men": (0.64, 1.92), "women": (0.86, 1.67)}
STANDARD_DURATIONS = (1, 2, 3, 5, 8, 10, 15, 20, 30, 45, 60, 90, 120, 180, 240, 300, 480, 600, 900, 1200, 1800, 3600, 7200, 21600)
#: Day's carbohydrate, g/kg, at loads in kJ/kg; straight lines between, flat outside.
CARB_ANCHORS = ((0, 3.0), (8, 5.0), (15, 6.5), (35, 9.0), (60, 12.0))
LOAD_CUTS = (8, 15, 35)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def intensity_factor(np: Column, ftp: Column) -> Column:
    return np / positive(ftp)


def tss(seconds: Column, np: Column, ftp: Column) -> Column:
    return seconds * np * intensity_factor(np, ftp) / (positive(ftp) * 3600) * 100


def zone_of(value: Column, reference: Column, bounds: tuple[float, ...]) -> Column:
    """The first zone, from 0, whose bound times the reference isn't below the value; the last for others and NaN."""
    step = lambda out, b: F.when(value <= F.lit(b[1]) * reference, b[0]).otherwise(out)
    return F.when(value.isNotNull(), reduce(step, reversed(list(enumerate(bounds))), F.lit(len(bounds))))


def trimp(hr: Column, rest: Column, top: Column, kind: str = "men") -> Column:
    """The training impulse of a second at a heart rate."""
    a, b = TRIMP[kind]
    x = F.least(F.greatest((hr - rest) / (top - rest), F.lit(0.0)), F.lit(1.0))
    return x * a * F.exp(x * b) / 60


def trimp_of(hr: Column, rest: Column, top: Column, kind: Column) -> Column:
    """trimp() where the kind is a column, too."""
    by_kind = lambda i: reduce(lambda out, k: F.when(kind == k, TRIMP[k][i]).otherwise(out), TRIMP, F.lit(None).cast("double"))
    x = F.least(F.greatest((hr - rest) / positive(top - rest), F.lit(0.0)), F.lit(1.0))
    return x * by_kind(0) * F.exp(x * by_kind(1)) / 60


def curve_grid(longest: int) -> list[int]:
    """Durations at which a curve is stored: every second to 20, then steps of a tenth, and the longest."""
    out, d = [], 1
    while d < longest:
        out.append(d)
        d += 1 if d < 20 else math.ceil(d / 10)
    return [*out, longest] if longest > 0 else []


def fit_durations(low: int, high: int) -> list[int]:
    """Durations of a fit: from low, each a tenth longer, and high."""
    out, t = [], float(low)
    while t < high:
        if not out or round(t) != out[-1]:
            out.append(round(t))
        t *= 1.1
    return out if out and out[-1] == high else [*out, high]


# --- fuelling


def intensity_weight(intensity: Column) -> Column:
    return F.when(F.isnan(intensity), 1.0).otherwise(F.least(F.greatest(intensity / 0.75, F.lit(0.6)), F.lit(1.4)))


def session_work_kj(planned: Column, minutes: Column, intensity: Column, ftp: Column, mass: Column) -> Column:
    by_time = minutes * 60 * F.greatest(intensity, F.lit(0.0)) * F.coalesce(positive(ftp), mass * 3) / 1000
    return F.when((planned >= 0) & ~F.isnan(planned), planned).otherwise(by_time)


def session_load(work: Column, mass: Column, intensity: Column) -> Column:
    return F.when(mass > 0, work / positive(mass) * intensity_weight(intensity)).otherwise(0.0)


def carbs_g_per_kg(load: Column) -> Column:
    out = F.lit(CARB_ANCHORS[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(CARB_ANCHORS, CARB_ANCHORS[1:]))):
        out = F.when(load < x1, y0 + (load - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(F.isnan(load) | (load <= 0), CARB_ANCHORS[0][1]).otherwise(out)


def protein_g_per_kg(load: Column) -> Column:
    return F.when(F.isnan(load), 1.2).otherwise(1.2 + 0.8 * F.least(F.greatest(load / 60, F.lit(0.0)), F.lit(1.0)))


def load_band(load: Column) -> Column:
    names = ("light", "moderate", "high", "very_high")
    return reduce(lambda out, b: F.when(load < b[0], b[1]).otherwise(out), reversed(list(zip(LOAD_CUTS, names))), F.lit(names[-1]))


def demand(load: Column) -> Column:
    return F.when(F.isnan(load), 0.0).otherwise(F.least(F.greatest(load / 35, F.lit(0.0)), F.lit(1.0)))


def pre_ride_hours(load: Column, available: Column) -> Column:
    """Hours before a ride to eat in, and as many g/kg."""
    return F.least(F.greatest(F.least(1 + 3 * demand(load), F.greatest(available, F.lit(1.0))), F.lit(1.0)), F.lit(4.0))


def in_ride_g_per_hour(minutes: Column, intensity: Column) -> Column:
    s = F.when(F.isnan(intensity), 0.0).otherwise(F.least(F.greatest((intensity - 0.55) / 0.30, F.lit(0.0)), F.lit(1.0)))
    grams = F.when(minutes <= 45, F.lit(0.0)).when(minutes <= 75, 30 * s).when(minutes <= 120, 30 + 30 * s).when(minutes <= 150, 45 + 15 * s).otherwise(60 + 30 * s)
    return F.floor(grams + 0.5)


def mouth_rinse(minutes: Column, intensity: Column) -> Column:
    return (minutes >= 46) & (minutes <= 75) & (intensity >= 0.85)


def recovery_hours(load: Column, gap_hours: Column) -> tuple[Column, Column]:
    """(carbohydrate in g/kg an hour, hours) after a ride whose next one is gap_hours away; 0 from eight hours on."""
    rapid = F.coalesce(gap_hours < 8, F.lit(False))
    hours = F.greatest(F.floor(F.least(F.greatest(gap_hours, F.lit(0.0)), F.lit(4.0))), F.lit(1))
    return F.when(rapid, 1 + 0.2 * demand(load)).otherwise(0.0), F.when(rapid, hours).otherwise(0)


def band_for_carbs(grams: Column) -> Column:
    """The load band that a day's carbohydrate, g/kg, belongs to."""
    return F.when(grams < 5, "light").when(grams < 6.5, "moderate").when(grams < 9, "high").otherwise("very_high")


def round_tenth(c: Column) -> Column:
    return F.floor(c * 10 + 0.5) / 10


def floor15(minute: Column) -> Column:
    """The quarter hour that a minute of the day is in."""
    return (minute - minute % 15).cast("int")


def ceil15(minute: Column) -> Column:
    return floor15(minute + 14)


def meal_floor(kind: Column, day_grams: Column) -> Column:
    """Least carbohydrate of a meal, g/kg, on a day of so many; a snack has half."""
    main = F.greatest(day_grams * 0.1, F.lit(0.5))
    return F.when(kind.isin("evening_snack", "snack"), main / 2).otherwise(main)


def multiple_transportable(grams_per_hour: Column) -> Column:
    """Whether carbohydrate comes faster than one kind of sugar is taken up."""
    return grams_per_hour > 60
