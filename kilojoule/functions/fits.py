"""Power-duration models of a curve's points, as Columns over array<struct<t, p>> (seconds, watts) in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a two- and a three-parameter fit and of an estimated FTP, and the W' (J) that such a fit is trusted with.
TWO_PARAMETER, THREE_PARAMETER, EFTP_RANGE, PLAUSIBLE_W_PRIME = (120, 1200), (10, 1200), (180, 1800), (5_000.0, 50_000.0)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(points: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, x: a + f(x))


def linear_fit(points: Column, x: Callable[[Column], Column], y: Callable[[Column], Column]) -> Column:
    """struct(slope, intercept, se_slope, se_intercept, n) by least squares; null for fewer than 3 points or a single x."""

    def spread(m: Column) -> Column:
        dx, dy = (lambda p: x(p) - m["mx"]), (lambda p: y(p) - m["my"])
        return F.struct(m["n"].alias("n"), m["mx"].alias("mx"), m["my"].alias("my"), _sum(points, lambda p: dx(p) * dx(p)).alias("sxx"), _sum(points, lambda p: dx(p) * dy(p)).alias("sxy"))

    def line(s: Column) -> Column:
        return F.struct(s["n"].alias("n"), s["mx"].alias("mx"), s["sxx"].alias("sxx"), (s["sxy"] / s["sxx"]).alias("slope"), (s["my"] - s["sxy"] / s["sxx"] * s["mx"]).alias("intercept"))

    def errors(b: Column) -> Column:
        off = lambda p: y(p) - (b["slope"] * x(p) + b["intercept"])
        return let(
            _sum(points, lambda p: off(p) * off(p)) / (b["n"] - 2),
            lambda s2: F.struct(b["slope"].alias("slope"), b["intercept"].alias("intercept"), F.sqrt(s2 / b["sxx"]).alias("se_slope"), F.sqrt(s2 * (1 / b["n"] + b["mx"] * b["mx"] / b["sxx"])).alias("se_intercept"), b["n"].alias("n")),
        )

    n = F.size(points)
    means = F.when(n >= 3, F.struct(n.alias("n"), (_sum(points, x) / n).alias("mx"), (_sum(points, y) / n).alias("my")))
    return let(means, lambda m: F.when(m.isNotNull(), let(spread(m), lambda s: F.when(s["sxx"] > 0, let(line(s), errors)))))


def fit_2p(points: Column) -> Column:
    """struct(cp, w_prime, r_squared, rmse, se_cp, se_w_prime, points) of work = W' + CP * t; null if it has fewer than 3 points or a value that isn't positive.

    r_squared (1 if all powers are equal) and rmse are those of the powers that the model gives.
    """

    def judged(f: Column) -> Column:
        off = lambda p: p["p"] - (f["intercept"] / p["t"] + f["slope"])
        mean = _sum(points, lambda p: p["p"]) / f["n"]
        about = let(mean, lambda m: F.struct(_sum(points, lambda p: off(p) * off(p)).alias("ss"), _sum(points, lambda p: (p["p"] - m) * (p["p"] - m)).alias("tot")))
        return let(
            about,
            lambda a: F.struct(
                f["slope"].alias("cp"), f["intercept"].alias("w_prime"), F.when(a["tot"] > 0, 1 - a["ss"] / a["tot"]).otherwise(1.0).alias("r_squared"), F.sqrt(a["ss"] / f["n"]).alias("rmse"),
                f["se_slope"].alias("se_cp"), f["se_intercept"].alias("se_w_prime"), f["n"].alias("points"),
            ),
        )

    return let(linear_fit(points, lambda p: p["t"], lambda p: p["p"] * p["t"]), lambda f: F.when((f["slope"] > 0) & (f["intercept"] > 0), judged(f)))


def predict(t: Column, cp: Column, w_prime: Column, k: Column | None = None) -> Column:
    """The watts that a model holds for t seconds."""
    return w_prime / (t - (F.lit(0.0) if k is None else F.coalesce(k, F.lit(0.0)))) + cp


def eftp(points: Column, fitted_w_prime: Column, fallback: Column) -> Column:
    """struct(eftp, duration_s, watts, w_prime): of the points in EFTP_RANGE the highest hyperbola's power over an hour; ties take the longest.

    Its W' is the fitted one where that is plausible, else the fallback.
    """
    low, high = PLAUSIBLE_W_PRIME
    inside = F.filter(points, lambda p: p["t"].between(*EFTP_RANGE))
    at = lambda p, w: F.struct((p["p"] - w / p["t"] + w / 3600).alias("eftp"), p["t"].cast("long").alias("duration_s"), p["p"].alias("watts"), w.alias("w_prime"))
    return let(F.when(fitted_w_prime.between(low, high), fitted_w_prime).otherwise(fallback), lambda w: F.array_max(F.transform(inside, lambda p: at(p, w))))
