"""The day plan against a plain version that goes step by step, on random days and on days by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kilojoule.operators import dayplan

MEALS = [("breakfast", 420), ("lunch", 750), ("dinner", 1110), ("evening_snack", 1290)]


def down(t):
    return t // 15 * 15


def up(t):
    return down(t + 14)


def clamp(x, low, high):
    return min(max(x, low), high)


def carbs_for(load):
    points = [(0, 3.0), (8, 5.0), (15, 6.5), (35, 9.0), (60, 12.0)]
    if load <= 0:
        return 3.0
    for (a, y), (b, z) in zip(points, points[1:]):
        if load < b:
            return y + (load - a) * ((z - y) / (b - a))
    return 12.0


def plain(day, sessions):
    """(error, None) or (None, budget parts and entries)."""
    mass, wake, meals, tomorrow, raised = day["mass"], day["wake_min"], day["meals"], day["tomorrow_start"], day["raised_to"]
    if mass is None or not (0 < mass < math.inf):
        return "invalid_body_mass", None
    if any(b[0] < a[0] + a[1] for a, b in zip(sessions, sessions[1:])):
        return "overlap", None
    drafts, earliest = [], wake
    for i, (start, minutes, intensity) in enumerate(sessions):
        d = {"start": start, "minutes": minutes, "end": start + minutes}
        load = minutes * 60 * max(intensity, 0) * (mass * 3) / 1000 / mass * clamp(intensity / 0.75, 0.6, 1.4)
        need = clamp(load / 35, 0, 1)
        hours = max(math.floor(clamp(min(1 + 3 * need, max(max(start - earliest, 0) / 60, 1)), 1, 4) * 2) / 2, 1.0)
        d |= {"load": load, "hours": hours, "pre": min(max(down(max(start - int(hours * 60 + 0.5), 0)), up(earliest)), down(start))}
        at = dict(meals)
        d["replaces"] = i == 0 and (start <= wake + 150 or (hours >= 2 and "breakfast" in at and abs(at["breakfast"] - d["pre"]) < 60))
        s = clamp((intensity - 0.55) / 0.3, 0, 1)
        d["rate"] = math.floor((0 if minutes <= 45 else 30 * s if minutes <= 75 else 30 + 30 * s if minutes <= 120 else 45 + 15 * s if minutes <= 150 else 60 + 30 * s) + 0.5)
        d["during"] = d["rate"] * minutes / 60
        d["next"] = sessions[i + 1][0] if i + 1 < len(sessions) else None if tomorrow is None else tomorrow + 1440
        gap = None if d["next"] is None else max(d["next"] - d["end"], 0) / 60
        d["wanted"], d["recovery"] = (max(math.floor(clamp(gap, 0, 4)), 1), 1 + 0.2 * need) if gap is not None and gap < 8 else (0, 0.0)
        d["dinner"] = up(d["end"] + 30) if "dinner" in at and max(d["pre"] - 60, 0) <= at["dinner"] < d["end"] + 60 else None
        d["after"] = up(d["end"]) if d["dinner"] is None else d["dinner"]
        d["meal"] = hours >= 2 or d["replaces"]
        drafts.append(d)
        earliest = d["end"]
    load = sum(d["load"] for d in drafts)
    own = math.floor(carbs_for(load) * 10 + 0.5) / 10
    grams = max(own, math.floor(raised * 10 + 0.5) / 10) if raised is not None else own
    target = grams * mass
    last = next((d["dinner"] for d in reversed(drafts) if d["dinner"] is not None), None)
    kept = []
    for kind, t in meals:
        near = any(abs(t - f) < 60 for d in drafts for f in ([d["pre"]] + ([up(d["end"])] if d["dinner"] is None else [])))
        inside = any(max(d["start"] - 30, 0) <= t < d["end"] for d in drafts)
        gone = kind == "breakfast" and any(d["replaces"] for d in drafts) or kind == "dinner" and last is not None or kind == "evening_snack" and last is not None and t < last + 90
        if not (near or inside or gone):
            kept.append((kind, up(t)))
    if last is not None:
        kept.append(("post_ride_dinner", last))
    if not kept:
        kept.append(("dinner", up(max(max((up(d["end"]) for d in drafts), default=0) + 60, 1110))))
    base = 1.2 + 0.8 * clamp(load / 60, 0, 1)
    feeds = sum(d["meal"] + (d["dinner"] is None) for d in drafts)
    for _ in range(3):
        if base / (feeds + len(kept)) <= 0.4 + 1e-9:
            break
        times = sorted([t for _, t in kept] + [d["pre"] for d in drafts if d["meal"]] + [d["after"] for d in drafts] + [up(wake)])
        best = None
        for a, b in zip(times, times[1:]):
            if b - a > 210 and not any(d["start"] < b and d["end"] > a for d in drafts) and (best is None or b - a >= best[1] - best[0]):
                best = (a, b)
        if best is None:
            break
        kept.append(("snack", down(best[0] + (best[1] - best[0]) // 2)))
    small = lambda kind: kind in ("snack", "evening_snack")
    floor = lambda kind: max(0.1 * grams, 0.5) / (2 if small(kind) else 1) * mass
    fixed = sum(floor(k) for k, _ in kept) + sum(d["during"] for d in drafts) + len(drafts) * mass + sum(d["recovery"] * mass for d in drafts if d["wanted"])
    budget = max(target - fixed, 0)
    for d in drafts:
        extra = min((d["hours"] - 1) * mass, budget)
        budget -= extra
        d["g"] = 1 + extra / mass
        d["split"] = d["g"] > 2 and d["pre"] + 60 < max(d["start"] - 60, 0)
    for i, d in enumerate(drafts):
        d["fed"] = d["wanted"]
        if d["wanted"]:
            until = drafts[i + 1]["pre"] if i + 1 < len(drafts) else None if d["next"] is None else max(d["next"] - 60, 0)
            fit = sum(1 for h in range(1, d["wanted"]) if until is None or d["after"] + 60 * h < until)
            extra = min(math.floor(budget / (d["recovery"] * mass)), fit)
            budget -= d["recovery"] * mass * extra
            d["fed"] = extra + 1
    protein = max(min(max(base, 0.3 * (feeds + len(kept))), 2.0), base)
    each = protein * mass / (feeds + len(kept))
    out = []
    for i, d in enumerate(drafts):
        pre = d["g"] * mass
        out.append([d["pre"], "pre_session", i, None, pre * 0.75 if d["split"] else pre, each if d["meal"] else 0.0])
        if d["split"]:
            out.append([down(d["start"] - 60), "pre_session_top_up", i, None, pre - pre * 0.75, 0.0])
        n = (d["minutes"] - 1) // 30 if d["rate"] else 0
        out += [[max(down(d["start"] + 30 * k), up(d["start"] + 1)), "during_session", i, None, d["during"] / n, 0.0] for k in range(1, n + 1)]
        if not d["fed"] and d["dinner"] is None:
            out.append([d["after"], "recovery", i, 0, 0.0, each])
        for h in range(d["fed"]):
            if h == 0 and d["dinner"] is not None:
                out.append([d["after"], "post_ride_dinner", None, None, d["recovery"] * mass, 0.0])
            else:
                out.append([d["after"] + 60 * h, "recovery", i, h, d["recovery"] * mass, each if h == 0 else 0.0])
    weights = sum(0.5 if small(k) else 1 for k, _ in kept)
    out += [[t, k, None, None, floor(k) + budget * (0.5 if small(k) else 1) / weights, each] for k, t in kept]
    merged = {}
    for e in out:
        if tuple(e[:4]) in merged:
            merged[tuple(e[:4])][4] += e[4]
            merged[tuple(e[:4])][5] += e[5]
        else:
            merged[tuple(e[:4])] = e
    entries = sorted(merged.values(), key=lambda e: e[0])
    exact = [sum(e[c] for e in entries) for c in (4, 5)]
    return None, {"target": target, "fixed": fixed, "exceeds": fixed > target + 1e-9, "budget": budget, "kept": kept, "protein": protein, "entries": entries, "exact": exact, "hours": [d["fed"] for d in drafts], "pre": [d["g"] for d in drafts], "split": [d["split"] for d in drafts]}


def days_of(spark, cases):
    rows = [(k, d["mass"], d["wake_min"], d["meals"], d["tomorrow_start"], d["raised_to"]) for k, (d, _) in enumerate(cases)]
    days = spark.createDataFrame(rows, "plan_id int, mass double, wake_min int, meals array<struct<kind:string,time:int>>, tomorrow_start int, raised_to double")
    rides = [(k, i, *s, None) for k, (_, own) in enumerate(cases) for i, s in enumerate(own)]
    return days, spark.createDataFrame(rides, "plan_id int, seq int, start_min int, duration_min int, intensity double, planned_kj double")


def random_day(rng):
    at, sessions = rng.randrange(0, 600), []
    for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3])):
        at += rng.randrange(0, 400)
        minutes = rng.choice([0, 20, 45, 46, 60, 75, 90, 120, 150, 200, 300])
        sessions.append((at, minutes, rng.choice([0.4, 0.55, 0.65, 0.75, 0.85, 0.95])))
        at += minutes
    meals = rng.choice([MEALS, MEALS, MEALS, MEALS[1:], [("lunch", 780)], []])
    day = {"mass": rng.choice([52.0, 70.0, 72.5, 95.0]), "wake_min": rng.choice([300, 390, 481]), "meals": meals, "tomorrow_start": rng.choice([None, 0, 360, 600]), "raised_to": rng.choice([None, None, 3.4, 8.0, 11.04])}
    return day, sessions


def check(spark, cases):
    days, sessions = days_of(spark, cases)
    budgets = dayplan.day_budgets(days, sessions).cache()
    got, rows = {r.plan_id: r for r in budgets.collect()}, {}
    for r in dayplan.timeline(budgets).orderBy("plan_id", "idx").collect():
        rows.setdefault(r.plan_id, []).append(r)
    assert len(got) == len(cases)
    for k, (day, own) in enumerate(cases):
        error, want = plain(day, own)
        r = got[k]
        assert r.error == error
        if error:
            assert k not in rows and r.target is None and r.s is None
            continue
        assert [(m["kind"], m["time"]) for m in r.kept] == want["kept"], (day, own)
        for name in ("target", "fixed", "budget"):
            assert math.isclose(r[name], want[name], rel_tol=1e-9, abs_tol=1e-6), (name, day, own)
        assert r.exceeds == want["exceeds"] and math.isclose(r.protein_g_per_kg, want["protein"]) and list(r.hours) == want["hours"] and list(r.split) == want["split"]
        assert all(math.isclose(a, b) for a, b in zip(r.pre, want["pre"]))
        entries = rows[k]
        assert [(e.time_min, e.kind, e.session, e.hour) for e in entries] == [tuple(e[:4]) for e in want["entries"]], (day, own)
        for c, exact in (("carbs_g", want["exact"][0]), ("protein_g", want["exact"][1])):
            total, place = sum(e[c] for e in entries), 4 if c == "carbs_g" else 5
            assert abs(total - exact) <= 2.5 + 1e-6 and total % 5 == 0
            assert all(abs(e[c] - w[place]) < 5 for e, w in zip(entries, want["entries"]))


def test_random_days(spark):
    rng = random.Random(7)
    check(spark, [random_day(rng) for _ in range(400)])


def test_days_by_hand(spark):
    usual = {"mass": 70.0, "wake_min": 390, "meals": MEALS, "tomorrow_start": None, "raised_to": None}
    check(
        spark,
        [
            (usual, []), (usual, [(420, 240, 0.7)]), (usual, [(1050, 90, 0.8)]), (usual, [(600, 60, 0.7), (600 + 59, 60, 0.7)]), (usual, [(900, 60, 0.7), (600, 60, 0.7)]), (usual | {"mass": 0.0}, []), (usual | {"mass": float("nan")}, []), (usual | {"mass": None}, []),
            (usual | {"mass": math.inf}, [(600, 60, 0.7)]), (usual | {"tomorrow_start": 300}, [(1380, 120, 0.9)]), (usual, [(600, 60, 0.7), (660, 60, 0.7)]), (usual | {"meals": []}, [(400, 900, 0.6)]),
        ],
    )


def test_rest_day_and_defaults(spark):
    days = spark.createDataFrame([(1, 70.0)], "plan_id int, mass double")
    none = spark.createDataFrame([], "plan_id int, seq int, start_min int, duration_min int, intensity double, planned_kj double")
    plans, sessions, entries = dayplan.day_plan(days, none)
    p = plans.first()
    assert p.carbs_g_per_kg == 3.0 and p.carbs_planned_g == 210 and p.band == "light" and p.training_min == 0 and p.mean_intensity is None and sessions.count() == 0
    assert [(e.kind, e.time_min) for e in entries.orderBy("idx").collect()] == [("breakfast", 420), ("lunch", 750), ("dinner", 1110), ("evening_snack", 1290)]
    assert dayplan.timeline(dayplan.day_budgets(days.limit(0), none)).count() == 0


def test_sessions_of_unknown_days_and_across_midnight(spark):
    days = spark.createDataFrame([(1, 70.0, 360)], "plan_id int, mass double, tomorrow_start int")
    sessions = spark.createDataFrame([(1, 0, 1380, 120, 0.8, 900.0), (2, 0, 600, 60, 0.7, None)], "plan_id int, seq int, start_min int, duration_min int, intensity double, planned_kj double")
    d = dayplan.session_drafts(days, sessions).collect()
    assert len(d) == 1 and d[0].next_start == 1800 and d[0].end_min == 1500 and d[0].recovery_wanted == 4 and math.isclose(d[0].load, 900 / 70 * 0.8 / 0.75)
    assert dayplan.timeline(dayplan.day_budgets(days, sessions)).agg(F.max("time_min")).first()[0] > 1440


@pytest.mark.parametrize("grams, band", [(4.9, "light"), (5.0, "moderate"), (6.4, "moderate"), (6.5, "high"), (9.0, "very_high")])
def test_bands(spark, grams, band):
    from kilojoule.functions import metrics as fn

    assert spark.range(1).select(fn.band_for_carbs(F.lit(grams))).first()[0] == band


def test_a_week(spark):
    """Rest days between, what lies ahead, and the same plans as day by day."""
    athletes = spark.createDataFrame([(1, 70.0), (2, 60.0)], "athlete_id int, mass double")
    rows = [(1, 10, 0, 600, 60, 0.7, None, None), (1, 12, 1, 300, 300, 0.7, None, "A"), (1, 13, 2, 1320, 60, 0.9, None, "C"), (2, 10, 0, 420, 90, 0.6, 700.0, None), (3, 10, 0, 600, 60, 0.7, None, None), (2, 11, 1, 600, 60, 0.7, None, None), (2, 11, 2, 630, 60, 0.7, None, None)]
    sessions = spark.createDataFrame(rows, "athlete_id int, day long, seq int, start_min int, duration_min int, intensity double, planned_kj double, priority string")
    plans, each, entries = dayplan.fuel_week(athletes, sessions)
    got = {(r.plan_id.athlete_id, r.plan_id.day): r for r in plans.collect()}
    assert set(got) == {(1, d) for d in (10, 11, 12, 13)} | {(2, 10), (2, 11)} and got[2, 11].error == "overlap" and each.count() == 4
    assert (got[1, 11].reason, got[1, 11].days_before, got[1, 11].carbs_g_per_kg) == ("carb_load", 1, 12.0) and got[1, 10].days_before == 2 and got[1, 11].note == "Carb-loading: 5 h A event tomorrow"
    assert got[1, 13].reason is None and got[1, 11].training_min == 0 and got[1, 11].carbs_planned_g == 840
    day = {"mass": 70.0, "wake_min": 390, "meals": MEALS, "tomorrow_start": 1320, "raised_to": None}
    want = plain(day, [(300, 300, 0.7)])[1]
    rows = entries.where("plan_id.athlete_id = 1 and plan_id.day = 12").orderBy("idx").collect()
    assert got[1, 12].reason is None and [(e.time_min, e.kind) for e in rows] == [(e[0], e[1]) for e in want["entries"]]
