"""Sums of doubles go in the order of their rows' keys, as SQL adds them on one thread, however the rows are dealt out."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kilojoule.operators import dayplan
from kilojoule.plans import queries as plans


def stored(path, name, *parts):
    """A table whose parts are files of their own, which Spark reads as partitions of their own."""
    (path / f"{name}.parquet").mkdir()
    for i, columns in enumerate(parts):
        pq.write_table(pa.table(columns), path / f"{name}.parquet" / f"{i}.parquet")


def by_sql(path, name):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    for t in path.glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}/*.parquet'")
    return sorted(con.sql(plans.ORACLE_SQL[name]).fetchall())


def orders(keys, prices):
    day = datetime.datetime(1998, 2, 6)
    return {"o_orderkey": keys, "o_custkey": [0] * len(keys), "o_totalprice": prices, "o_orderdate": [day] * len(keys)}


def test_daily_load(spark, tmp_path):
    # 93,999.5 thousandths exactly; the parts' sums added up make it one more than in order
    stored(tmp_path, "orders", orders([0, 1], [369722.88, 187454.68]), orders([2, 3], [92889.57, 289927.87]))
    stored(tmp_path, "customer", {"c_custkey": [0], "c_nationkey": [5]})
    got = plans.daily_load(spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == by_sql(tmp_path, "daily_load") == [(5, 10263, 93999)]


def test_planned_days(spark, tmp_path):
    # a mean of 0.7905 exactly, in order just below
    stored(tmp_path, "orders", orders([2363, 8861], [1.0, 1.0]), orders([44627, 45729], [1.0, 1.0]))
    got = plans.planned_days(spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == by_sql(tmp_path, "planned_days") and [r.mean_intensity for r in got] == [790]


def test_timeline(spark):
    # meals several times over, whose protein makes half a step, so that it shows in which order a plan's sums go
    times = {"breakfast": 420, "lunch": 750, "dinner": 1110, "evening_snack": 1290}
    plan = lambda i, mass, *counts: (i, mass, [(kind, time) for (kind, time), n in zip(times.items(), counts) for _ in range(n)])
    days = spark.createDataFrame([plan(1, 58.75, 1, 2, 2, 2), plan(2, 109.72222222222223, 1, 1, 3, 1), plan(3, 101.25, 1, 2, 3, 1)], "plan_id long, mass double, meals array<struct<kind:string,time:int>>")
    none = spark.createDataFrame([], "plan_id long, seq int, start_min int, duration_min int, intensity double, planned_kj double")
    budgets = dayplan.day_budgets(days, none)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.execute("CREATE TABLE y (plan_id BIGINT, e STRUCT(t INTEGER, k VARCHAR, i INTEGER, h INTEGER, c DOUBLE, p DOUBLE), n INTEGER)")
    for r in budgets.select("plan_id", F.posexplode(dayplan._timeline()).alias("n", "e")).orderBy("plan_id", "n").collect():
        con.execute("INSERT INTO y VALUES (?, ?, ?)", [r.plan_id, dict(zip("tkihcp", r.e)), r.n])
    sql = plans.ORACLE_SQL["day_timeline"]
    want = con.sql("WITH " + sql[sql.index("g1 AS (") :]).fetchall()
    got = sorted(map(tuple, dayplan.timeline(budgets).collect()))
    assert got == sorted(want) and [r[7] for r in got] == [15, 35, 35, 30, 35, 35, 100, 30, 30, 55, 85, 30]
