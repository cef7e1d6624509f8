"""Series stay whole and are worked out once: no lambda over a lambda, no derived size filter, no shuffle of filled weeks."""
import datetime as dt
import math

from pyspark.sql import functions as F

from shelfsense.operators import timeseries as ts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_series_is_exploded_without_a_derived_filter(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None), (None, [4.0])], "k long, h array<double>")
    f = ts.forecast_baseline(df.join(spark.range(4).withColumnRenamed("id", "k"), "k", "left"), "h", steps=3)
    e = ts.explode_series(f, ["k"], "forecast", "step", "units")
    assert "Filter (size" not in plan(e) and "> 0)" not in "".join(x for x in plan(e).split("\n") if "Filter" in x)
    assert sorted(map(tuple, e.where("k = 1").collect())) == [(1, 0, 1.5), (1, 1, 1.5), (1, 2, 1.6)]
    raw = ts.explode_series(df, ["k"], "h")
    assert sorted(map(tuple, raw.collect()), key=str) == [(1, 0, 1.0), (1, 1, 2.0), (None, 0, 4.0)]


def test_deviation_takes_the_mean_once(spark):
    df = spark.createDataFrame([([3.0, 4.0, 8.0],), ([],), (None,), ([2.5],)], "h array<double>")
    got = [r[0] for r in df.select(F.round(ts.array_std_pop(F.col("h")), 9)).where("size(h) > 0").collect()]
    assert got == [round(math.sqrt(14 / 3), 9), 0.0]
    assert plan(df.select(ts.array_std_pop(F.col("h")).alias("x"))).count("aggregate(") == 2


def test_weeks_are_filled_in_place(spark):
    d = dt.date(2001, 1, 7)
    week = lambda n, off=0: d + dt.timedelta(days=7 * n + off)
    rows = [(1, week(0), 5.0), (1, week(3), 2.0), (2, week(1), None), (1, week(1, 2), 9.0), (3, week(4), 1.0), (3, None, 7.0), (None, week(0), 4.0), (None, week(1), 4.0),
            (4, week(0), 1.0), (4, week(1, 3), 6.0)]
    got = ts.weekly_dense(spark.createDataFrame(rows, "product_id long, week_end date, units double"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, week(0), 5.0), (1, week(1), 0.0), (1, week(2), 0.0), (1, week(3), 2.0), (2, week(1), 0.0), (3, week(4), 1.0), (None, week(0), 0.0), (None, week(1), 0.0),
         (4, week(0), 1.0), (4, week(1), 0.0)], key=str)
    assert "Join" not in plan(got)


def test_months_without_a_map(spark):
    m = spark.createDataFrame([(1, 1, 2001, 11, 6.0), (1, 1, 2001, 9, 2.0), (1, 2, 1999, 1, 3.0)], "dealer_id long, product_id long, year int, month int, units double")
    u = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "dealer_id long, product_id long")
    got = {r["product_id"]: r["monthly_sales"] for r in ts.last_n_months(m, u, dt.date(2001, 11, 4)).collect()}
    assert got == {1: [4.0] * 9 + [2.0, 4.0, 6.0], 2: [3.0] * 12, 3: [0.0] * 12}
    assert "collect_list" not in plan(ts.last_n_months(m, u, dt.date(2001, 11, 4)))
