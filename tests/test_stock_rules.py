import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfsense.operators import rules, timeseries as ts


def test_stock_status_boundaries(spark):
    # mean monthly sales 30 -> 1 unit/day, so days of cover == stock (FIXTURES G01)
    cases = [(6.9, "understock", "HIGH"), (7.0, "understock", "MEDIUM"), (29.9, "understock", "MEDIUM"),
             (30.0, "normal", "LOW"), (90.0, "normal", "LOW"), (90.1, "watch", "LOW"),
             (180.0, "watch", "LOW"), (180.1, "overstock", "LOW")]
    df = spark.createDataFrame([(i, s, [30.0] * 12) for i, (s, _, _) in enumerate(cases)],
                               "id int, current_stock double, monthly_sales array<double>")
    out = {r.id: (r.stock_status, r.stockout_risk) for r in rules.stock_status(df).collect()}
    for i, (_, st, rk) in enumerate(cases):
        assert out[i] == (st, rk), cases[i]


def test_last_n_months_fill_rules(spark):
    monthly = spark.createDataFrame([
        (1, 2001, 11, 30.0), (1, 2001, 9, 10.0),      # in window: gaps filled with mean 20
        (2, 1999, 1, 8.0), (2, 1998, 5, 4.0),          # only history: mean 6 repeated
    ], "product_id int, year int, month int, units double")
    uni = spark.createDataFrame([(1,), (2,), (3,)], "product_id int")
    out = {r.product_id: r.monthly_sales for r in
           ts.last_n_months(monthly, uni, dt.date(2001, 11, 4), keys=["product_id"]).collect()}
    assert out[1][-1] == 30.0 and out[1][-3] == 10.0 and out[1][0] == 20.0
    assert out[2] == [6.0] * 12
    assert out[3] == [0.0] * 12


@pytest.mark.parametrize("risk,days,status,trend,avg,expected", [
    ("high", 50.0, "normal", "stable", 10.0, ("REMOVE FROM SALE", 100.0)),
    ("none", 2.0, "understock", "stable", 0.0, ("INVESTIGATE", 40.0)),
    ("none", 2.0, "understock", "stable", 10.0, ("AGGRESSIVE RESTOCK", 95.0)),
    ("none", 5.0, "understock", "stable", 10.0, ("RESTOCK URGENTLY", 85.0)),
    ("medium", 40.0, "normal", "stable", 10.0, ("CAUTION — DO NOT RESTOCK", 65.0)),
    ("none", 200.0, "overstock", "decreasing", 10.0, ("REDUCE PRICE — CLEAR STOCK", 60.0)),
    ("none", 60.0, "normal", "increasing", 10.0, ("INCREASE STOCK", 50.0)),
    ("none", 60.0, "normal", "stable", 10.0, ("MAINTAIN STOCK", 25.0)),
])
def test_stock_decision_rules(spark, risk, days, status, trend, avg, expected):
    df = spark.createDataFrame([(risk, days, status, trend, avg)],
                               "risk_level string, days_until_stockout double, stock_status string, "
                               "forecast_trend string, avg_monthly_raw double")
    r = rules.stock_decision(df).first()
    assert (r.stock_decision, r.priority_score) == expected
    assert r.decision_reason


def test_verification_status(spark):
    df = spark.createDataFrame([("a" * 20, 90.0, "dry", 5, 4.0, 10.0, "none"),
                                ("", 40.0, "dry", 0, 0.0, 0.0, "high")],
                               "ingredients string, safety_score double, skin_type string, review_count int, "
                               "avg_rating double, total_sales double, risk_level string")
    out = [r.verification_status for r in rules.verification_status(df).collect()]
    assert out == ["fully_verified", "flagged"]
