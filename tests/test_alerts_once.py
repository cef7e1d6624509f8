"""Alert rules read the analysis once, with the limits, orders and nulls of each rule."""
from shelfsense.operators import alerts as al

COLS = ("dealer_id long, product_id long, product_name string, stockout_risk string, risk_level string, stock_status string, "
        "forecast_trend string, priority_score double, days_until_stockout double")


def frame(spark):
    rows = [(1, i, f"p{i}", "HIGH" if i < 12 else None, "high", "overstock" if i % 2 else "normal", "increasing", None if i == 3 else float(i % 7), 2.0 + i / 10) for i in range(20)]
    return spark.createDataFrame([*rows, (None, 1, None, "MEDIUM", "medium", None, None, None, None)], COLS)


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_notifications_in_one_pass(spark):
    n = al.notifications(frame(spark))
    assert reads(n) == 1
    got = [tuple(r) for r in n.select("dealer_id", "notif_type", "severity", "product_id").collect()]
    of = lambda kind, sev: sorted(p for d, k, s, p in got if (k, s) == (kind, sev))
    assert of("understock", "critical") == list(range(12)) and of("harmful", "critical") == list(range(10))
    assert of("overstock", "low") == [1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
    assert of("surge", "medium") == [5, 6, 12, 13, 19]
    assert sorted(x[1:] for x in got if x[0] is None) == [("harmful", "medium", 1), ("understock", "high", 1)]


def test_feed_in_one_pass(spark):
    f = al.alert_feed(frame(spark))
    assert reads(f) == 1
    got = sorted(tuple(r) for r in f.where("dealer_id = 1").select("feed_rank", "priority", "class_rank", "product_id").collect())
    assert got == [(1, 1, 1, 0), (2, 1, 2, 1), (3, 1, 3, 2), (4, 1, 4, 3), (5, 1, 5, 4), (6, 2, 1, 0), (7, 2, 2, 1), (8, 2, 3, 2), (9, 2, 4, 3), (10, 2, 5, 4)]
