"""Streams over several runs: late rows, expiring state, retried batches, order of arrival."""
import datetime as dt
import os

import pytest

from shelfsense.streaming import jobs

SALES = "sale_id long, product_id long, units double, sale_ts timestamp"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def forget_last_commit(checkpoint):
    """What a driver that dies before it notes the last batch leaves behind."""
    names = sorted((n for n in os.listdir(f"{checkpoint}/commits") if n.isdigit()), key=int)
    for n in (names[-1], f".{names[-1]}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{n}"):
            os.rename(f"{checkpoint}/commits/{n}", f"{checkpoint}/gone-{n.strip('.')}")


def test_weekly_demand(spark, tmp_path):
    landing, sink, ckpt = (f"{tmp_path}/{x}" for x in ("landing", "sink", "ckpt"))
    run = lambda: jobs.stream_weekly_demand(jobs.file_stream(spark, landing, spark.createDataFrame([], SALES).schema), sink, ckpt)
    rows = lambda: sorted((r.product_id, str(r.week_end), r.units) for r in spark.read.parquet(sink).collect())
    land(spark, landing, [(1, 7, 2.0, at(0)), (2, 7, 3.0, at(6)), (3, 8, 1.0, at(1)), (4, 7, 5.0, at(8)), (5, 7, 1.0, at(24))], SALES)
    first = run()
    assert rows() == [(7, "2024-01-07", 5.0), (8, "2024-01-07", 1.0)]      # the watermark is at day 10: later weeks stay open
    land(spark, landing, [(6, 7, 50.0, at(3)), (7, 7, 4.0, at(9)), (8, None, 0.0, at(70))], SALES)     # 6 is late, 7 isn't yet
    second = run()
    assert rows() == [(7, "2024-01-07", 5.0), (7, "2024-01-14", 9.0), (7, "2024-01-28", 1.0), (8, "2024-01-07", 1.0)]
    state = [p["stateOperators"][0] for p in (*first, *second) if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert state[-1]["numRowsTotal"] == 1 < max(s["numRowsTotal"] for s in state)      # only the closing row's own week
    before = rows()
    forget_last_commit(ckpt)
    assert run() and rows() == before


@pytest.fixture
def series(spark):
    return spark.createDataFrame([(1, 1, [30.0] * 12), (1, 2, [300.0] * 12)], "dealer_id int, product_id int, monthly_sales array<double>")


CHANGES = "dealer_id int, product_id int, current_stock double, changed_at timestamp"


def test_stock_refresh_keeps_the_latest_change(spark, tmp_path, series):
    a = [(1, 1, 10.0, at(1)), (1, 1, 500.0, at(5)), (1, 2, 5.0, at(2)), (1, 3, 5.0, at(2))]
    results = []
    for name, batches in (("x", [a]), ("y", [[a[1], a[1]], [a[0], a[2]], [a[1], a[3]]]), ("z", [[x] for x in reversed(a)])):
        landing, table, ckpt = (f"{tmp_path}/{name}/{x}" for x in ("landing", "table", "ckpt"))
        for rows in batches:
            land(spark, landing, rows, CHANGES)
            jobs.stream_stock_refresh(jobs.file_stream(spark, landing, spark.createDataFrame([], CHANGES).schema), series, table, ckpt)
        read = lambda: sorted(map(tuple, spark.read.parquet(jobs.current_version(spark, table)).collect()))
        results.append(read())
        n = len(jobs.versions(spark, table))
        forget_last_commit(ckpt)
        jobs.stream_stock_refresh(jobs.file_stream(spark, landing, spark.createDataFrame([], CHANGES).schema), series, table, ckpt)
        assert read() == results[-1] and len(jobs.versions(spark, table)) == n     # the retried batch had committed
    assert results[0] == results[1] == results[2]
    assert [(r[1], r[3]) for r in results[0]] == [(1, 500.0), (2, 5.0)]


UPDATES = "product_id int, product_name string, price double, updated_at int"


def test_upserts_by_order_and_from_a_new_checkpoint(spark, tmp_path):
    landing, table = f"{tmp_path}/landing", f"{tmp_path}/table"
    spark.createDataFrame([(1, "one", 1.0), (2, "two", 2.0)], "product_id int, product_name string, price double").write.parquet(f"{table}/v000000")
    src = lambda: jobs.file_stream(spark, landing, spark.createDataFrame([], UPDATES).schema)
    read = lambda: sorted((r.product_id, r.product_name, r.price) for r in spark.read.parquet(jobs.current_version(spark, table)).collect())
    land(spark, landing, [(1, None, 12.0, 2), (1, "older", 11.0, 1), (3, "three", 3.0, 5)], UPDATES)
    jobs.stream_upsert_products(src(), table, ["product_id"], f"{tmp_path}/a")
    assert read() == [(1, "one", 12.0), (2, "two", 2.0), (3, "three", 3.0)]
    land(spark, landing, [(3, "late", 9.0, 4), (2, "new", 22.0, 1)], UPDATES)
    jobs.stream_upsert_products(src(), table, ["product_id"], f"{tmp_path}/a")
    want = [(1, "one", 12.0), (2, "new", 22.0), (3, "three", 3.0)]
    assert read() == want
    forget_last_commit(f"{tmp_path}/a")
    jobs.stream_upsert_products(src(), table, ["product_id"], f"{tmp_path}/a")
    assert read() == want and len(jobs.versions(spark, table)) == 3
    land(spark, landing, [(2, "newer", None, 7)], UPDATES)
    jobs.stream_upsert_products(src(), table, ["product_id"], f"{tmp_path}/b")      # a new stream on the old table
    assert read() == [(1, "one", 12.0), (2, "newer", 22.0), (3, "three", 3.0)]
    assert [n for n, _ in jobs.versions(spark, table)] == [0, 1, 2, 3]


def test_newest_row_does_not_depend_on_where_it_lies(spark):
    rows = [(1, "a", 1.0, 3), (1, "b", 2.0, 3), (1, "c", 9.0, 1)]
    picked = {tuple(jobs.newest_rows(spark.createDataFrame(r, UPDATES).repartition(n), ["product_id"], "updated_at").first())
              for r in (rows, rows[::-1]) for n in (1, 3)}
    assert len(picked) == 1 and picked.pop()[3] == 3
