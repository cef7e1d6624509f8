"""The stock refresh reads its series and its inventory from stored copies, made once and of the touched products only."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfsense.plans import q_stock, q_streaming
from shelfsense.streaming import jobs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Sales with nulls and repeats, and a part that comes twice."""
    top = str(tmp_path_factory.mktemp("tables"))
    day = lambda m: dt.date(2001, m, 3)
    sales = [(1, k % 4, p, s, float(5 * p + m), 10.0, 0.1, day(m)) for k, (p, s, m) in enumerate((p, s, m) for p in range(1, 7) for s in (1, 2) for m in (3, 9, 10))]
    sales += [sales[0], (2, 1, None, 1, 4.0, 1.0, 0.0, day(9)), (2, 2, 2, None, 4.0, 1.0, 0.0, day(9)), (2, 3, 2, 1, None, 1.0, 0.0, day(9)), (2, 4, 2, 1, 9.0, 1.0, 0.0, None)]
    spark.createDataFrame(sales, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date").write.parquet(f"{top}/lineitem.parquet")
    parts = [(p, f"part {p}", "B", "PROMO" if p % 2 else "SMALL", 10.0, p) for p in range(1, 7)] + [(3, "part 3", "B", "PROMO", 10.0, 3), (3, "part 3", "B", "SMALL", 10.0, 4), (None, "no key", "B", "PROMO", 1.0, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double, p_size int").write.parquet(f"{top}/part.parquet")
    return top


def test_series_of_some_products(spark, tables):
    of = spark.createDataFrame([(1, 1), (2, 3), (2, 3), (None, 2), (9, 9)], "dealer_id long, product_id long")
    rows = lambda df: sorted(map(str, df.collect()))
    every = q_stock.series_frame(spark, tables)
    want = rows(every.where("dealer_id = 1 and product_id = 1 or dealer_id = 2 and product_id = 3"))
    assert rows(q_stock.series_frame(spark, tables, of=of)) == want and 4 == len(want) < every.count()


def test_refresh_reads_stored_copies(spark, tables, monkeypatch):
    seen, landed = [], []
    refresh, land = jobs.stream_stock_refresh, q_streaming._land
    monkeypatch.setattr(jobs, "stream_stock_refresh", lambda changes, series, *a: seen.append(series) or refresh(changes, series, *a))
    monkeypatch.setattr(q_streaming, "_land", lambda df, *a, **k: landed.append(df) or land(df, *a, **k))
    got = {(r.dealer_id, r.product_id): (r.current_stock, r.stock_status) for r in q_streaming.q_stream_stock_refresh(spark, tables).collect()}
    assert all("/stored-" in f for df in [*seen, *landed] for f in df.inputFiles()) and len(seen) == len(landed) == 2
    assert {r.product_id for r in seen[0].select("product_id").distinct().collect()} == {1, 3, 5}
    status = {(r.dealer_id, r.product_id): r.stock_status for r in q_stock.rules.stock_status(
        q_stock.series_frame(spark, tables).withColumn("current_stock", F.col("product_id") * 10.0 + 100)).collect()}
    want = {(s, p): (10.0 * p + 100, status[s, p]) for s in (1, 2) for p in (1, 5)}
    assert {k: v for k, v in got.items() if k[1] != 3} == want and {(1, 3), (2, 3)} < set(got)
