import pytest

from pyspark.sql import functions as F

from shelfsense import binding as b
from shelfsense.sources import io

SMOKE = "/root/testdata/sf0.001"


def test_upsert_is_idempotent(spark):
    p = b.products(spark, SMOKE).select("product_id", "product_name", "price")
    upd = p.where(F.col("product_id") % 2 == 0).select("product_id", F.lit(None).cast("string").alias("product_name"),
                                                      (F.col("price") + 1).alias("price"))
    once = io.upsert(p, upd, ["product_id"])
    twice = io.upsert(once, upd, ["product_id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    # NULL in an update keeps the old value
    names = {r.product_id: r.product_name for r in once.collect()}
    assert all(names[r.product_id] == r.product_name for r in p.collect())


def test_append_sales_is_idempotent(spark):
    s = b.sales(spark, SMOKE).withColumn("sale_id", F.col("order_id") * 10 + F.col("line_no"))
    first = io.append_sales(s.where("false"), s, 2001, 11)
    loaded = first
    again = io.append_sales(loaded, s, 2001, 11)
    assert first.count() == s.count() and again.count() == 0


def test_append_sales_keeps_equal_genuine_sales_without_ids(spark):
    rows = [(1, 5.0, "2001-01-01"), (1, 5.0, "2001-01-01"), (2, 3.0, "2001-02-01")]
    batch = (spark.createDataFrame(rows, "product_id int, units_sold double, d string")
                  .select("product_id", "units_sold", F.to_date("d").alias("sale_date")))
    target = batch.limit(0)
    out = io.append_sales(target, batch, 2001, 11, id_col=None, value_cols=["product_id", "units_sold", "sale_date"])
    assert out.count() == 3
    half = io.append_sales(batch.where("product_id = 1").limit(1), batch, 2001, 11, id_col=None,
                           value_cols=["product_id", "units_sold", "sale_date"])
    assert half.count() == 2


def test_detect_kind():
    assert io.detect_kind(["Product ID", "Units Sold"]) == "sales"
    assert io.detect_kind(["product_id", "product_name", "price"]) == "products"
    assert io.detect_kind(["a", "b"]) == "unknown"


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    got = E.queries()["stream_weekly_demand"](spark, SMOKE)
    e = b.table(spark, SMOKE, "events").where(F.col("event_type") == "purchase")
    from shelfsense.operators import timeseries as ts
    want = ts.weekly_demand(e.select(F.col("user_id").alias("product_id"), F.col("value").alias("units_sold"),
                                     F.col("ts").alias("sale_date")))
    norm = lambda df: sorted((r.product_id, str(r.week_end), round(r.units, 6)) for r in df.collect())
    assert norm(got) == norm(want)


def test_stream_upsert_version_survives_a_broken_write(spark, tmp_path):
    """A version without its commit mark doesn't count, and a retried epoch reads the one before its own."""
    from shelfsense.streaming import jobs
    for k in (0, 1, 2):
        spark.range(k + 1).write.parquet(f"{tmp_path}/v{k:06d}")
    (tmp_path / "v000003").mkdir()
    assert jobs.current_version(spark, str(tmp_path)).endswith("v000002")
    assert jobs.current_version(spark, str(tmp_path), below=2).endswith("v000001")
    with pytest.raises(FileNotFoundError):
        jobs.current_version(spark, str(tmp_path), below=0)
