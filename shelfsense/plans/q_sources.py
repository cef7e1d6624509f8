"""Queries: sources, sinks, loads and upserts.

Queries that exercise a reader first write the given table with the
matching writer into a fresh folder under the shared checkpoint folder,
then read it back, so the whole table round-trips through the format.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from .. import binding as b
from ..sources import io
from .registry import register
from .sqlgen import md5_mod_sql


@register("scan_csv", sql="SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def q_scan_csv(spark, sf_dir):
    path = io.scratch_path(spark, "csv")
    (b.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
      .write.option("header", True).csv(path))
    df = io.read_csv_tolerant(spark, path)
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand",
                     F.col("p_retailprice").cast("double").alias("p_retailprice"))


@register("scan_folder", sql="""
SELECT p_partkey, p_name, p_brand AS brand, CAST(NULL AS VARCHAR) AS p_type, 'a' AS folder FROM part
UNION ALL
SELECT p_partkey, NULL, NULL, p_type, 'b' FROM part""")
def q_scan_folder(spark, sf_dir):
    base = io.scratch_path(spark, "folder")
    p = b.table(spark, sf_dir, "part")
    p.select(F.col("p_partkey").alias("P_PartKey"), F.col("p_name").alias("P Name"),
             F.col("p_brand").alias("Brand")).write.option("header", True).csv(f"{base}/a")
    p.select(F.col("p_partkey").alias("p partkey"), F.col("p_type").alias("P-Type")).write \
     .option("header", True).csv(f"{base}/b")
    df = io.read_folder(spark, io.list_csv_files(spark, base))
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "brand", "p_type",
                     F.regexp_extract("source_file", r"/([ab])/[^/]*$", 1).alias("folder"))


ORDER_MAP = {"sale_id": "o_orderkey", "product_id": "o_custkey", "revenue": "o_totalprice",
             "sale_date": "o_orderdate", "units_sold": "o_quantity"}


@register("scan_jdbc_mapped", sql="""
SELECT o_orderkey AS sale_id, o_custkey AS product_id, o_totalprice AS revenue, o_orderdate AS sale_date,
       1.0 AS units_sold, 7 AS dealer_id FROM orders""")
def q_scan_jdbc_mapped(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    return io.apply_column_map(o, ORDER_MAP, defaults={"units_sold": 1.0, "dealer_id": 7})


@register("sniff_dataset", sql="""
SELECT * FROM (VALUES ('sales_binding', 'sales'), ('products_binding', 'products'), ('reviews_binding', 'unknown'),
                      ('lineitem', 'unknown'), ('part', 'unknown')) t(dataset, kind)""")
def q_sniff_dataset(spark, sf_dir):
    frames = {"sales_binding": b.sales(spark, sf_dir), "products_binding": b.products(spark, sf_dir),
              "reviews_binding": b.reviews(spark, sf_dir), "lineitem": b.table(spark, sf_dir, "lineitem"),
              "part": b.table(spark, sf_dir, "part")}
    rows = [(k, io.detect_kind(v.columns)) for k, v in frames.items()]
    return spark.createDataFrame(rows, "dataset string, kind string")


def _sales_with_ids(spark, sf_dir):
    return b.sales(spark, sf_dir).withColumn("sale_id", F.col("order_id") * 10 + F.col("line_no"))


@register("append_sales", sql=b.with_ctes(b.SALES_SQL) + """
, s AS (SELECT *, order_id * 10 + line_no AS sale_id FROM sales)
SELECT sale_id, product_id, units_sold, year, month FROM s
WHERE units_sold IS NOT NULL AND product_id IS NOT NULL
  AND sale_id NOT IN (SELECT sale_id FROM s WHERE sale_date < DATE '1999-01-01')""")
def q_append_sales(spark, sf_dir):
    s = _sales_with_ids(spark, sf_dir)
    target = s.where(F.col("sale_date") < F.lit(_dt.date(1999, 1, 1)))
    out = io.append_sales(target, s, b.AS_OF.year, b.AS_OF.month)
    return out.select("sale_id", "product_id", "units_sold", "year", "month")


@register("upsert_products", sql=b.with_ctes(b.PRODUCTS_SQL) + """
, u AS (SELECT product_id, CAST(NULL AS VARCHAR) AS product_name, price * 1.1 AS price FROM products
        WHERE category = 'PROMO'
        UNION ALL SELECT product_id + 100000, product_name, price FROM products WHERE category = 'SMALL')
SELECT coalesce(t.product_id, u.product_id) AS product_id, coalesce(u.product_name, t.product_name) AS product_name,
       round(coalesce(u.price, t.price), 6) AS price
FROM (SELECT product_id, product_name, price FROM products) t FULL JOIN u USING (product_id)""")
def q_upsert_products(spark, sf_dir):
    p = b.products(spark, sf_dir).select("product_id", "product_name", "price", "category")
    target = p.drop("category")
    upd = (p.where(F.col("category") == "PROMO")
            .select("product_id", F.lit(None).cast("string").alias("product_name"), (F.col("price") * 1.1).alias("price"))
            .unionByName(p.where(F.col("category") == "SMALL")
                          .select((F.col("product_id") + 100000).alias("product_id"), "product_name", "price")))
    out = io.upsert(target, upd, ["product_id"])
    return out.select("product_id", "product_name", F.round("price", 6).alias("price"))


@register("insert_new_products", sql=f"""
WITH c AS (SELECT CASE WHEN p_size > 48 THEN NULL ELSE CAST(p_partkey + 1000000 AS VARCHAR) END AS product_id,
                  p_name AS product_name, CASE WHEN p_size = 47 THEN NULL ELSE p_brand END AS brand,
                  CAST(NULL AS DOUBLE) AS price
           FROM part WHERE p_size > 45),
g AS (SELECT coalesce(product_id, 'PRD_' || CAST({md5_mod_sql("regexp_replace(lower(regexp_replace(product_name, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')", 100000)} AS VARCHAR)) AS product_id,
             product_name, coalesce(brand, 'Unknown') AS brand, coalesce(price, 25.0) AS price FROM c)
SELECT * FROM g WHERE product_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)""")
def q_insert_new_products(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    cand = p.where(F.col("p_size") > 45).select(
        F.when(F.col("p_size") > 48, F.lit(None)).otherwise((F.col("p_partkey") + 1000000).cast("string"))
         .alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.when(F.col("p_size") == 47, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
        F.lit(None).cast("double").alias("price"))
    existing = p.select(F.col("p_partkey").alias("product_id"))
    new, _preview = io.insert_new(existing, cand, defaults={"brand": "Unknown", "price": 25.0})
    return new.select("product_id", "product_name", "brand", "price")


@register("seed_missing_inventory", sql=f"""
SELECT p_partkey AS product_id, CAST({md5_mod_sql('CAST(p_partkey AS VARCHAR)', 451)} + 50 AS DOUBLE) AS current_stock,
       50.0 AS reorder_level, 14.0 AS lead_time_days
FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 30)""")
def q_seed_missing_inventory(spark, sf_dir):
    p = b.products(spark, sf_dir)
    inv = p.where(F.col("size") <= 30).select("product_id")
    return io.seed_missing_inventory(p, inv)


@register("load_chemicals", sql="""
WITH r AS (SELECT conv_id, turn, lower(string_split(trim(text), ' ')[1]) AS chemical_name FROM conversations),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(chemical_name)) ORDER BY conv_id, turn) AS rn
                     FROM r) WHERE rn = 1),
s AS (SELECT *, CASE WHEN contains(lower(chemical_name), 'mercury') THEN 10 WHEN contains(lower(chemical_name), 'lead') THEN 10
                     WHEN contains(lower(chemical_name), 'formaldehyde') THEN 9 WHEN contains(lower(chemical_name), 'phthalate') THEN 8
                     WHEN contains(lower(chemical_name), 'coal tar') THEN 8 WHEN contains(lower(chemical_name), 'paraben') THEN 7
                     ELSE 5 END AS severity_score FROM f)
SELECT chemical_name, conv_id, turn, severity_score,
       CASE WHEN severity_score >= 8 THEN 'high' WHEN severity_score >= 5 THEN 'medium' ELSE 'low' END AS risk_level
FROM s""")
def q_load_chemicals(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations")
    raw = c.select("conv_id", "turn", F.lower(F.split(F.trim("text"), " ").getItem(0)).alias("chemical_name"))
    out = io.load_chemicals(raw, order=[F.col("conv_id"), F.col("turn")])
    return out.select("chemical_name", "conv_id", "turn", "severity_score", "risk_level")


@register("sink_tables", sql="""
SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category,
       p_retailprice AS price, round(p_retailprice * 0.4, 2) AS cost_price FROM part""")
def q_sink_tables(spark, sf_dir):
    base = io.scratch_path(spark, "sink")
    p = b.products(spark, sf_dir).withColumnRenamed("size", "_source")
    empty = p.where(F.lit(False))
    written = io.sink_tables({"products": p, "empty_table": empty}, base)
    assert written == ["products"]
    return spark.read.parquet(f"{base}/products")


@register("report_kv_export", sql=b.with_ctes(b.TENANT_PRODUCTS_SQL) + """
, k AS (SELECT dealer_id, count(*) AS n_products, count(DISTINCT category) AS n_categories FROM tenant_products
        GROUP BY dealer_id)
SELECT dealer_id, 'n_products' AS field, CAST(n_products AS VARCHAR) AS value FROM k
UNION ALL SELECT dealer_id, 'n_categories', CAST(n_categories AS VARCHAR) FROM k""")
def q_report_kv_export(spark, sf_dir):
    tp = b.tenant_products(spark, sf_dir)
    k = tp.groupBy("dealer_id").agg(F.count(F.lit(1)).alias("n_products"),
                                    F.count_distinct("category").alias("n_categories"))
    return io.report_kv(k, ["dealer_id"])


@register("json_products", sql=b.with_ctes(b.PRODUCTS_SQL) + """
SELECT product_id, product_name, brand, price, cost_price, category || ',' || brand AS tags FROM products""")
def q_json_products(spark, sf_dir):
    path = io.scratch_path(spark, "json")
    p = b.products(spark, sf_dir)
    doc = p.select("product_id", "product_name", "brand", F.struct("price", "cost_price").alias("pricing"),
                   F.array("category", "brand").alias("tags"))
    io.write_product_docs(doc, path)
    back = io.read_product_docs(spark, path)
    return back.select("product_id", "product_name", "brand", "pricing.price", "pricing.cost_price",
                       F.array_join("tags", ",").alias("tags"))


@register("tenant_reset", sql=b.with_ctes(b.SALES_SQL) + """
SELECT order_id, line_no, dealer_id FROM sales WHERE dealer_id IS NULL OR dealer_id <> 1""")
def q_tenant_reset(spark, sf_dir):
    s = b.sales(spark, sf_dir)
    return io.tenant_reset(s, 1).select("order_id", "line_no", "dealer_id")

