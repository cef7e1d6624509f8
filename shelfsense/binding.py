"""Binding of the library's retail entities to the driver's test tables.

Every operator takes column names as arguments; this module is the only
place that knows the test tables.  Each entity has a Spark builder and an
equivalent DuckDB SQL common-table expression used by the oracles, so both
sides of a correctness check start from the same rows.

product    part: p_partkey, p_name, p_brand, p_type, p_retailprice; cost 0.4*price
tenant     lineitem.l_suppkey
sale       lineitem (+ orders/customer/nation/region for geography)
inventory  derived from part: stock = p_size*10, lead = 7 + p_partkey % 15
review     documents left join labels; product_id = doc_id % count(part)
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed reference date that replaces every "now" of the reference.
AS_OF = _dt.date(2001, 11, 4)
AS_OF_SQL = "DATE '2001-11-04'"

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- products
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: one row per product (part)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.round(F.col("p_retailprice") * 0.4, 2).alias("cost_price"),
        F.col("p_size").alias("size"),
    )


PRODUCTS_SQL = """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand,
         p_type AS category, p_retailprice AS price,
         round(p_retailprice * 0.4, 2) AS cost_price, p_size AS size
  FROM part)"""


def tenant_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products per tenant: every (supplier, part) pair that has a sale."""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select(F.col("l_suppkey").alias("dealer_id"),
                      F.col("l_partkey").alias("product_id")).distinct()
    return pairs.join(products(spark, sf_dir), "product_id")


TENANT_PRODUCTS_SQL = PRODUCTS_SQL + """,
tenant_products AS (
  SELECT t.dealer_id, p.* FROM
    (SELECT DISTINCT l_suppkey AS dealer_id, l_partkey AS product_id FROM lineitem) t
  JOIN products p USING (product_id))"""


# ---------------------------------------------------------------- sales
def sales(spark: SparkSession, sf_dir: str, with_geo: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("dealer_id"),
        F.col("l_quantity").alias("units_sold"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.col("l_shipdate").alias("sale_date"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
    )
    if not with_geo:
        return s
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    # nation/region are fixed 25/5-row dimensions: broadcast is size-bounded.
    geo = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
             .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
             .select("c_custkey", F.col("n_name").alias("city"), F.col("r_name").alias("region")))
    return (s.join(o, s.order_id == o.o_orderkey)
             .join(geo, F.col("o_custkey") == geo.c_custkey)
             .drop("o_orderkey", "o_custkey", "c_custkey"))


SALES_SQL = """sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
         l_suppkey AS dealer_id, l_quantity AS units_sold,
         l_extendedprice * (1 - l_discount) AS revenue, l_shipdate AS sale_date,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month
  FROM lineitem)"""

SALES_GEO_SQL = """sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
         l_suppkey AS dealer_id, l_quantity AS units_sold,
         l_extendedprice * (1 - l_discount) AS revenue, l_shipdate AS sale_date,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         n_name AS city, r_name AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""


# ---------------------------------------------------------------- inventory
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = tenant_products(spark, sf_dir)
    return tp.select(
        "dealer_id", "product_id",
        (F.col("size") * 10).cast("double").alias("current_stock"),
        F.lit(50.0).alias("reorder_level"),
        (F.pmod(F.col("product_id"), F.lit(15)) + 7).cast("double").alias("lead_time_days"),
    )


INVENTORY_SQL = TENANT_PRODUCTS_SQL + """,
inventory AS (
  SELECT dealer_id, product_id, CAST(size * 10 AS DOUBLE) AS current_stock,
         50.0 AS reorder_level, CAST(product_id % 15 + 7 AS DOUBLE) AS lead_time_days
  FROM tenant_products)"""


# ---------------------------------------------------------------- reviews
def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lb = table(spark, sf_dir, "labels")
    n_parts = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("_np"))
    rating = F.least(F.greatest(1 + 4 * F.col("quality") - 2 * F.col("toxic"), F.lit(1)), F.lit(5))
    # one-row scalar joined by broadcast: size is bounded to a single row
    return (d.join(lb, "doc_id", "left")
             .crossJoin(F.broadcast(n_parts))
             .select(
                 F.col("doc_id").alias("review_id"),
                 F.pmod(F.col("doc_id"), F.col("_np")).alias("product_id"),
                 F.col("source"),
                 F.col("lang"),
                 rating.cast("double").alias("rating"),
                 F.col("text").alias("review_body"),
                 F.date_sub(F.lit(AS_OF), F.pmod(F.col("doc_id") * 7, F.lit(400)).cast("int"))
                  .alias("review_date"),
             ))


REVIEWS_SQL = """reviews AS (
  SELECT doc_id AS review_id, doc_id % (SELECT count(*) FROM part) AS product_id,
         source, lang,
         CAST(least(greatest(1 + 4 * quality - 2 * toxic, 1), 5) AS DOUBLE) AS rating,
         text AS review_body,
         CAST(DATE '2001-11-04' - CAST((doc_id * 7) % 400 AS INTEGER) AS DATE) AS review_date
  FROM documents LEFT JOIN labels USING (doc_id))"""


def with_ctes(*ctes: str) -> str:
    """Join CTE bodies (deduplicated, order kept) into a WITH prefix."""
    seen, parts = set(), []
    for c in ctes:
        for piece in _split_ctes(c):
            name = piece.split(" AS (", 1)[0].strip()
            if name not in seen:
                seen.add(name)
                parts.append(piece.strip())
    return "WITH " + ",\n".join(parts) + "\n"


def _split_ctes(text: str) -> list[str]:
    out, depth, cur = [], 0, []
    for ch in text:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append("".join(cur))
            cur = []
            continue
        cur.append(ch)
    if "".join(cur).strip():
        out.append("".join(cur))
    return out


def rnd(expr: str, digits: int) -> str:
    """DuckDB rounding that matches Spark's HALF_UP rounding of doubles.

    Spark rounds HALF_UP on the shortest decimal representation of the
    double; DuckDB rounds the binary value.  Going through the shortest text
    form and a decimal makes both agree, ties included.
    """
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


# ---------------------------------------------------------------- ingredients
def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue ingredient text: product p gets document p % count(documents)."""
    p = products(spark, sf_dir).select("product_id", "product_name")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ingredients"))
    n = d.agg(F.count(F.lit(1)).alias("_nd"))
    return (p.crossJoin(F.broadcast(n)).withColumn("doc_id", F.pmod(F.col("product_id"), F.col("_nd")))
             .join(d, "doc_id").drop("_nd"))


INGREDIENTS_SQL = """ingredients AS (
  SELECT p_partkey AS product_id, p_name AS product_name, d.doc_id, d.text AS ingredients
  FROM part JOIN documents d ON d.doc_id = p_partkey % (SELECT count(*) FROM documents))"""


def ingredient_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, product_name, text_id: which ingredient text each product has."""
    p = products(spark, sf_dir).select("product_id", "product_name")
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("_nd"))
    return (p.crossJoin(F.broadcast(n)).withColumn("text_id", F.pmod(F.col("product_id"), F.col("_nd")))
             .drop("_nd"))


def ingredient_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"),
                                                    F.col("text").alias("ingredients"))
