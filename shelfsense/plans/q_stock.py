"""Queries: monthly demand, 12-month series, stock status."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import binding as b
from ..operators import rules, timeseries as ts
from .registry import register

END_YM = b.AS_OF.year * 12 + b.AS_OF.month - 1  # month index of as_of

MONTHLY_SQL = b.SALES_SQL + """,
monthly AS (
  SELECT dealer_id, product_id, year, month, sum(units_sold) AS units
  FROM sales WHERE year IS NOT NULL AND month IS NOT NULL AND units_sold > 0
  GROUP BY dealer_id, product_id, year, month)"""

SERIES_SQL = b.TENANT_PRODUCTS_SQL + "," + MONTHLY_SQL + f""",
mstats AS (
  SELECT dealer_id, product_id, avg(units) AS hist_avg,
         avg(CASE WHEN year * 12 + month - 1 BETWEEN {END_YM - 11} AND {END_YM} THEN units END) AS recent_avg
  FROM monthly GROUP BY dealer_id, product_id),
series AS (
  SELECT tp.dealer_id, tp.product_id, s.slot,
         CASE WHEN st.hist_avg IS NULL THEN 0.0
              WHEN st.recent_avg IS NULL THEN st.hist_avg
              ELSE coalesce(m.units, st.recent_avg) END AS units
  FROM tenant_products tp
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS slot FROM range(12)) s
  LEFT JOIN mstats st ON st.dealer_id = tp.dealer_id AND st.product_id = tp.product_id
  LEFT JOIN monthly m ON m.dealer_id = tp.dealer_id AND m.product_id = tp.product_id
       AND m.year * 12 + m.month - 1 = {END_YM - 11} + s.slot)"""

STOCK_SQL = SERIES_SQL + "," + b.INVENTORY_SQL + """,
last3 AS (
  SELECT dealer_id, product_id,
         (((0.0 + max(CASE WHEN slot = 9 THEN units END)) + max(CASE WHEN slot = 10 THEN units END))
           + max(CASE WHEN slot = 11 THEN units END)) / 3 AS avg_raw
  FROM series WHERE slot >= 9 GROUP BY dealer_id, product_id),
stock AS (
  SELECT i.dealer_id, i.product_id, i.current_stock, i.lead_time_days, l.avg_raw,
         least(greatest(l.avg_raw, 1.0), 5000.0) AS avg_c,
         i.current_stock / (least(greatest(l.avg_raw, 1.0), 5000.0) / 30.0) AS days
  FROM inventory i JOIN last3 l USING (dealer_id, product_id))"""

STOCK_STATUS_CASES = """
  CASE WHEN days < 7 THEN 'understock' WHEN days < 30 THEN 'understock'
       WHEN days > 180 THEN 'overstock' WHEN days > 90 THEN 'watch' ELSE 'normal' END"""
STOCK_RISK_CASES = """
  CASE WHEN days < 7 THEN 'HIGH' WHEN days < 30 THEN 'MEDIUM' ELSE 'LOW' END"""


def series_frame(spark, sf_dir, of=None):
    """The 12-month series of all tenants' products, or of those in ``of`` (dealer_id, product_id), whose sales alone are then summed."""
    keys = ["dealer_id", "product_id"]
    sales, universe = b.sales(spark, sf_dir), b.tenant_products(spark, sf_dir).select(*keys)
    if of is not None:
        sales, universe = (x.join(of, keys, "left_semi") for x in (sales, universe))
    return ts.last_n_months(ts.monthly_units(sales), universe, b.AS_OF)


def stock_frame(spark, sf_dir):
    ser = series_frame(spark, sf_dir)
    inv = b.inventory(spark, sf_dir)
    return rules.stock_status(ser.join(inv, ["dealer_id", "product_id"]))


@register("monthly_units", sql=b.with_ctes(MONTHLY_SQL) + """
SELECT dealer_id, product_id, year, month, round(units, 6) AS units FROM monthly""")
def q_monthly_units(spark, sf_dir):
    m = ts.monthly_units(b.sales(spark, sf_dir))
    return m.select("dealer_id", "product_id", "year", "month", F.round("units", 6).alias("units"))


@register("last_12_months", sql=b.with_ctes(SERIES_SQL) + """
SELECT dealer_id, product_id, slot, round(units, 6) AS units FROM series""")
def q_last_12_months(spark, sf_dir):
    ex = ts.explode_series(series_frame(spark, sf_dir), ["dealer_id", "product_id"])
    return ex.select("dealer_id", "product_id", "slot", F.round("units", 6).alias("units"))


@register("stock_status", sql=b.with_ctes(STOCK_SQL) + f"""
SELECT dealer_id, product_id, current_stock, {b.rnd('avg_c', 1)} AS avg_monthly,
       {b.rnd('avg_c / 30.0', 2)} AS daily_rate, {b.rnd('days', 1)} AS days_until_stockout,
       {STOCK_STATUS_CASES} AS stock_status, {STOCK_RISK_CASES} AS stockout_risk
FROM stock""")
def q_stock_status(spark, sf_dir):
    return stock_frame(spark, sf_dir).select(
        "dealer_id", "product_id", "current_stock", "avg_monthly", "daily_rate",
        "days_until_stockout", "stock_status", "stockout_risk")
