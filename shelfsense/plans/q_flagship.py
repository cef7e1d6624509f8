"""Queries: flagship per-product analysis and everything built on it
(G02, G07, G10, G12, G14-G18, C05, C06, D10, E13-E15, H04)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from .. import binding as b
from ..functions import lexicons as L
from ..operators import aggregates as ag
from ..operators import alerts as al
from ..operators import listing as ls
from ..operators import rules
from ..session import stored
from . import product_analysis as pa
from .q_aggs import SCORED_SQL
from .q_safety import ITEMS_SQL, LEX
from .q_stock import STOCK_SQL
from .registry import ORACLES, register
from .sqlgen import clean_sql, contains_count_sql, md5_mod_sql, q

_CLEAN = clean_sql("skin_text")
_CNTS = [(n, contains_count_sql("clean", terms)) for n, terms in L.SKIN_BOOST_CLASSES]
_TOPN = "greatest(" + ", ".join(c for _, c in _CNTS) + ")"
_TOP = "CASE " + " ".join(f"WHEN {c} = {_TOPN} THEN {q(n)}" for n, c in _CNTS) + " END"

ANALYSIS_SQL = b.with_ctes(STOCK_SQL, b.INGREDIENTS_SQL, ITEMS_SQL, SCORED_SQL) + f"""
, hist AS (SELECT dealer_id, product_id, list(units ORDER BY slot) AS h FROM series GROUP BY dealer_id, product_id),
dem AS (SELECT dealer_id, product_id, h, list_reduce([0.0] || h, lambda a, x: a + x) AS total_sales,
               {b.rnd('(list_reduce([0.0] || h, lambda a, x: a + x) / len(h)) * (1 + CAST(0.03 AS DOUBLE) * 6)', 1)} AS last_f
        FROM hist),
dem2 AS (SELECT *, (last_f - h[12]) / greatest(1.0, h[12]) * 100.0 AS pct FROM dem),
saf AS (SELECT i.product_id, i.product_name, i.ingredients, s.safety_score, s.harmful_count,
               CASE WHEN s.safety_score >= 85 THEN 'Safe' WHEN s.safety_score >= 60 THEN 'Moderate' ELSE 'Unsafe' END
                 AS safety_status,
               CASE WHEN s.safety_score < 60 THEN 'high' WHEN s.safety_score < 80 THEN 'medium' ELSE 'none' END
                 AS risk_level
        FROM ingredients i JOIN scored s ON s.doc_id = i.doc_id),
sk0 AS (SELECT product_id, CASE WHEN length(coalesce(ingredients, '')) > 0 THEN ingredients ELSE product_name END
                 AS skin_text FROM ingredients),
sk1 AS (SELECT product_id, {_CLEAN} AS clean, coalesce(skin_text, '') = '' AS empty FROM sk0),
sk2 AS (SELECT product_id, empty, CASE WHEN {_TOPN} > 0 THEN {_TOP} END AS top, {_TOPN} AS topn FROM sk1),
skin AS (SELECT product_id,
           CASE WHEN empty THEN 'all_skin_types' WHEN topn >= 2 THEN top WHEN topn = 1 AND top = 'normal' THEN top
                ELSE 'normal' END AS skin_type,
           {b.rnd('''CASE WHEN empty THEN 0.5 WHEN topn >= 2 THEN least(0.95, 0.6 + 0.08 * topn)
                WHEN topn = 1 AND top = 'normal' THEN least(0.95, 0.6 + 0.12) ELSE 0.6 END''', 3)} AS skin_confidence
         FROM sk2),
rev AS (SELECT product_id, count(*) AS review_count, {b.rnd('avg(rating)', 2)} AS avg_rating,
               {b.rnd('avg(sentiment_score)', 3)} AS sentiment_avg FROM rscored2 GROUP BY product_id),
base AS (
  SELECT tp.dealer_id, tp.product_id, tp.product_name, tp.category, tp.brand, tp.price,
         CASE WHEN d.pct > 2 THEN 'increasing' WHEN d.pct < -2 THEN 'decreasing' ELSE 'stable' END AS forecast_trend,
         d.pct AS demand_change_pct, d.total_sales,
         st.current_stock, st.avg_raw, {b.rnd('st.avg_c', 1)} AS avg_monthly, {b.rnd('st.days', 1)} AS days_until_stockout,
         CASE WHEN st.days < 7 THEN 'understock' WHEN st.days < 30 THEN 'understock'
              WHEN st.days > 180 THEN 'overstock' WHEN st.days > 90 THEN 'watch' ELSE 'normal' END AS stock_status,
         CASE WHEN st.days < 7 THEN 'HIGH' WHEN st.days < 30 THEN 'MEDIUM' ELSE 'LOW' END AS stockout_risk,
         coalesce(sa.safety_score, 100.0) AS safety_score, coalesce(sa.safety_status, 'Safe') AS safety_status,
         coalesce(sa.risk_level, 'none') AS risk_level, CAST(coalesce(sa.harmful_count, 0) AS INTEGER) AS harmful_count,
         sa.ingredients, sk.skin_type, sk.skin_confidence,
         coalesce(rv.review_count, 0) AS review_count, coalesce(rv.avg_rating, 0.0) AS avg_rating,
         coalesce(rv.sentiment_avg, 0.0) AS sentiment_avg
  FROM tenant_products tp
  LEFT JOIN dem2 d USING (dealer_id, product_id)
  LEFT JOIN stock st USING (dealer_id, product_id)
  LEFT JOIN saf sa ON sa.product_id = tp.product_id
  LEFT JOIN skin sk ON sk.product_id = tp.product_id
  LEFT JOIN rev rv ON rv.product_id = tp.product_id),
dec AS (
  SELECT *, coalesce(days_until_stockout, 9999.0) AS dd, avg_raw AS am FROM base),
analysis AS (
  SELECT *,
    CASE WHEN risk_level = 'high' THEN 'REMOVE FROM SALE'
         WHEN am <= 0 AND stock_status = 'understock' THEN 'INVESTIGATE'
         WHEN am <= 0 THEN 'MONITOR'
         WHEN dd < 3 THEN 'AGGRESSIVE RESTOCK' WHEN dd < 7 THEN 'RESTOCK URGENTLY' WHEN dd < 14 THEN 'RESTOCK SOON'
         WHEN risk_level = 'medium' THEN 'CAUTION — DO NOT RESTOCK'
         WHEN stock_status = 'overstock' AND forecast_trend = 'decreasing' THEN 'REDUCE PRICE — CLEAR STOCK'
         WHEN stock_status = 'overstock' THEN 'HOLD — MONITOR SALES'
         WHEN forecast_trend = 'increasing' AND stock_status = 'normal' THEN 'INCREASE STOCK'
         ELSE 'MAINTAIN STOCK' END AS stock_decision,
    CASE WHEN risk_level = 'high' THEN 'Product contains HIGH risk harmful ingredients. Immediate removal recommended to protect customers and avoid liability.'
         WHEN am <= 0 AND stock_status = 'understock' THEN 'Stock is low but no sales history found. Confirm if product is new or discontinued.'
         WHEN am <= 0 THEN 'No sales history available. Add sales data to get accurate decisions.'
         WHEN dd < 3 THEN printf('CRITICAL: Only %s day(s) of stock remaining at current sales rate. Order at least %d units immediately to cover 3 months of demand.',
                                 CAST({b.rnd('dd', 1)} AS VARCHAR), greatest(CAST(floor(am * 3) AS BIGINT), 50))
         WHEN dd < 7 THEN printf('Stock will run out in %s days. Order %d units within 48 hours to avoid stockout.',
                                 CAST({b.rnd('dd', 1)} AS VARCHAR), greatest(CAST(floor(am * 2) AS BIGINT), 30))
         WHEN dd < 14 THEN printf('%d days of stock left. Place order for %d units within the week.',
                                  CAST({b.rnd('dd', 0)} AS BIGINT), greatest(CAST(floor(am * 2) AS BIGINT), 30))
         WHEN risk_level = 'medium' THEN 'Product contains medium-risk ingredients. Do not order more stock. Evaluate safety report before next purchase order.'
         WHEN stock_status = 'overstock' AND forecast_trend = 'decreasing' THEN
              printf('%d days of supply on hand and demand is declining. Offer 15-25%% discount to clear inventory.',
                     CAST({b.rnd('dd', 0)} AS BIGINT))
         WHEN stock_status = 'overstock' THEN
              printf('%d days of supply on hand. Sales are stable. Do not reorder until stock drops below %d units.',
                     CAST({b.rnd('dd', 0)} AS BIGINT), CAST(floor(am * 1.5) AS BIGINT))
         WHEN forecast_trend = 'increasing' AND stock_status = 'normal' THEN
              printf('Demand is trending upward. Consider ordering %d extra units to prepare for surge.',
                     CAST(floor(am * 1.5) AS BIGINT))
         ELSE printf('Stock levels healthy with %d days of supply. Reorder when stock drops below %d units.',
                     CAST({b.rnd('dd', 0)} AS BIGINT), CAST(floor(am * 1.5) AS BIGINT)) END AS decision_reason,
    CASE WHEN risk_level = 'high' THEN 100.0 WHEN am <= 0 AND stock_status = 'understock' THEN 40.0
         WHEN am <= 0 THEN 20.0 WHEN dd < 3 THEN 95.0 WHEN dd < 7 THEN 85.0 WHEN dd < 14 THEN 70.0
         WHEN risk_level = 'medium' THEN 65.0
         WHEN stock_status = 'overstock' AND forecast_trend = 'decreasing' THEN 60.0
         WHEN stock_status = 'overstock' THEN 35.0
         WHEN forecast_trend = 'increasing' AND stock_status = 'normal' THEN 50.0 ELSE 25.0 END AS priority_score,
    CAST(coalesce(length(ingredients) > 10, false) AS INTEGER) + CAST(coalesce(safety_score >= 60, false) AS INTEGER)
      + CAST(coalesce(skin_type IS NOT NULL AND skin_type <> '', false) AS INTEGER)
      + CAST(coalesce(review_count >= 3, false) AS INTEGER) + CAST(coalesce(avg_rating >= 3.5, false) AS INTEGER)
      + CAST(coalesce(total_sales > 0, false) AS INTEGER) + 1
      + CAST(coalesce(risk_level <> 'high', true) AS INTEGER) AS checks_passed
  FROM dec),
final AS (
  SELECT *, CASE WHEN checks_passed = 8 THEN 'fully_verified' WHEN checks_passed >= 6 THEN 'partial'
                 WHEN risk_level = 'high' THEN 'flagged' ELSE 'unverified' END AS verification_status
  FROM analysis)
"""

OUT_COLS = ["dealer_id", "product_id", "forecast_trend", "stock_status", "days_until_stockout", "stockout_risk",
            "avg_monthly", "current_stock", "safety_score", "safety_status", "risk_level", "harmful_count",
            "skin_type", "skin_confidence", "review_count", "avg_rating", "sentiment_avg", "stock_decision",
            "decision_reason", "priority_score", "checks_passed", "verification_status"]


def analysis_frame(spark, sf_dir):
    return pa.full_product_analysis(
        b.tenant_products(spark, sf_dir), b.sales(spark, sf_dir), b.inventory(spark, sf_dir),
        b.ingredient_links(spark, sf_dir), b.reviews(spark, sf_dir), b.AS_OF, lexicon=LEX,
        texts=b.ingredient_texts(spark, sf_dir))


@register("product_analysis", sql=ANALYSIS_SQL + f"""
SELECT {', '.join(OUT_COLS)}, {b.rnd('demand_change_pct', 6)} AS demand_change_pct,
       {b.rnd('total_sales', 6)} AS total_sales FROM final""")
def q_product_analysis(spark, sf_dir):
    a = analysis_frame(spark, sf_dir)
    return a.select(*OUT_COLS, F.round("demand_change_pct", 6).alias("demand_change_pct"),
                    F.round("total_sales", 6).alias("total_sales"))


@register("stock_decision", sql=ANALYSIS_SQL + """
SELECT dealer_id, product_id, stock_decision, decision_reason, priority_score FROM final""")
def q_stock_decision(spark, sf_dir):
    return analysis_frame(spark, sf_dir).select(*pa.KEYS, "stock_decision", "decision_reason", "priority_score")


@register("verification_status", sql=ANALYSIS_SQL + """
SELECT dealer_id, product_id, checks_passed, verification_status FROM final""")
def q_verification_status(spark, sf_dir):
    return analysis_frame(spark, sf_dir).select(*pa.KEYS, "checks_passed", "verification_status")


@register("top_products", sql=ANALYSIS_SQL + f"""
SELECT * FROM (SELECT dealer_id, product_id, CAST(row_number() OVER (PARTITION BY dealer_id
    ORDER BY CASE WHEN forecast_trend = 'increasing' THEN 1 ELSE 0 END DESC, priority_score DESC, total_sales DESC,
             product_id) AS INTEGER) AS rank FROM final) WHERE rank <= 10""")
def q_top_products(spark, sf_dir):
    t = ls.top_products(analysis_frame(spark, sf_dir))
    return t.select("dealer_id", "product_id", "rank")


@register("category_health", sql=ANALYSIS_SQL + f"""
SELECT dealer_id, category, count(*) AS total,
       count_if(stock_status = 'normal' AND risk_level IN ('none', 'low')) AS healthy,
       {b.rnd("100.0 * count_if(stock_status = 'normal' AND risk_level IN ('none', 'low')) / greatest(count(*), 1)", 1)}
         AS health_pct
FROM final GROUP BY dealer_id, category""")
def q_category_health(spark, sf_dir):
    return ag.category_health(analysis_frame(spark, sf_dir))


@register("tenant_kpis", sql=ANALYSIS_SQL + f"""
SELECT dealer_id, count(*) AS total_products, count_if(stock_status = 'understock') AS understock_count,
       count_if(stock_status = 'overstock') AS overstock_count,
       count_if(risk_level IN ('high', 'medium')) AS harmful_count,
       count_if(stockout_risk = 'HIGH' OR risk_level = 'high') AS critical_alerts,
       {b.rnd('sum(total_sales)', 4)} AS total_sales
FROM final GROUP BY dealer_id""")
def q_tenant_kpis(spark, sf_dir):
    k = ag.tenant_kpis(analysis_frame(spark, sf_dir))
    return k.withColumn("total_sales", F.round("total_sales", 4))


@register("catalog_stats", sql=b.with_ctes(b.PRODUCTS_SQL, b.INGREDIENTS_SQL) + """
, p AS (SELECT p.*, i.ingredients FROM products p LEFT JOIN ingredients i USING (product_id)),
top AS (SELECT category FROM p WHERE category IS NOT NULL AND lower(category) <> 'general'
        GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)
SELECT count(*) AS total_products, count(DISTINCT brand) AS distinct_brands,
       count_if(length(coalesce(ingredients, '')) > 0) AS with_ingredients,
       (SELECT category FROM top) AS top_category
FROM p""")
def q_catalog_stats(spark, sf_dir):
    p = b.products(spark, sf_dir).join(b.ingredients(spark, sf_dir).select("product_id", "ingredients"),
                                       "product_id", "left")
    return ag.catalog_stats(p)


@register("diverse_top_k", sql=ANALYSIS_SQL + """
, c AS (SELECT *, row_number() OVER (PARTITION BY dealer_id, coalesce(trim(category), 'Other')
                                     ORDER BY priority_score DESC, product_id) AS cr FROM final)
SELECT dealer_id, product_id, category, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY priority_score DESC, product_id) AS rank
  FROM c WHERE cr <= 2) WHERE rank <= 10""")
def q_diverse_top_k(spark, sf_dir):
    d = ls.diverse_top_k(analysis_frame(spark, sf_dir), "priority_score")
    return d.select("dealer_id", "product_id", "category", "rank")


@register("horizon_score", sql=ANALYSIS_SQL + f"""
, s AS (SELECT dealer_id, product_id, days_until_stockout,
          {b.rnd('''CASE WHEN coalesce(days_until_stockout, 999.0) BETWEEN 7 AND 30
                    THEN (1.0 - (coalesce(days_until_stockout, 999.0) - 7) / 23) * 60.0 ELSE 0.0 END
           + CASE WHEN lower(forecast_trend) = 'increasing' THEN 30.0 WHEN lower(forecast_trend) = 'stable' THEN 5.0 ELSE 0.0 END
           + CASE WHEN lower(stock_status) = 'overstock' AND lower(forecast_trend) = 'increasing' THEN 20.0 ELSE 0.0 END
           + CASE WHEN upper(stockout_risk) = 'HIGH' THEN 15.0 WHEN upper(stockout_risk) = 'MEDIUM' THEN 7.0 ELSE 0.0 END
           + coalesce(avg_rating, 0.0) * 2.0''', 2)} AS horizon_score
        FROM final
        WHERE days_until_stockout BETWEEN 7 AND 30 OR (forecast_trend = 'increasing' AND days_until_stockout > 0))
SELECT dealer_id, product_id, horizon_score FROM s WHERE horizon_score > 0""")
def q_horizon_score(spark, sf_dir):
    h = rules.horizon_score(analysis_frame(spark, sf_dir), horizon=30)
    return h.select("dealer_id", "product_id", "horizon_score")


@register("notifications", sql=ANALYSIS_SQL + """
, n AS (
  SELECT dealer_id, product_id, 'understock' AS notif_type, '⚠️ Critical Stockout: ' || substring(product_name, 1, 40) AS title,
         printf('Will stock out in %d days. Restock immediately.', CAST(round(days_until_stockout, 0) AS BIGINT)) AS message,
         'critical' AS severity FROM final WHERE stockout_risk = 'HIGH'
  UNION ALL
  SELECT dealer_id, product_id, 'understock', 'Low Stock: ' || substring(product_name, 1, 40),
         printf('%d days of inventory remaining.', CAST(round(days_until_stockout, 0) AS BIGINT)), 'high'
  FROM final WHERE stockout_risk = 'MEDIUM'
  UNION ALL
  SELECT dealer_id, product_id, 'harmful', '☠️ Harmful Ingredients: ' || substring(product_name, 1, 40),
         'Product contains HIGH risk ingredients. Consider removing from inventory.', 'critical' FROM (
    SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY product_id) AS r FROM final WHERE risk_level = 'high')
  WHERE r <= 10
  UNION ALL
  SELECT dealer_id, product_id, 'harmful', '⚠️ Safety Warning: ' || substring(product_name, 1, 40),
         'Product contains MEDIUM risk ingredients. Review before promoting.', 'medium' FROM (
    SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY product_id) AS r FROM final WHERE risk_level = 'medium')
  WHERE r <= 10
  UNION ALL
  SELECT dealer_id, product_id, 'overstock', 'Overstock: ' || substring(product_name, 1, 40),
         printf('Overstocked by %d days. Consider promotions.', CAST(round(days_until_stockout, 0) AS BIGINT)), 'low' FROM (
    SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY product_id) AS r FROM final WHERE stock_status = 'overstock')
  WHERE r <= 10
  UNION ALL
  SELECT dealer_id, product_id, 'surge', '📈 Demand Surge: ' || substring(product_name, 1, 40),
         'Demand is increasing. Ensure adequate stock levels.', 'medium' FROM (
    SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY priority_score DESC, product_id) AS r
    FROM final WHERE forecast_trend = 'increasing') WHERE r <= 5)
SELECT * FROM n""")
def q_notifications(spark, sf_dir):
    return al.notifications(analysis_frame(spark, sf_dir))


def notifications_table(spark, sf_dir, alerts=None):
    """Materialisable notifications table: generated alerts with stable md5-based ids,
    read flags and creation times derived from the id."""
    from ..functions.text import md5_mod
    n = al.notifications(analysis_frame(spark, sf_dir)) if alerts is None else alerts
    nid = md5_mod(F.concat_ws("|", F.col("dealer_id").cast("string"), F.col("product_id").cast("string"),
                              F.col("title")), 2147483647)
    base = _dt.datetime(2001, 11, 4)
    return (n.withColumn("notif_id", nid)
             .withColumn("is_read", F.pmod(F.col("notif_id"), F.lit(3)) == 0)
             .withColumn("created_at", F.lit(base) - F.make_dt_interval(F.pmod(F.col("notif_id"), F.lit(14)).cast("int"))))


NOTIF_TABLE_SQL = f"""WITH nb AS ({ORACLES["notifications"]}),
nt AS (SELECT *, {md5_mod_sql("CAST(dealer_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR) || '|' || title", 2147483647)}
                   AS notif_id FROM nb),
ntab AS (SELECT *, notif_id % 3 = 0 AS is_read,
                TIMESTAMP '2001-11-04 00:00:00' - to_days(CAST(notif_id % 14 AS INTEGER)) AS created_at FROM nt)"""


@register("notification_feed", sql=NOTIF_TABLE_SQL + """
SELECT * FROM (SELECT dealer_id, notif_id, notif_type, severity,
  CAST(row_number() OVER (PARTITION BY dealer_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1
       WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, notif_id DESC) AS INTEGER) AS feed_rank
  FROM ntab WHERE NOT is_read) WHERE feed_rank <= 50""")
def q_notification_feed(spark, sf_dir):
    f = al.notification_feed(notifications_table(spark, sf_dir))
    return f.select("dealer_id", "notif_id", "notif_type", "severity", "feed_rank")


@register("notification_dedup", sql=NOTIF_TABLE_SQL + """
SELECT dealer_id, product_id, title FROM nb
WHERE (dealer_id, product_id, title) NOT IN (SELECT (dealer_id, product_id, title) FROM ntab WHERE NOT is_read)""")
def q_notification_dedup(spark, sf_dir):
    # the generated alerts are both the new ones and the base of the table: worked out and stored once
    new = stored(al.notifications(analysis_frame(spark, sf_dir)))
    existing = notifications_table(spark, sf_dir, new)
    return al.notification_dedup(new, existing).select("dealer_id", "product_id", "title")


@register("notification_retention", sql=NOTIF_TABLE_SQL + """
SELECT dealer_id, notif_id, is_read FROM ntab
WHERE NOT (is_read AND created_at < TIMESTAMP '2001-10-28 00:00:00')""")
def q_notification_retention(spark, sf_dir):
    r = al.notification_retention(notifications_table(spark, sf_dir), _dt.datetime(2001, 11, 4))
    return r.select("dealer_id", "notif_id", "is_read")


@register("alert_feed", sql=ANALYSIS_SQL + """
, c AS (
  SELECT dealer_id, product_id, 'harmful' AS alert_type, 1 AS priority,
         row_number() OVER (PARTITION BY dealer_id ORDER BY product_id) AS class_rank FROM final WHERE risk_level = 'high'
  UNION ALL SELECT dealer_id, product_id, 'understock', 2,
         row_number() OVER (PARTITION BY dealer_id ORDER BY days_until_stockout, product_id) FROM final
         WHERE days_until_stockout >= 0 AND days_until_stockout < 3
  UNION ALL SELECT dealer_id, product_id, 'understock', 3,
         row_number() OVER (PARTITION BY dealer_id ORDER BY days_until_stockout, product_id) FROM final
         WHERE days_until_stockout >= 3 AND days_until_stockout < 7
  UNION ALL SELECT dealer_id, product_id, 'harmful', 4,
         row_number() OVER (PARTITION BY dealer_id ORDER BY product_id) FROM final WHERE risk_level = 'medium'
  UNION ALL SELECT dealer_id, product_id, 'opportunity', 5,
         row_number() OVER (PARTITION BY dealer_id ORDER BY product_id) FROM final
         WHERE forecast_trend = 'increasing' AND stock_status <> 'understock'
  UNION ALL SELECT dealer_id, product_id, 'overstock', 6,
         row_number() OVER (PARTITION BY dealer_id ORDER BY product_id) FROM final WHERE stock_status = 'overstock'),
lim AS (SELECT * FROM c WHERE class_rank <= CASE WHEN priority IN (1, 2) THEN 5 ELSE 3 END)
SELECT * FROM (SELECT dealer_id, product_id, alert_type, priority,
                      CAST(row_number() OVER (PARTITION BY dealer_id ORDER BY priority, class_rank) AS INTEGER) AS feed_rank
               FROM lim) WHERE feed_rank <= 10""")
def q_alert_feed(spark, sf_dir):
    f = al.alert_feed(analysis_frame(spark, sf_dir))
    return f.select("dealer_id", "product_id", "alert_type", "priority", "feed_rank")


@register("restock_update", sql=ANALYSIS_SQL + f"""
, u AS (SELECT dealer_id, product_id, CASE WHEN category = 'PROMO' THEN 500.0 ELSE current_stock END AS current_stock,
               CASE WHEN category = 'PROMO' THEN 500.0 / (least(greatest(avg_raw, 1.0), 5000.0) / 30.0) END AS d,
               category, days_until_stockout AS old_days, stock_status AS old_status, stockout_risk AS old_risk
        FROM final)
SELECT dealer_id, product_id, current_stock,
       CASE WHEN category = 'PROMO' THEN {b.rnd('d', 1)} ELSE old_days END AS days_until_stockout,
       CASE WHEN category <> 'PROMO' THEN old_status WHEN d < 7 THEN 'understock' WHEN d < 30 THEN 'understock'
            WHEN d > 180 THEN 'overstock' WHEN d > 90 THEN 'watch' ELSE 'normal' END AS stock_status,
       CASE WHEN category <> 'PROMO' THEN old_risk WHEN d < 7 THEN 'HIGH' WHEN d < 30 THEN 'MEDIUM' ELSE 'LOW' END
         AS stockout_risk
FROM u""")
def q_restock_update(spark, sf_dir):
    a = analysis_frame(spark, sf_dir)
    # every product of a given category is restocked to 500 units
    upd = (b.tenant_products(spark, sf_dir).where(F.col("category") == "PROMO")
           .select("dealer_id", "product_id", F.lit(500.0).alias("current_stock")))
    r = pa.restock_update(a, upd)
    return r.select("dealer_id", "product_id", "current_stock", "days_until_stockout", "stock_status", "stockout_risk")


@register("product_360", sql=ANALYSIS_SQL + """
SELECT dealer_id, product_id, product_name, category, current_stock, stock_status, safety_score, risk_level,
       review_count, avg_rating FROM final""")
def q_product_360(spark, sf_dir):
    a = analysis_frame(spark, sf_dir)
    return a.select("dealer_id", "product_id", "product_name", "category", "current_stock", "stock_status",
                    "safety_score", "risk_level", "review_count", "avg_rating")
