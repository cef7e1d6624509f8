"""Queries: retail inventory engine, priorities, bands, restock advice, KPIs, verified
and ML-ready masters, LSH similarity (SURVEY G03-G06, G08, G09, G16, G18, J04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import binding as b
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import listing as ls
from ..operators import rules, safety
from ..operators import similarity as sim
from ..operators import timeseries as ts
from ..operators.ordering import dense_codes
from . import q_flagship
from .q_safety import ITEMS_SQL, LEX
from .q_series import HIST_SQL, hist_frame
from .registry import ORACLES, register

# ------------------------------------------------------------------ shared frame


def retail_frame(spark, sf_dir):
    h = ts.forecast_baseline(hist_frame(spark, sf_dir))
    h = ts.demand_change(h)
    h = ts.volatility(h)
    inv = b.inventory(spark, sf_dir).select("dealer_id", "product_id", "current_stock", "lead_time_days")
    tp = b.tenant_products(spark, sf_dir).select("dealer_id", "product_id", "price", "cost_price")
    texts = b.ingredient_texts(spark, sf_dir)
    saf = safety.safety_family(texts, lexicon=LEX).select("text_id", "safety_score")
    links = b.ingredient_links(spark, sf_dir).select("product_id", "text_id")
    psaf = links.join(saf, "text_id").drop("text_id")
    r = (h.join(inv, ["dealer_id", "product_id"]).join(tp, ["dealer_id", "product_id"])
          .join(psaf, "product_id", "left").fillna({"safety_score": 100.0}))
    r = rules.retail_decision(r)
    return rules.priority_score(r)


def _fc(i: int) -> str:
    return b.rnd(f"m * (1 + CAST(0.03 AS DOUBLE) * {i})", 1)


RETAIL_SQL = b.with_ctes(HIST_SQL, b.INVENTORY_SQL, b.INGREDIENTS_SQL, ITEMS_SQL) + f"""
, fc AS (SELECT dealer_id, product_id, h, m, [{', '.join(_fc(i) for i in range(7))}] AS f FROM hm),
fz AS (SELECT *, list_reduce([0.0] || f, lambda a, x: a + x) / 7 AS f_mean,
              (f[7] - h[12]) / greatest(1.0, h[12]) * 100.0 AS change,
              sqrt(list_reduce([0.0] || [(x - m) * (x - m) for x in h], lambda a, x: a + x) / len(h))
                / greatest(1.0, m) AS cv FROM fc),
psaf AS (SELECT i.product_id, s.safety_score FROM ingredients i JOIN scored s ON s.doc_id = i.doc_id),
base AS (SELECT fz.*, inv.current_stock AS stock, inv.lead_time_days AS lead, tp.price, tp.cost_price,
                coalesce(ps.safety_score, 100.0) AS safety_score, fz.f_mean / 7.0 AS f_daily
         FROM fz JOIN inventory inv USING (dealer_id, product_id)
         JOIN tenant_products tp USING (dealer_id, product_id)
         LEFT JOIN psaf ps ON ps.product_id = fz.product_id),
r1 AS (SELECT *, greatest(0.01, (price - cost_price) / greatest(0.01, price)) AS profit_margin,
              stock / greatest(1.0, f_daily) AS days_of_inventory, f_daily * lead AS reorder_point FROM base),
r2 AS (SELECT *, CASE WHEN days_of_inventory < lead THEN 'HIGH' WHEN days_of_inventory < lead * 1.5 THEN 'MEDIUM'
                      ELSE 'LOW' END AS lead_time_risk FROM r1),
r3 AS (SELECT *,
  CASE WHEN safety_score < 60 THEN 'REMOVE FROM SALE' WHEN safety_score < 85 THEN 'CAUTION / REVIEW'
       WHEN lead_time_risk = 'HIGH' AND profit_margin > 0.4 THEN 'AGGRESSIVE RESTOCK'
       WHEN lead_time_risk = 'HIGH' THEN 'RESTOCK CAREFULLY'
       WHEN change > 5 AND stock <= reorder_point * 1.5 THEN 'INCREASE STOCK'
       WHEN change < -10 AND stock > reorder_point * 3 THEN 'CLEARANCE SALE'
       WHEN change < -5 AND stock > reorder_point * 2 THEN 'REDUCE STOCK'
       WHEN cv > 0.35 THEN 'MONITOR CLOSELY' ELSE 'MAINTAIN STOCK' END AS retail_decision,
  least(greatest(30.0 + 0.5 * (change + 50.0 * least(10.0, 1.0 / greatest(0.1, days_of_inventory))
                               + 2000.0 * profit_margin - 100.0 * cv), 0.0), 100.0) AS pbase FROM r2),
retail AS (SELECT *, CASE WHEN safety_score < 60 THEN 0.0 WHEN safety_score < 85 THEN least(pbase, 40.0)
                          ELSE pbase END AS retail_priority FROM r3)"""


@register("retail_decision", sql=RETAIL_SQL + f"""
SELECT dealer_id, product_id, {b.rnd('profit_margin', 6)} AS profit_margin,
       {b.rnd('days_of_inventory', 6)} AS days_of_inventory, {b.rnd('reorder_point', 6)} AS reorder_point,
       lead_time_risk, retail_decision FROM retail""")
def q_retail_decision(spark, sf_dir):
    r = retail_frame(spark, sf_dir)
    return r.select("dealer_id", "product_id", F.round("profit_margin", 6).alias("profit_margin"),
                    F.round("days_of_inventory", 6).alias("days_of_inventory"),
                    F.round("reorder_point", 6).alias("reorder_point"), "lead_time_risk", "retail_decision")


@register("priority_score", sql=RETAIL_SQL + f"""
SELECT dealer_id, product_id, {b.rnd('retail_priority', 6)} AS retail_priority FROM retail""")
def q_priority_score(spark, sf_dir):
    r = retail_frame(spark, sf_dir)
    return r.select("dealer_id", "product_id", F.round("retail_priority", 6).alias("retail_priority"))


@register("confidence_band", sql=RETAIL_SQL + f"""
, e AS (SELECT dealer_id, product_id, cv, unnest(f) AS p, generate_subscripts(f, 1) - 1 AS i FROM retail)
SELECT dealer_id, product_id, CAST(i AS INTEGER) AS step,
       {b.rnd('p - (0.05 + 0.02 * i + 0.1 * cv) * p', 6)} AS lo, {b.rnd('p + (0.05 + 0.02 * i + 0.1 * cv) * p', 6)} AS hi
FROM e""")
def q_confidence_band(spark, sf_dir):
    r = rules.confidence_band(retail_frame(spark, sf_dir))
    e = ts.explode_series(r, ["dealer_id", "product_id"], "confidence_band", "step", "band")
    return e.select("dealer_id", "product_id", "step", F.round("band.lo", 6).alias("lo"),
                    F.round("band.hi", 6).alias("hi"))


@register("restock_recommendation", sql=RETAIL_SQL + """
SELECT dealer_id, product_id,
       CASE WHEN stock IS NULL THEN (CASE WHEN f_mean > 500 THEN 'Buy More' WHEN f_mean > 100 THEN 'Maintain'
                                          ELSE 'Review slow-moving' END)
            WHEN (CASE WHEN f_mean > 0 THEN stock / f_mean ELSE 0.0 END) < 2 THEN 'Buy More'
            WHEN (CASE WHEN f_mean > 0 THEN stock / f_mean ELSE 0.0 END) > 6 THEN 'Hold' ELSE 'Monitor' END
         AS recommendation
FROM retail""")
def q_restock_recommendation(spark, sf_dir):
    r = rules.restock_recommendation(retail_frame(spark, sf_dir))
    return r.select("dealer_id", "product_id", "recommendation")


@register("retail_kpis", sql=RETAIL_SQL + """
SELECT dealer_id, count_if(lead_time_risk = 'HIGH') AS high_risk, count_if(change > 2) AS growing
FROM retail GROUP BY dealer_id""")
def q_retail_kpis(spark, sf_dir):
    return rules.retail_kpis(retail_frame(spark, sf_dir))


# G16 under its inventory name: the same plan as the flagship query
register("full_product_analysis", sql=ORACLES["product_analysis"])(q_flagship.q_product_analysis)


# ------------------------------------------------------------------ G08 / G09
VERIFIED_SQL = b.with_ctes(b.PRODUCTS_SQL, b.REVIEWS_SQL, b.SALES_SQL, b.INGREDIENTS_SQL) + f"""
, ing AS (SELECT product_id FROM ingredients WHERE length(coalesce(ingredients, '')) > 0),
rv AS (SELECT DISTINCT product_id FROM reviews),
sl AS (SELECT DISTINCT product_id FROM sales),
ids AS (SELECT product_id FROM products
        INTERSECT (SELECT product_id FROM ing UNION SELECT product_id FROM rv)
        INTERSECT (SELECT product_id FROM rv UNION SELECT product_id FROM sl)),
ra AS (SELECT product_id, count(*) AS review_count, {b.rnd('avg(rating)', 2)} AS avg_rating FROM reviews GROUP BY 1),
sa AS (SELECT product_id, sum(units_sold) AS total_units FROM sales GROUP BY 1),
verified AS (SELECT i.product_id, p.product_name, p.brand, p.category, coalesce(ra.review_count, 0) AS review_count,
                    coalesce(ra.avg_rating, 0.0) AS avg_rating, coalesce(sa.total_units, 0.0) AS total_units
             FROM ids i JOIN products p USING (product_id) LEFT JOIN ra USING (product_id)
             LEFT JOIN sa USING (product_id))"""


def verified_frame(spark, sf_dir):
    p = b.products(spark, sf_dir)
    ing = b.ingredients(spark, sf_dir).where(F.length(F.coalesce("ingredients", F.lit(""))) > 0).select("product_id")
    r = b.reviews(spark, sf_dir)
    s = b.sales(spark, sf_dir)
    rv, sl = r.select("product_id"), s.select("product_id")
    ids = ls.set_ops(p, ing, "product_id")["intersect"]
    ids = ids.intersect(ls.set_ops(ing, rv, "product_id")["union"])
    ids = ids.intersect(ls.set_ops(rv, sl, "product_id")["union"])
    # fallbacks of the reference when the strict set is too small: relax to products with
    # reviews or sales, then to all products (scalar count checks)
    if ids.limit(10).count() < 10:
        ids = p.select("product_id").intersect(rv.union(sl).distinct())
        if ids.limit(5).count() < 5:
            ids = p.select("product_id")
    ra = ag.review_agg(r.select("product_id", "rating"), sentiment=None)
    sa = s.groupBy("product_id").agg(F.sum("units_sold").alias("total_units"))
    return (ids.join(p.select("product_id", "product_name", "brand", "category"), "product_id")
               .join(ra, "product_id", "left").join(sa, "product_id", "left")
               .fillna({"review_count": 0, "avg_rating": 0.0, "total_units": 0.0}))


@register("verified_products", sql=VERIFIED_SQL + " SELECT * FROM verified")
def q_verified_products(spark, sf_dir):
    return verified_frame(spark, sf_dir).select("product_id", "product_name", "brand", "category", "review_count",
                                                "avg_rating", "total_units")


@register("ml_ready_master", sql=VERIFIED_SQL + f"""
, seasons AS (SELECT product_id, season FROM (
    SELECT product_id, season, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, season) AS r FROM (
      SELECT product_id, CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
                              WHEN month IN (6, 7, 8, 9) THEN 'rainy' WHEN month IN (10, 11) THEN 'autumn'
                              ELSE 'unknown' END AS season, count(*) AS n FROM sales GROUP BY 1, 2)) WHERE r = 1),
mx AS (SELECT max(review_count) AS mr, max(total_units) AS ms FROM verified),
cat AS (SELECT category, dense_rank() OVER (ORDER BY category) - 1 AS category_code
        FROM (SELECT DISTINCT category FROM verified WHERE category IS NOT NULL))
SELECT v.product_id, coalesce(s.season, 'unknown') AS season,
       {b.rnd('CAST(0.4 AS DOUBLE) * coalesce(v.review_count / nullif(mx.mr, 0), 0.0) + CAST(0.6 AS DOUBLE) * coalesce(v.total_units / nullif(mx.ms, 0), 0.0)', 4)} AS popularity,
       c.category_code
FROM verified v CROSS JOIN mx LEFT JOIN seasons s USING (product_id) LEFT JOIN cat c USING (category)""")
def q_ml_ready_master(spark, sf_dir):
    v = verified_frame(spark, sf_dir)
    s = b.sales(spark, sf_dir).withColumn("season", tx.season(F.col("month")))
    seasons = ag.mode_per_group(s, "product_id", "season", out="season")
    pop = ts.popularity_score(v, reviews="review_count", sales="total_units")
    codes = dense_codes(v, "category", "category_code")
    out = (pop.join(seasons, "product_id", "left").join(codes, "category", "left")
              .fillna({"season": "unknown"}))
    return out.select("product_id", "season", "popularity", "category_code")


# ------------------------------------------------------------------ J04
@register("similar_lsh", sql=None)
def q_similar_lsh(spark, sf_dir):
    """Approximate J03: candidates of random-hyperplane tables, exact cosine, threshold, top 5."""
    from .q_similarity import weights_frame
    w, _ = weights_frame(spark, sf_dir)
    top = sim.top_neighbours(sim.lsh_pairs(w, top_n=5), 5)
    return top.select("product_id", "similar_id", "rank", F.round("sim", 6).alias("sim"))
