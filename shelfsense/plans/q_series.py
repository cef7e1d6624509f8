"""Queries: weekly demand, dense series, window features, splits, trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import binding as b
from ..operators import timeseries as ts
from ..operators.ordering import dense_codes
from .q_stock import SERIES_SQL, series_frame
from .registry import register
from .sqlgen import md5_mod_sql

WEEKLY_SQL = b.SALES_SQL + """,
weekly AS (
  SELECT product_id, CAST(date_trunc('week', sale_date) AS DATE) + 6 AS week_end, sum(units_sold) AS units
  FROM sales WHERE sale_date IS NOT NULL AND units_sold IS NOT NULL AND units_sold >= 0 GROUP BY 1, 2)"""

DENSE_SQL = WEEKLY_SQL + """,
span AS (SELECT product_id, min(week_end) AS lo, max(week_end) AS hi FROM weekly GROUP BY 1),
spine AS (SELECT product_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                                         INTERVAL 7 DAY)) AS DATE) AS week_end FROM span),
dense AS (SELECT s.product_id, s.week_end, coalesce(w.units, 0.0) AS units
          FROM spine s LEFT JOIN weekly w USING (product_id, week_end))"""

W = "OVER (PARTITION BY product_id ORDER BY week_end)"


def weekly(spark, sf_dir):
    return ts.weekly_demand(b.sales(spark, sf_dir))


def dense(spark, sf_dir):
    return ts.weekly_dense(weekly(spark, sf_dir))


@register("weekly_demand", sql=b.with_ctes(WEEKLY_SQL) + "SELECT product_id, week_end, units FROM weekly")
def q_weekly_demand(spark, sf_dir):
    return weekly(spark, sf_dir)


@register("weekly_dense", sql=b.with_ctes(DENSE_SQL) + "SELECT product_id, week_end, units FROM dense")
def q_weekly_dense(spark, sf_dir):
    return dense(spark, sf_dir)


@register("weekly_dense_observed", sql=b.with_ctes(WEEKLY_SQL) + """
, wk AS (SELECT DISTINCT week_end FROM weekly), pr AS (SELECT DISTINCT product_id FROM weekly)
SELECT pr.product_id, wk.week_end, coalesce(w.units, 0.0) AS units
FROM pr CROSS JOIN wk LEFT JOIN weekly w ON w.product_id = pr.product_id AND w.week_end = wk.week_end""")
def q_weekly_dense_observed(spark, sf_dir):
    # products x observed weeks by definition; the week list is bounded by the
    # calendar span of the data and is the broadcast side
    return ts.weekly_dense(weekly(spark, sf_dir), calendar=False)


@register("weekly_pivot", sql=b.with_ctes(WEEKLY_SQL) + """
, top AS (SELECT product_id, row_number() OVER (ORDER BY sum(units) DESC, product_id) AS rank
          FROM weekly GROUP BY product_id ORDER BY sum(units) DESC, product_id LIMIT 5)
SELECT week_end, """ + ", ".join(f"coalesce(sum(CASE WHEN rank = {r} THEN units END), 0.0) AS r{r}" for r in range(1, 6)) + """
FROM weekly JOIN top USING (product_id) GROUP BY week_end""")
def q_weekly_pivot(spark, sf_dir):
    w = weekly(spark, sf_dir)
    tot = w.groupBy("product_id").agg(F.sum("units").alias("t")).orderBy(F.desc("t"), "product_id").limit(5)
    # 5 rows after the limit: the rank window runs over the top list only
    top = tot.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("t"), "product_id")))
    j = w.join(F.broadcast(top.select("product_id", "rank")), "product_id")
    p = ts.weekly_pivot(j, product="rank", products=[1, 2, 3, 4, 5])
    return p.toDF("week_end", *[f"r{r}" for r in range(1, 6)])


@register("lag_features", sql=b.with_ctes(DENSE_SQL) + f"""
SELECT * FROM (SELECT product_id, week_end, units, lag(units, 1) {W} AS lag_1, lag(units, 2) {W} AS lag_2,
                      lag(units, 4) {W} AS lag_4, lag(units, 8) {W} AS lag_8 FROM dense)
WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_4 IS NOT NULL AND lag_8 IS NOT NULL""")
def q_lag_features(spark, sf_dir):
    return ts.lag_features(dense(spark, sf_dir))


def _r6(c):
    return F.round(c, 6)


@register("rolling_features", sql=b.with_ctes(DENSE_SQL) + f"""
SELECT product_id, week_end,
  {b.rnd(f'avg(units) OVER (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_mean_4,
  {b.rnd(f'stddev_samp(units) OVER (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_std_4,
  {b.rnd(f'avg(units) OVER (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_mean_8,
  {b.rnd(f'stddev_samp(units) OVER (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)', 6)} AS rolling_std_8
FROM dense""")
def q_rolling_features(spark, sf_dir):
    r = ts.rolling_features(dense(spark, sf_dir))
    return r.select("product_id", "week_end", *[_r6(F.col(c)).alias(c) for c in
                                                ("rolling_mean_4", "rolling_std_4", "rolling_mean_8", "rolling_std_8")])


@register("trend_feature", sql=b.with_ctes(DENSE_SQL) + f"""
SELECT product_id, week_end, lag(units, 1) {W} - lag(units, 4) {W} AS trend_4 FROM dense""")
def q_trend_feature(spark, sf_dir):
    f = ts.lag_features(dense(spark, sf_dir), lags=(1, 4), drop_incomplete=False)
    return ts.trend_feature(f).select("product_id", "week_end", "trend_4")


@register("expanding_mean", sql=b.with_ctes(DENSE_SQL) + f"""
SELECT product_id, week_end,
  {b.rnd('avg(units) OVER (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 6)}
    AS expanding_mean FROM dense""")
def q_expanding_mean(spark, sf_dir):
    e = ts.expanding_mean(dense(spark, sf_dir))
    return e.select("product_id", "week_end", _r6(F.col("expanding_mean")).alias("expanding_mean"))


@register("forecast_feature_table", sql=b.with_ctes(DENSE_SQL) + f"""
, cat AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS category_code
          FROM (SELECT DISTINCT p_type FROM part)),
p AS (SELECT p_partkey AS product_id, p_retailprice / 10000.0 AS price_scaled,
             {md5_mod_sql('CAST(p_partkey AS VARCHAR)', 1000)} / 1000.0 AS product_hash, category_code
      FROM part JOIN cat USING (p_type)),
f AS (SELECT product_id, week_end, units, lag(units, 1) {W} AS lag_1, lag(units, 2) {W} AS lag_2,
             lag(units, 4) {W} AS lag_4, lag(units, 8) {W} AS lag_8,
             avg(units) OVER (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rm4
      FROM dense)
SELECT product_id, week_end, units, lag_1, lag_2, lag_4, lag_8, {b.rnd('rm4', 6)} AS rolling_mean_4,
       lag_1 - lag_4 AS trend_4, CAST(month(week_end) AS INTEGER) AS month, CAST(week(week_end) AS INTEGER) AS week_of_year,
       CAST(quarter(week_end) AS INTEGER) AS quarter, CAST(quarter(week_end) = 4 AS INTEGER) AS is_holiday_season,
       price_scaled, product_hash, category_code
FROM f JOIN p USING (product_id)
WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_4 IS NOT NULL AND lag_8 IS NOT NULL""")
def q_forecast_feature_table(spark, sf_dir):
    prods = dense_codes(b.products(spark, sf_dir), "category", "category_code")
    prods = b.products(spark, sf_dir).join(prods, "category")
    f = ts.forecast_feature_table(dense(spark, sf_dir), prods)
    return f.select("product_id", "week_end", "units", "lag_1", "lag_2", "lag_4", "lag_8",
                    _r6(F.col("rolling_mean_4")).alias("rolling_mean_4"), "trend_4", "month", "week_of_year",
                    "quarter", "is_holiday_season", "price_scaled", "product_hash", "category_code")


@register("recent_sales_tail", sql=b.with_ctes(b.SALES_SQL) + """
, r AS (SELECT product_id, units_sold, row_number() OVER (PARTITION BY product_id
                 ORDER BY sale_date DESC, order_id DESC, line_no DESC) AS rn FROM sales),
t AS (SELECT product_id, sum(units_sold) AS total_units, count(*) AS n_obs FROM sales GROUP BY product_id)
SELECT t.product_id, total_units, n_obs,
       string_agg(CAST(units_sold AS VARCHAR), ',' ORDER BY rn DESC) AS recent_sales
FROM t JOIN r USING (product_id) WHERE rn <= 12 GROUP BY t.product_id, total_units, n_obs""")
def q_recent_sales_tail(spark, sf_dir):
    s = b.sales(spark, sf_dir).withColumn("ol", F.struct("order_id", "line_no"))
    t = ts.recent_sales_tail(s, tie="ol")
    return t.select("product_id", "total_units", "n_obs",
                    F.array_join(F.transform("recent_sales", lambda x: x.cast("string")), ",").alias("recent_sales"))


HIST_SQL = SERIES_SQL + """,
hist AS (SELECT dealer_id, product_id, list(units ORDER BY slot) AS h FROM series GROUP BY dealer_id, product_id),
hm AS (SELECT dealer_id, product_id, h, list_reduce([0.0] || h, lambda a, x: a + x) / len(h) AS m FROM hist)"""


def hist_frame(spark, sf_dir):
    return series_frame(spark, sf_dir).withColumnRenamed("monthly_sales", "history")


@register("forecast_baseline", sql=b.with_ctes(HIST_SQL) + f"""
SELECT dealer_id, product_id, CAST(i AS INTEGER) AS step, {b.rnd('m * (1 + CAST(0.03 AS DOUBLE) * i)', 1)} AS forecast
FROM hm, range(7) t(i)""")
def q_forecast_baseline(spark, sf_dir):
    f = ts.forecast_baseline(hist_frame(spark, sf_dir))
    return ts.explode_series(f, ["dealer_id", "product_id"], "forecast", "step", "forecast")


@register("demand_change", sql=b.with_ctes(HIST_SQL) + f"""
, f AS (SELECT dealer_id, product_id, h, m, {b.rnd('m * (1 + CAST(0.03 AS DOUBLE) * 6)', 1)} AS last_f FROM hm),
c AS (SELECT dealer_id, product_id, m, last_f, (last_f - h[12]) / greatest(1.0, h[12]) * 100.0 AS pct FROM f)
SELECT dealer_id, product_id, {b.rnd('pct', 6)} AS demand_change_pct,
       CASE WHEN pct > 2 THEN 'increasing' WHEN pct < -2 THEN 'decreasing' ELSE 'stable' END AS trend,
       CASE WHEN last_f > m * (1 + CAST(0.1 AS DOUBLE)) THEN 'upward'
            WHEN last_f < m * (1 - CAST(0.1 AS DOUBLE)) THEN 'downward' ELSE 'stable' END AS pattern
FROM c""")
def q_demand_change(spark, sf_dir):
    f = ts.forecast_baseline(hist_frame(spark, sf_dir))
    d = ts.demand_change(f)
    return d.select("dealer_id", "product_id", _r6(F.col("demand_change_pct")).alias("demand_change_pct"),
                    "trend", "pattern")


@register("volatility", sql=b.with_ctes(HIST_SQL) + f"""
, v AS (SELECT dealer_id, product_id,
               sqrt(list_reduce([0.0] || [(x - m) * (x - m) for x in h], lambda a, x: a + x) / len(h))
                 / greatest(1.0, m) AS cv FROM hm)
SELECT dealer_id, product_id, {b.rnd('cv', 6)} AS cv,
       CASE WHEN cv > 0.4 THEN 'high' WHEN cv > 0.15 THEN 'medium' ELSE 'low' END AS volatility,
       {b.rnd('least(99.0, greatest(10.0, 95.0 - 25.0 * cv))', 6)} AS confidence_score
FROM v""")
def q_volatility(spark, sf_dir):
    v = ts.volatility(hist_frame(spark, sf_dir))
    return v.select("dealer_id", "product_id", _r6(F.col("cv")).alias("cv"), "volatility",
                    _r6(F.col("confidence_score")).alias("confidence_score"))


@register("popularity_score", sql=b.with_ctes(b.REVIEWS_SQL, b.SALES_SQL) + f"""
, rc AS (SELECT product_id, count(*) AS review_count FROM reviews GROUP BY 1),
sc AS (SELECT product_id, sum(units_sold) AS total_sales FROM sales GROUP BY 1),
j AS (SELECT p_partkey AS product_id, coalesce(review_count, 0) AS review_count, coalesce(total_sales, 0.0) AS total_sales
      FROM part LEFT JOIN rc ON rc.product_id = p_partkey LEFT JOIN sc ON sc.product_id = p_partkey),
mx AS (SELECT max(review_count) AS mr, max(total_sales) AS ms FROM j)
SELECT product_id, review_count, total_sales,
       {b.rnd('CAST(0.4 AS DOUBLE) * coalesce(review_count / nullif(mr, 0), 0.0) + CAST(0.6 AS DOUBLE) * coalesce(total_sales / nullif(ms, 0), 0.0)', 4)} AS popularity
FROM j, mx""")
def q_popularity_score(spark, sf_dir):
    rc = b.reviews(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("review_count"))
    sc = b.sales(spark, sf_dir).groupBy("product_id").agg(F.sum("units_sold").alias("total_sales"))
    j = (b.products(spark, sf_dir).select("product_id").join(rc, "product_id", "left").join(sc, "product_id", "left")
         .fillna({"review_count": 0, "total_sales": 0.0}))
    return ts.popularity_score(j)


@register("chronological_split", sql=b.with_ctes(DENSE_SQL) + f"""
SELECT product_id, week_end,
       CASE WHEN row_number() {W} <= floor(count(*) OVER (PARTITION BY product_id) * CAST(0.8 AS DOUBLE))
            THEN 'train' ELSE 'test' END AS split
FROM dense""")
def q_chronological_split(spark, sf_dir):
    return ts.chronological_split(dense(spark, sf_dir)).select("product_id", "week_end", "split")


@register("stratified_split", sql="""
SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality
         ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * CAST(0.2 AS DOUBLE))
       THEN 'test' ELSE 'train' END AS split
FROM labels""")
def q_stratified_split(spark, sf_dir):
    lb = b.table(spark, sf_dir, "labels")
    return ts.stratified_split(lb, "quality", "doc_id").select("doc_id", "quality", "split")


@register("trend_label", sql=b.with_ctes(DENSE_SQL) + f"""
, x AS (SELECT product_id, units, CAST(date_diff('day', DATE '1970-01-05', week_end) / 7 AS DOUBLE) AS week_idx FROM dense),
s AS (SELECT product_id, regr_slope(units, week_idx) / nullif(avg(units), 0) AS rel_slope FROM x GROUP BY product_id)
SELECT product_id, {b.rnd('rel_slope', 6)} AS rel_slope,
       CASE WHEN rel_slope > 0.015 THEN 'strong_growth' WHEN rel_slope > 0.004 THEN 'moderate_growth'
            WHEN rel_slope >= -0.004 THEN 'stable' WHEN rel_slope >= -0.015 THEN 'moderate_decline'
            ELSE 'strong_decline' END AS trend_label
FROM s""")
def q_trend_label(spark, sf_dir):
    d = dense(spark, sf_dir).withColumn("week_idx", (F.datediff("week_end", F.lit("1970-01-05")) / 7).cast("double"))
    t = ts.trend_label(d)
    return t.select("product_id", _r6(F.col("rel_slope")).alias("rel_slope"), "trend_label")
