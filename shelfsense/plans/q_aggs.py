"""Queries: review/sales aggregates, distributions, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import binding as b
from ..functions import lexicons as L
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import text_analytics as ta
from .q_text import _boost_sql, _vote_sql
from .registry import register
from .sqlgen import clean_sql

SCORED_SQL = b.REVIEWS_SQL + f""",
rscored AS (
  SELECT review_id, product_id, rating, review_date, source, review_body,
         CASE WHEN coalesce(review_body, '') = '' THEN 0.0
              ELSE least(greatest({_boost_sql(clean_sql("coalesce(review_body, '')"))}, -0.9), 0.9) END AS comp,
         {_vote_sql("lower(coalesce(review_body, ''))", L.SKIN_VOTE_CLASSES, 'normal')} AS skin_type
  FROM reviews),
rscored2 AS (
  SELECT *, {b.rnd('comp', 3)} AS sentiment_score,
         CASE WHEN comp > 0.15 THEN 'positive' WHEN comp < -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment_label
  FROM rscored)"""


def scored_reviews(spark, sf_dir):
    r = b.reviews(spark, sf_dir)
    r = ta.sentiment_boost(r, "review_body")
    return ta.term_vote(r, "review_body")


@register("review_agg", sql=b.with_ctes(b.PRODUCTS_SQL, SCORED_SQL) + f"""
, g AS (SELECT product_id, count(*) AS review_count, {b.rnd('avg(rating)', 2)} AS avg_rating,
               {b.rnd('avg(sentiment_score)', 3)} AS sentiment_avg FROM rscored2 GROUP BY product_id)
SELECT p.product_id, coalesce(g.review_count, 0) AS review_count, coalesce(g.avg_rating, 0.0) AS avg_rating,
       coalesce(g.sentiment_avg, 0.0) AS sentiment_avg
FROM products p LEFT JOIN g USING (product_id)""")
def q_review_agg(spark, sf_dir):
    u = b.products(spark, sf_dir).select("product_id")
    return ag.review_agg(scored_reviews(spark, sf_dir), universe=u)


@register("sales_agg", sql=b.with_ctes(b.SALES_SQL) + f"""
SELECT product_id, sum(units_sold) AS total_units, {b.rnd('avg(units_sold)', 6)} AS mean_units
FROM sales GROUP BY product_id""")
def q_sales_agg(spark, sf_dir):
    s = ag.sales_agg(b.sales(spark, sf_dir))
    return s.withColumn("mean_units", F.round("mean_units", 6))


@register("rating_distribution", sql=b.with_ctes(b.REVIEWS_SQL) + """
SELECT product_id, """ + ", ".join(f"count_if(round(rating, 0) = {s}) AS star_{s}" for s in range(1, 6)) + """
FROM reviews GROUP BY product_id""")
def q_rating_distribution(spark, sf_dir):
    return ag.rating_distribution(b.reviews(spark, sf_dir))


@register("sentiment_distribution", sql=b.with_ctes(SCORED_SQL) + f"""
, g AS (SELECT product_id, count(*) AS n, count_if(sentiment_label = 'positive') AS n_positive,
               count_if(sentiment_label = 'negative') AS n_negative FROM rscored2 GROUP BY product_id)
SELECT product_id, n, n_positive, n_negative, n - n_positive - n_negative AS n_neutral,
       {b.rnd('100.0 * n_positive / n', 1)} AS pct_positive,
       {b.rnd('100.0 * (n - n_positive - n_negative) / n', 1)} AS pct_neutral,
       {b.rnd('100.0 * n_negative / n', 1)} AS pct_negative
FROM g""")
def q_sentiment_distribution(spark, sf_dir):
    return ag.sentiment_distribution(scored_reviews(spark, sf_dir))


SKIN_BY_SOURCE_SQL = b.with_ctes(SCORED_SQL) + """
, c AS (SELECT source, skin_type, count(*) AS n FROM rscored2 WHERE skin_type IS NOT NULL GROUP BY source, skin_type),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, skin_type) AS rank FROM c)
SELECT source, string_agg(skin_type || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rank) AS top_labels
FROM r WHERE rank <= 3 GROUP BY source"""


@register("skin_breakdown", sql=SKIN_BY_SOURCE_SQL)
def q_skin_breakdown(spark, sf_dir):
    return ag.skin_breakdown(scored_reviews(spark, sf_dir), keys="source")


@register("review_summary", sql=b.with_ctes(SCORED_SQL) + f"""
SELECT source, count(*) AS review_count, {b.rnd('avg(rating)', 2)} AS avg_rating,
       """ + ", ".join(f"count_if(round(rating, 0) = {s}) AS star_{s}" for s in range(1, 6)) + """,
       count_if(sentiment_label = 'positive') AS n_positive, count_if(sentiment_label = 'negative') AS n_negative,
       count_if(sentiment_label = 'neutral') AS n_neutral, count_if(rating IS NOT NULL) AS n_rated
FROM rscored2 GROUP BY source""")
def q_review_summary(spark, sf_dir):
    r = scored_reviews(spark, sf_dir)
    star = F.round(F.col("rating"), 0)
    return r.groupBy("source").agg(
        F.count(F.lit(1)).alias("review_count"), F.round(F.avg("rating"), 2).alias("avg_rating"),
        *[F.count_if(star == s).alias(f"star_{s}") for s in range(1, 6)],
        F.count_if(F.col("sentiment_label") == "positive").alias("n_positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("n_negative"),
        F.count_if(F.col("sentiment_label") == "neutral").alias("n_neutral"),
        F.count_if(F.col("rating").isNotNull()).alias("n_rated"))


@register("concat_agg", sql="""
WITH d AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag || l_linestatus, '; ' ORDER BY l_returnflag || l_linestatus)
                    AS status_set FROM lineitem GROUP BY l_partkey),
f AS (SELECT l_partkey, string_agg(CAST(l_orderkey AS VARCHAR), '. ' ORDER BY rn) AS first_orders FROM (
        SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn
        FROM lineitem) WHERE rn <= 5 GROUP BY l_partkey)
SELECT l_partkey, status_set, first_orders FROM d JOIN f USING (l_partkey)""")
def q_concat_agg(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").withColumn("st", F.concat("l_returnflag", "l_linestatus")) \
          .withColumn("ok", F.col("l_orderkey").cast("string"))
    d = ag.concat_distinct(li, "l_partkey", "st", "; ", "status_set")
    f = ag.concat_first(li.withColumn("ord", F.struct("l_shipdate", "l_orderkey", "l_linenumber")),
                        "l_partkey", "ok", "ord", 5, ". ", "first_orders")
    return d.join(f, "l_partkey")


@register("mode_per_group", sql=b.with_ctes(b.SALES_SQL) + """
, s AS (SELECT product_id, CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
                                WHEN month IN (6, 7, 8, 9) THEN 'rainy' WHEN month IN (10, 11) THEN 'autumn'
                                ELSE 'unknown' END AS season FROM sales),
c AS (SELECT product_id, season, count(*) AS n FROM s GROUP BY product_id, season)
SELECT product_id, season AS mode FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, season) AS r FROM c) WHERE r = 1""")
def q_mode_per_group(spark, sf_dir):
    s = b.sales(spark, sf_dir).withColumn("season", tx.season(F.col("month")))
    return ag.mode_per_group(s, "product_id", "season")


@register("value_counts", sql="""
SELECT p_type, count(*) AS n, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY p_type""")
def q_value_counts(spark, sf_dir):
    return ag.value_counts(b.table(spark, sf_dir, "part"), "p_type")


@register("histogram", sql="""
SELECT CAST(least(floor((l_extendedprice - 0.0) * 10 / (110000.0 - 0.0)) + 1, 10) AS BIGINT) AS bin, count(*) AS n
FROM lineitem WHERE l_extendedprice BETWEEN 0.0 AND 110000.0 GROUP BY 1""")
def q_histogram(spark, sf_dir):
    h = ag.histogram(b.table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 110000.0, 10)
    return h.withColumn("bin", F.col("bin").cast("long"))


@register("top_terms", sql="""
SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS term FROM documents)
WHERE length(term) >= 1 GROUP BY term ORDER BY n DESC, term LIMIT 20""")
def q_top_terms(spark, sf_dir):
    return ag.top_terms(b.table(spark, sf_dir, "documents"), "text", 20)


@register("missing_report", sql=b.with_ctes(b.REVIEWS_SQL) + """
, t AS (SELECT count(*) AS rows, """ + ", ".join(
    f"count_if({c} IS NULL) AS m_{c}" for c in ["review_id", "product_id", "source", "lang", "rating",
                                                 "review_body", "review_date"]) + """ FROM reviews)
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", m_{c} AS missing, rows FROM t" for c in
    ["review_id", "product_id", "source", "lang", "rating", "review_body", "review_date"]) + f""")
""")
def q_missing_report(spark, sf_dir):
    m = ag.missing_report(b.reviews(spark, sf_dir), "reviews")
    return m.select("column", "missing", "rows")


@register("score_percentiles", sql="""
WITH s AS (SELECT CAST(l_discount AS DOUBLE) AS x FROM lineitem)
SELECT """ + ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{int(round(p * 100))}"
                       for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + """,
       round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max FROM s""")
def q_score_percentiles(spark, sf_dir):
    s = ag.score_percentiles(b.table(spark, sf_dir, "lineitem"), "l_discount")
    return s.select(*[F.round(c, 6).alias(c) if c not in ("min", "max") else F.col(c) for c in s.columns])


@register("diversity_ratio", sql=b.with_ctes(b.REVIEWS_SQL) + f"""
, d AS (SELECT sum(n - 1) AS dup_within_product FROM (SELECT product_id, review_body, count(*) AS n FROM reviews
                                                       GROUP BY product_id, review_body))
SELECT count(*) AS total, count(DISTINCT review_body) AS distinct_bodies, max(d.dup_within_product) AS dup_within_product,
       count(DISTINCT review_body) / count(*) AS diversity
FROM reviews, d""")
def q_diversity_ratio(spark, sf_dir):
    return ag.diversity_ratio(b.reviews(spark, sf_dir), "review_body")


@register("drop_duplicates", sql="""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def q_drop_duplicates(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ag.drop_duplicates_keyed(d, "text", [F.col("doc_id")]).select("doc_id")


@register("exact_dedup_count", sql="""
SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM conversations)) AS rows_after
FROM conversations""")
def q_exact_dedup_count(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations")
    return c.agg(F.count(F.lit(1)).alias("rows_before")).crossJoin(
        c.dropDuplicates().agg(F.count(F.lit(1)).alias("rows_after")))
