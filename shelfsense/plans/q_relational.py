"""Queries: listing, search, paging, top-k, joins, sorts and set operations
(SURVEY C01-C04, C07-C11, D01-D05, D07-D09, D11, J08, L01-L04)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import binding as b
from ..operators import joins as jn
from ..operators import listing as ls
from .q_stock import STOCK_RISK_CASES, STOCK_SQL, STOCK_STATUS_CASES, stock_frame
from .registry import register
from .sqlgen import q

STOCK_COLS_SQL = f"""stockc AS (SELECT dealer_id, product_id, {STOCK_STATUS_CASES} AS stock_status,
                        {STOCK_RISK_CASES} AS stockout_risk FROM stock)"""


def _analysis(spark, sf_dir):
    return stock_frame(spark, sf_dir).select("dealer_id", "product_id", "stock_status", "stockout_risk",
                                             F.lit("none").alias("risk_level"))


@register("product_list", sql=b.with_ctes(STOCK_SQL) + ", " + STOCK_COLS_SQL + """,
f AS (SELECT tp.dealer_id, tp.product_id, tp.product_name, tp.category, s.stock_status
      FROM tenant_products tp LEFT JOIN stockc s USING (dealer_id, product_id)
      WHERE tp.category = 'PROMO' AND tp.product_name ILIKE '%gear%' AND s.stock_status IN ('overstock', 'watch'))
SELECT dealer_id, product_id, product_name, category, stock_status, (SELECT count(*) FROM f) AS total
FROM f ORDER BY dealer_id, product_id LIMIT 20 OFFSET 20""")
def q_product_list(spark, sf_dir):
    tp = b.tenant_products(spark, sf_dir).select("dealer_id", "product_id", "product_name", "category")
    inv = b.inventory(spark, sf_dir).select("dealer_id", "product_id", "current_stock")
    out = ls.product_list(tp, _analysis(spark, sf_dir), inv, category="PROMO", name_like="gear",
                          stock_status=["overstock", "watch"], page=2, page_size=20)
    return out.select("dealer_id", "product_id", "product_name", "category", "stock_status", "total")


@register("search_products", sql="""
SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand FROM part
WHERE contains(lower(p_name), 'gear') OR contains(lower(p_brand), 'gear')""")
def q_search_products(spark, sf_dir):
    p = b.products(spark, sf_dir)
    return ls.search_products(p, "Gear", ["product_name", "brand"]).select("product_id", "product_name", "brand")


@register("review_list", sql=b.with_ctes(b.PRODUCTS_SQL, b.REVIEWS_SQL) + """,
own AS (SELECT r.product_id AS for_product, r.product_id, r.review_id, r.review_date, r.rating, false AS fallback
        FROM reviews r WHERE r.product_id IN (SELECT product_id FROM products)),
with_rev AS (SELECT DISTINCT product_id FROM reviews),
empties AS (SELECT product_id, category FROM products WHERE product_id NOT IN (SELECT product_id FROM with_rev)),
peers AS (SELECT * FROM (SELECT product_id AS peer, category,
                                row_number() OVER (PARTITION BY category ORDER BY product_id) AS pr
                         FROM products WHERE product_id IN (SELECT product_id FROM with_rev)) WHERE pr <= 20),
fb AS (SELECT e.product_id AS for_product, r.product_id, r.review_id, r.review_date, r.rating, true AS fallback
       FROM empties e JOIN peers p ON e.category = p.category JOIN reviews r ON r.product_id = p.peer),
a AS (SELECT * FROM own UNION ALL SELECT * FROM fb)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY for_product ORDER BY review_date DESC, review_id DESC)
                              AS INTEGER) AS rank FROM a) WHERE rank <= 10""")
def q_review_list(spark, sf_dir):
    p = b.products(spark, sf_dir).select("product_id", "category")
    r = b.reviews(spark, sf_dir)
    out = ls.review_list(r, p)
    return out.select("for_product", "product_id", "review_id", "review_date", "rating", "fallback", "rank")


@register("recent_reviews", sql=b.with_ctes(b.REVIEWS_SQL) + """
SELECT * FROM (SELECT product_id, review_id, review_date,
  CAST(row_number() OVER (PARTITION BY product_id ORDER BY review_date DESC, review_id DESC) AS INTEGER) AS rank
  FROM reviews) WHERE rank <= 10""")
def q_recent_reviews(spark, sf_dir):
    r = b.reviews(spark, sf_dir).select("product_id", "review_id", "review_date")
    return ls.recent_reviews(r)


@register("top_n_by_total", sql="""
WITH t AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 5)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM t)""")
def q_top_n_by_total(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ls.top_n_by_total(li, "l_partkey", "l_quantity", 5).drop("l_quantity")


@register("min_class_count", sql="""
SELECT c_custkey, c_nationkey FROM customer
WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) >= 65)""")
def q_min_class_count(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return ls.min_class_count(c, "c_nationkey", 65)


@register("outlier_trim", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)""")
def q_outlier_trim(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ls.outlier_trim(li, "l_extendedprice", 0.99)


@register("valid_reviews", sql="""
SELECT doc_id FROM documents
WHERE length(coalesce(text, '')) >= 20 AND NOT regexp_matches(trim(coalesce(text, '')), '^[0-9\\s.,]+$')""")
def q_valid_reviews(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return ls.valid_reviews(d, "text").select("doc_id")


@register("sample_rows", sql="""
SELECT 'every_k' AS method, o_orderkey FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0 AND i < 7000
UNION ALL
SELECT 'seeded', o_orderkey FROM (SELECT o_orderkey FROM orders
                                  ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 50)
UNION ALL
SELECT 'head', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)""")
def q_sample_rows(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select("o_orderkey")
    return (ls.sample_every_k(o, "o_orderkey", 7, cap=1000).select(F.lit("every_k").alias("method"), "o_orderkey")
              .unionByName(ls.sample_seeded(o, "o_orderkey", 50).select(F.lit("seeded").alias("method"), "o_orderkey"))
              .unionByName(ls.head_n(o, "o_orderkey", 10).select(F.lit("head").alias("method"), "o_orderkey")))


@register("product_analysis_join", sql=b.with_ctes(STOCK_SQL) + ", " + STOCK_COLS_SQL + """
SELECT tp.product_id, tp.dealer_id, tp.category, s.stock_status
FROM tenant_products tp JOIN stockc s USING (dealer_id, product_id)""")
def q_product_analysis_join(spark, sf_dir):
    tp = b.tenant_products(spark, sf_dir).select("product_id", "dealer_id", "category")
    return jn.product_analysis_join(tp, _analysis(spark, sf_dir).select("dealer_id", "product_id", "stock_status"))


@register("product_left_join", sql=b.with_ctes(b.INVENTORY_SQL) + """
SELECT tp.product_id, tp.dealer_id, coalesce(i.current_stock, 50.0) AS current_stock,
       coalesce(i.lead_time_days, 14.0) AS lead_time_days
FROM tenant_products tp LEFT JOIN (SELECT * FROM inventory WHERE current_stock > 100) i USING (product_id, dealer_id)""")
def q_product_left_join(spark, sf_dir):
    tp = b.tenant_products(spark, sf_dir).select("product_id", "dealer_id")
    inv = b.inventory(spark, sf_dir).where(F.col("current_stock") > 100).select(
        "product_id", "dealer_id", "current_stock", "lead_time_days")
    return jn.product_left_join(tp, inv)


@register("label_join", sql=b.with_ctes(b.PRODUCTS_SQL, b.REVIEWS_SQL) + """
SELECT r.review_id, r.product_id, p.category FROM reviews r JOIN products p USING (product_id)""")
def q_label_join(spark, sf_dir):
    r = b.reviews(spark, sf_dir).select("review_id", "product_id")
    p = b.products(spark, sf_dir).select("product_id", "category")
    return jn.label_join(r, p)


@register("products_without_reviews", sql=b.with_ctes(b.REVIEWS_SQL) + """
SELECT p_partkey AS product_id FROM part WHERE p_partkey NOT IN (SELECT product_id FROM reviews)""")
def q_products_without_reviews(spark, sf_dir):
    p = b.products(spark, sf_dir).select("product_id")
    return jn.without_match(p, b.reviews(spark, sf_dir), "product_id")


@register("referential_check", sql=b.with_ctes(b.REVIEWS_SQL) + f"""
, j AS (SELECT r.product_id, p.p_partkey FROM reviews r
        LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) p ON r.product_id = p.p_partkey)
SELECT count_if(p_partkey IS NOT NULL) AS ok, count_if(p_partkey IS NULL) AS orphan, count(*) AS total,
       {b.rnd('count_if(p_partkey IS NOT NULL) / greatest(count(*), 1)', 4)} AS match_rate
FROM j""")
def q_referential_check(spark, sf_dir):
    r = b.reviews(spark, sf_dir)
    p = b.products(spark, sf_dir).where(F.col("size") <= 40)
    return jn.referential_check(r, p, "product_id")


WORDS_SQL = ("list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), "
             "lambda t: length(t) > 2 AND NOT list_contains({sw}, t)))")


@register("name_match_join", sql=f"""
WITH l AS (SELECT p_partkey, p_name FROM part),
r AS (SELECT p_partkey - 1 AS p_partkey, p_name AS other_name FROM part),
j AS (SELECT l.p_partkey, l.p_name, r.other_name,
             CAST(len(list_intersect({WORDS_SQL.format(x='l.p_name', sw='$SW')}, {WORDS_SQL.format(x='r.other_name', sw='$SW')}))
                  AS INTEGER) AS shared_words
      FROM l JOIN r USING (p_partkey))
SELECT p_partkey, shared_words, shared_words >= 2 AS accepted FROM j""".replace(
    "$SW", "[" + ", ".join(q(w) for w in __import__("shelfsense.functions.lexicons", fromlist=["x"]).STOPWORDS) + "]"))
def q_name_match_join(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    left = p.select("p_partkey", "p_name")
    right = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other_name"))
    return jn.name_match_join(left, right, "p_partkey", "p_name", "other_name").select(
        "p_partkey", "shared_words", "accepted")


@register("orphan_relink", sql=b.with_ctes(b.REVIEWS_SQL) + """
, v AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS j FROM part WHERE p_size <= 40),
o AS (SELECT review_id, row_number() OVER (ORDER BY review_id) - 1 AS i FROM reviews
      WHERE product_id NOT IN (SELECT p_partkey FROM v))
SELECT o.review_id, v.p_partkey AS new_product_id FROM o JOIN v ON v.j = o.i % (SELECT count(*) FROM v)""")
def q_orphan_relink(spark, sf_dir):
    r = b.reviews(spark, sf_dir)
    valid = b.products(spark, sf_dir).where(F.col("size") <= 40)
    orphans = r.join(valid.select("product_id"), "product_id", "left_anti").select("review_id")
    return jn.orphan_relink(orphans, valid, "review_id", "product_id").select("review_id", "new_product_id")


@register("fuzzy_match", sql=f"""
WITH qq AS (SELECT p_partkey, lower(trim(replace(p_name, 'e', 'a'))) AS q FROM part),
nn AS (SELECT DISTINCT p_name AS match_name, lower(trim(p_name)) AS n FROM part),
dq AS (SELECT DISTINCT q FROM qq),
j AS (SELECT q, match_name, 1 - levenshtein(q, n) / greatest(length(q), length(n), 1) AS match_score FROM dq CROSS JOIN nn),
top AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY q ORDER BY match_score DESC, match_name) = 1)
SELECT p_partkey, match_name, {b.rnd('match_score', 6)} AS match_score FROM qq JOIN top USING (q)""")
def q_fuzzy_match(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    queries = p.select("p_partkey", F.regexp_replace("p_name", "e", "a").alias("q_name"))
    names = p.select(F.col("p_name").alias("name_id"), "p_name").distinct()
    m = jn.fuzzy_match(queries, names, "p_partkey", "q_name", "name_id", "p_name")
    return m.select("p_partkey", "match_name", F.round("match_score", 6).alias("match_score"))


@register("backfill_join", sql=b.with_ctes(b.REVIEWS_SQL) + """
, s AS (SELECT avg(CAST(rating IS NULL AS DOUBLE)) AS share FROM reviews)
SELECT r.review_id, CASE WHEN s.share > 0.5 THEN CAST(p.p_size AS DOUBLE) / 10.0 ELSE r.rating END AS rating
FROM reviews r CROSS JOIN s LEFT JOIN part p ON p.p_partkey = r.product_id""")
def q_backfill_join(spark, sf_dir):
    r = b.reviews(spark, sf_dir).select("review_id", "product_id", "rating")
    other = b.products(spark, sf_dir).select("product_id", (F.col("size").cast("double") / 10.0).alias("rating"))
    return jn.backfill_join(r, other, "product_id", "rating").select("review_id", "rating")


@register("name_lookup", sql="""
WITH qs AS (SELECT p_partkey + (p_partkey % 2) * 1000000 AS q_key, upper(p_name) AS q_name FROM part),
byname AS (SELECT lower(trim(p_name)) AS nm, min(p_partkey) AS hit FROM part GROUP BY 1)
SELECT qs.q_key, coalesce(p.p_partkey, byname.hit) AS resolved_id
FROM qs LEFT JOIN part p ON p.p_partkey = qs.q_key LEFT JOIN byname ON lower(trim(qs.q_name)) = byname.nm""")
def q_name_lookup(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    qs = p.select((F.col("p_partkey") + F.pmod("p_partkey", F.lit(2)) * 1000000).alias("q_key"),
                  F.upper("p_name").alias("q_name"))
    return jn.name_lookup(qs, p, "q_key", "q_name", "p_partkey", "p_name").select("q_key", "resolved_id")


@register("nulls_last_sort", sql=b.with_ctes(b.REVIEWS_SQL) + """
SELECT review_id, rating, row_number() OVER (ORDER BY rating DESC NULLS LAST, review_id) - 1 AS position
FROM reviews""")
def q_nulls_last_sort(spark, sf_dir):
    r = b.reviews(spark, sf_dir).select("review_id", "rating")
    return ls.ranked_sort(r, [F.col("rating").desc_nulls_last(), F.col("review_id")])


@register("multi_key_sort", sql="""
SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey DESC) - 1
  AS position FROM customer""")
def q_multi_key_sort(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    s = ls.ranked_sort(c, [F.col("c_nationkey").desc(), F.col("c_acctbal").desc(), F.col("c_custkey").desc()])
    return s.select("c_custkey", "c_nationkey", "position")


@register("set_ops", sql="""
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1995),
bb AS (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 2001)
SELECT 'intersect' AS op, l_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM bb)
UNION ALL SELECT 'union', l_partkey FROM (SELECT * FROM a UNION SELECT * FROM bb)
UNION ALL SELECT 'difference', l_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM bb)""")
def q_set_ops(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    a = li.where(F.year("l_shipdate") == 1995)
    bb = li.where(F.year("l_shipdate") == 2001)
    res = ls.set_ops(a, bb, "l_partkey")
    out = None
    for name, df in res.items():
        d = df.select(F.lit(name).alias("op"), "l_partkey")
        out = d if out is None else out.unionByName(d)
    return out


@register("union_dedup_priority", sql="""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_retailprice FROM part),
nb AS (SELECT p_partkey, lag(p_partkey, 1) OVER w AS c1, lead(p_partkey, 1) OVER w AS c2
       FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)),
nt AS (SELECT p_partkey, lag(p_partkey, 1) OVER w AS c1, lead(p_partkey, 1) OVER w AS c2
       FROM p WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice, p_partkey)),
u AS (SELECT p_partkey, c1 AS candidate, 1 AS prio FROM nb UNION ALL SELECT p_partkey, c2, 1 FROM nb
      UNION ALL SELECT p_partkey, c1, 2 FROM nt UNION ALL SELECT p_partkey, c2, 2 FROM nt)
SELECT p_partkey, candidate, min(prio) AS source_priority FROM u WHERE candidate IS NOT NULL
GROUP BY p_partkey, candidate""")
def q_union_dedup_priority(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")

    def neighbours(group):
        w = Window.partitionBy(group).orderBy("p_retailprice", "p_partkey")
        n = p.select("p_partkey", F.lag("p_partkey", 1).over(w).alias("c1"), F.lead("p_partkey", 1).over(w).alias("c2"))
        return n.select("p_partkey", F.explode(F.array("c1", "c2")).alias("candidate")).where(F.col("candidate").isNotNull())
    out = ls.union_dedup_priority([(1, neighbours("p_brand")), (2, neighbours("p_type"))], "p_partkey", "candidate")
    return out.select("p_partkey", "candidate", "source_priority")
