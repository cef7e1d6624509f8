"""Queries: projections, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import binding as b
from ..functions import lexicons as L
from ..functions import text as tx
from ..operators import cleaning as cl
from .registry import register
from .sqlgen import clean_sql, md5_mod_sql, q, strip_sql

STOP_SQL = "[" + ", ".join(q(w) for w in L.STOPWORDS) + "]"
LANG_ALIASES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
FIRST_TERMS = ["license", "apache", "mit", "token"]
TEST_PROFILES = {"PROMO": (11, 0.3), "SMALL": (6, 0.2), "default": (6, 0.0)}


def _items_sql(expr: str, pattern: str = "[,;\\n\\r]+") -> str:
    return (f"list_filter([lower({strip_sql('x')}) for x in string_split_regex({expr}, '{pattern}')], "
            f"lambda x: x <> '')")


@register("normalise_headers", sql="SELECT p_partkey, p_name, p_brand, p_type FROM part")
def q_normalise_headers(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return cl.normalise_headers(p.toDF(" P_PartKey", "P-Name", "p/brand", "P  Type!"))


@register("null_sentinels", sql=f"""
SELECT conv_id, turn,
  CASE WHEN lower({strip_sql('role')}) IN ({', '.join(q(s) for s in L.NULL_SENTINELS)}) THEN NULL ELSE role END AS role,
  CASE WHEN lower({strip_sql('text')}) IN ({', '.join(q(s) for s in L.NULL_SENTINELS)}) THEN NULL ELSE text END AS text
FROM conversations""")
def q_null_sentinels(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations")
    return cl.null_sentinels(c, ["role", "text"])


@register("unify_aliases", sql="SELECT doc_id, text AS review_text, source AS brand FROM documents")
def q_unify_aliases(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("review"),
                                                   F.col("source").alias("company"))
    return cl.unify_aliases(d)


@register("normalise_text", sql=f"""
SELECT doc_id, regexp_replace(lower({strip_sql('text')}), '\\s+', ' ', 'g') AS text FROM documents""")
def q_normalise_text(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.normalise_text(F.col("text")).alias("text"))


@register("clean_text", sql=f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def q_clean_text(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@register("tokenise_stopwords", sql=f"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '([a-zA-Z]+)', 1),
                                           lambda t: NOT list_contains({STOP_SQL}, t) AND length(t) >= 3), ' ')
         AS tokens
FROM documents""")
def q_tokenise_stopwords(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.tokenise_stopwords(F.col("text")).alias("tokens"))


@register("parse_list", sql=f"""
WITH p AS (SELECT doc_id, {_items_sql('text')} AS items FROM documents)
SELECT doc_id, CAST(len(items) AS INTEGER) AS n_items, array_to_string(items, '|') AS items FROM p""")
def q_parse_list(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    it = tx.ingredient_items(F.col("text"))
    return d.select("doc_id", F.size(it).alias("n_items"), F.array_join(it, "|").alias("items"))


@register("dedup_list", sql=f"""
WITH p AS (SELECT doc_id, {_items_sql('text')} AS items FROM documents),
k AS (SELECT doc_id, items, [{strip_sql("regexp_replace(lower(x), '\\([^)]*\\)', '', 'g')")} for x in items] AS keys
      FROM p)
SELECT doc_id, array_to_string(list_filter(items, lambda x, i: list_position(keys, keys[i]) = i), '|') AS items
FROM k""")
def q_dedup_list(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(tx.dedup_list(tx.ingredient_items(F.col("text"))), "|").alias("items"))


@register("parse_numeric", sql="""
SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE) AS k,
       least(greatest(coalesce(TRY_CAST(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE), 0.0), 0.0), 50.0)
         AS k_clipped
FROM events""")
def q_parse_numeric(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    return e.select("event_id", tx.parse_numeric(F.col("props")).alias("k"),
                    tx.parse_numeric(F.col("props"), fill=0.0, lo=0.0, hi=50.0).alias("k_clipped"))


@register("rescale_rating", sql="""
WITH m AS (SELECT max(c_acctbal) AS mx FROM customer)
SELECT c_custkey, CASE WHEN mx > 5 THEN c_acctbal / mx * 5 ELSE c_acctbal END AS rating
FROM customer, m""")
def q_rescale_rating(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("rating"))
    return cl.rescale_rating(c, "rating")


@register("impute", sql=b.with_ctes(b.REVIEWS_SQL) + """
, m AS (SELECT median(rating) AS med FROM reviews)
SELECT review_id, coalesce(rating, med) AS rating, coalesce(source, 'unknown') AS source FROM reviews, m""")
def q_impute(spark, sf_dir):
    r = b.reviews(spark, sf_dir).select("review_id", "rating", "source")
    return cl.impute(r, numeric=["rating"], strings=["source"])


@register("dense_surrogate_id", sql=f"""
WITH v AS (SELECT DISTINCT regexp_replace(lower({strip_sql('p_name')}), '\\s+', ' ', 'g') AS v FROM part
           WHERE p_name IS NOT NULL),
ids AS (SELECT v, 'PRD_' || lpad(CAST(row_number() OVER (ORDER BY v) - 1 AS VARCHAR), 5, '0') AS surrogate_id FROM v)
SELECT p_partkey, surrogate_id FROM part
LEFT JOIN ids ON regexp_replace(lower({strip_sql('p_name')}), '\\s+', ' ', 'g') = ids.v""")
def q_dense_surrogate_id(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return cl.dense_surrogate_id(p, "p_name", "PRD").select("p_partkey", "surrogate_id")


@register("hash_id", sql=f"""
SELECT p_partkey, 'BRD_' || CAST({md5_mod_sql('p_brand', 100000)} AS VARCHAR) AS brand_id,
       {md5_mod_sql('CAST(p_partkey AS VARCHAR)', 1000)} / 1000.0 AS product_hash,
       {md5_mod_sql('p_name', 100000)} / 100000.0 AS name_hash
FROM part""")
def q_hash_id(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.hash_id(F.col("p_brand"), "BRD").alias("brand_id"),
                    tx.hash_unit(F.col("p_partkey"), 1000).alias("product_hash"),
                    tx.hash_unit(F.col("p_name"), 100000).alias("name_hash"))


@register("parse_dates_features", sql="""
SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year,
       CAST(month(l_shipdate) AS INTEGER) AS month, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week,
       CAST(week(l_shipdate) AS INTEGER) AS week_of_year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
       isodow(l_shipdate) >= 6 AS is_weekend
FROM lineitem""")
def q_parse_dates_features(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    feats = tx.date_features(F.col("l_shipdate"))
    return li.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in feats.items()])


def _season_sql(m: str) -> str:
    return "CASE " + " ".join(f"WHEN {m} IN ({', '.join(str(x) for x in ms)}) THEN {q(n)}"
                              for n, ms in L.SEASONS) + " ELSE 'unknown' END"


@register("season", sql=f"""
SELECT l_orderkey, l_linenumber, {_season_sql('month(l_shipdate)')} AS season FROM lineitem""")
def q_season(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", tx.season(F.month("l_shipdate")).alias("season"))


@register("label_encode", sql="""
WITH c AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type_code
           FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL))
SELECT p_partkey, p.p_type, p_type_code FROM part p LEFT JOIN c USING (p_type)""")
def q_label_encode(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return cl.label_encode(p, "p_type")


@register("alias_lookup", sql="""
SELECT doc_id, coalesce(CASE lower(regexp_replace(lang, '^\\s+|\\s+$', '', 'g'))
  """ + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LANG_ALIASES.items()) + """ END, lang) AS language
FROM documents""")
def q_alias_lookup(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.alias_lookup(F.col("lang"), LANG_ALIASES).alias("language"))


@register("flags_to_list", sql="""
WITH f AS (SELECT l_orderkey, l_linenumber,
  list_filter([CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_linestatus = 'O' THEN 'open' END,
               CASE WHEN l_discount > 0.05 THEN 'discounted' END], lambda x: x IS NOT NULL) AS fl FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN len(fl) = 0 THEN 'all' ELSE array_to_string(fl, ',') END AS flags FROM f""")
def q_flags_to_list(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    flags = {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O",
             "discounted": F.col("l_discount") > 0.05}
    return li.select("l_orderkey", "l_linenumber", tx.flags_to_list(flags).alias("flags"))


@register("extract_first_term", sql="""
SELECT doc_id, CASE """ + " ".join(f"WHEN contains(lower(text), {q(t)}) THEN {q(t)}" for t in FIRST_TERMS) + """
  END AS first_term FROM documents""")
def q_extract_first_term(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.first_term(F.col("text"), FIRST_TERMS).alias("first_term"))


@register("currency_fix", sql=f"""
SELECT c_custkey, CASE WHEN c_acctbal < 200 THEN {b.rnd('c_acctbal * 83.5', 0)} ELSE c_acctbal END AS price
FROM customer""")
def q_currency_fix(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.currency_fix(F.col("c_acctbal")).alias("price"))


@register("price_tier", sql="""
WITH p AS (SELECT p_partkey, p_retailprice / 20.0 AS price FROM part)
SELECT p_partkey, CASE WHEN price < 15 THEN 'budget' WHEN price < 50 THEN 'mid' ELSE 'premium' END AS tier,
       CASE WHEN price < 15 THEN 0.7 WHEN price < 50 THEN 1.0 ELSE 1.3 END AS tier_factor,
       least(greatest(25.0 / price, 0.1), 2.0) AS price_sensitivity
FROM p""")
def q_price_tier(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice") / 20.0)
    return p.select("p_partkey", tx.price_tier(F.col("price")).alias("tier"),
                    tx.price_tier_factor(F.col("price")).alias("tier_factor"),
                    tx.price_sensitivity(F.col("price")).alias("price_sensitivity"))


@register("season_factor", sql=b.with_ctes(b.PRODUCTS_SQL, b.SALES_SQL) + f"""
, s AS (SELECT s.order_id, s.line_no, p.category, s.month, s.units_sold FROM sales s JOIN products p USING (product_id)),
f AS (SELECT *, CASE category {' '.join(f"WHEN {q(k)} THEN {v[0]}" for k, v in TEST_PROFILES.items() if k != 'default')}
                ELSE 6 END AS peak,
             CASE category {' '.join(f"WHEN {q(k)} THEN {v[1]}" for k, v in TEST_PROFILES.items() if k != 'default')}
                ELSE 0.0 END AS amp FROM s),
g AS (SELECT *, 1 + amp * cos(pi() * least(abs(month - peak), 12 - abs(month - peak)) / 6.0) AS sf FROM f)
SELECT order_id, line_no, {b.rnd('sf', 6)} AS season_factor, {b.rnd('greatest(5.0, units_sold * sf)', 6)} AS effective_units
FROM g""")
def q_season_factor(spark, sf_dir):
    s = b.sales(spark, sf_dir).join(b.products(spark, sf_dir).select("product_id", "category"), "product_id")
    f = cl.season_factor(s, "category", "month", "units_sold", profiles=TEST_PROFILES)
    return f.select("order_id", "line_no", F.round("season_factor", 6).alias("season_factor"),
                    F.round("effective_units", 6).alias("effective_units"))


@register("preprocess_reviews", sql=b.with_ctes(b.REVIEWS_SQL) + f"""
, c AS (SELECT review_id, {clean_sql('review_body')} AS review_text, rating FROM reviews)
SELECT review_id, review_text, least(greatest(rating, 1.0), 5.0) AS rating_value,
       CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative'
            WHEN rating IS NOT NULL THEN 'neutral' END AS sentiment
FROM c WHERE length(review_text) > 5""")
def q_preprocess_reviews(spark, sf_dir):
    r = b.reviews(spark, sf_dir).select("review_id", F.col("review_body").alias("review_text"),
                                        F.col("rating").alias("rating_value"))
    return cl.preprocess_reviews(r)


@register("preprocess_master", sql=f"""
SELECT p_partkey, {strip_sql("regexp_replace(lower(p_name), '\\s+', ' ', 'g')")} AS product_name,
       {strip_sql("regexp_replace(lower(p_brand), '\\s+', ' ', 'g')")} AS brand,
       least(greatest(TRY_CAST(regexp_replace(CAST(p_retailprice / 400.0 AS VARCHAR), '[^0-9.]', '', 'g') AS DOUBLE),
                      0.0), 5.0) AS average_rating
FROM part""")
def q_preprocess_master(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("product_name"),
                                              F.col("p_brand").alias("brand"),
                                              (F.col("p_retailprice") / 400.0).alias("average_rating"))
    return cl.preprocess_master(p)


@register("preprocess_sales", sql="""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date,
       TRY_CAST(CAST(l_quantity - 3 AS VARCHAR) AS DOUBLE) AS units_sold
FROM lineitem WHERE l_quantity - 3 >= 0""")
def q_preprocess_sales(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                                   F.col("l_shipdate").alias("ship_date"),
                                                   (F.col("l_quantity") - 3).alias("units_sold"))
    return cl.preprocess_sales(li)


@register("assemble_enriched", sql="""
SELECT doc_id,
  CASE WHEN length(coalesce(CASE WHEN n_chars > 1000 THEN text END, '')) >= 5 THEN text ELSE source END AS ingredients_final,
  CASE WHEN length(coalesce(CASE WHEN lang = 'en' THEN text END, '')) >= 10 THEN text ELSE 'no review' END AS review_final,
  length(coalesce(CASE WHEN n_chars > 1000 THEN text END, '')) >= 5 AS ingredients_supplied,
  length(coalesce(CASE WHEN lang = 'en' THEN text END, '')) >= 10 AS review_supplied
FROM documents""")
def q_assemble_enriched(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 1000, F.col("text")).alias("sup_ing"), F.col("source").alias("gen_ing"),
        F.when(F.col("lang") == "en", F.col("text")).alias("sup_rev"), F.lit("no review").alias("gen_rev"))
    a = cl.assemble_enriched(d, "sup_ing", "gen_ing", "sup_rev", "gen_rev")
    return a.select("doc_id", "ingredients_final", "review_final", "provenance.ingredients_supplied",
                    "provenance.review_supplied")


@register("validate_required", sql="""
SELECT c_custkey, coalesce(c_mktsegment, 'GENERAL') AS c_mktsegment, coalesce(c_name, 'Unknown') AS c_name,
       greatest(c_acctbal, 0.0) AS price,
       CAST(c_mktsegment IS NULL AS INTEGER) + CAST(c_name IS NULL AS INTEGER) AS backfilled
FROM customer""")
def q_validate_required(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name",
                                                  F.col("c_acctbal").alias("price"))
    return cl.validate_required(c, {"c_mktsegment": "GENERAL", "c_name": "Unknown"})


@register("forecast_json_parse", sql="""
WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[' || CAST(value AS VARCHAR) || ', 1.5]'
                                 ELSE '{"forecast": [' || CAST(value AS VARCHAR) || ', 2.5]}' END AS stored FROM events)
SELECT event_id, CAST(coalesce(TRY_CAST(stored AS DOUBLE[]),
                               TRY_CAST(json_extract(stored, '$.forecast') AS DOUBLE[]))[1] AS DOUBLE) AS first_step,
       CAST(coalesce(TRY_CAST(stored AS DOUBLE[]),
                     TRY_CAST(json_extract(stored, '$.forecast') AS DOUBLE[]))[2] AS DOUBLE) AS second_step
FROM s""")
def q_forecast_json_parse(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    stored = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", 1.5]"))) \
              .otherwise(F.concat(F.lit('{"forecast": ['), F.col("value").cast("string"), F.lit(", 2.5]}")))
    arr = cl.forecast_json_parse(stored)
    return e.select("event_id", arr[0].alias("first_step"), arr[1].alias("second_step"))


@register("derive_measures", sql=f"""
SELECT l_orderkey, l_linenumber, {b.rnd('(l_extendedprice / l_quantity) * l_quantity', 2)} AS revenue,
       {b.rnd('(l_extendedprice / l_quantity) * 0.4', 2)} AS cost_price,
       {b.rnd('((l_extendedprice / l_quantity) - ' + b.rnd('(l_extendedprice / l_quantity) * 0.4', 2) + ') / (l_extendedprice / l_quantity)', 6)} AS margin
FROM lineitem""")
def q_derive_measures(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("units_sold"))
    d = cl.derive_measures(li)
    return d.select("l_orderkey", "l_linenumber", "revenue", "cost_price", F.round("margin", 6).alias("margin"))
