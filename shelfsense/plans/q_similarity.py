"""Queries: TF-IDF, similar products, text search, safe alternatives, recommendations,
ranking metrics, coverage, density, embeddings (SURVEY J01-J07, J09-J12, I13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import binding as b
from ..functions import lexicons as L
from ..operators import safety
from ..operators import similarity as sim
from ..session import cut_lineage, stored
from .q_flagship import ANALYSIS_SQL, analysis_frame
from .q_safety import HIT_TERMS
from .registry import register
from .sqlgen import md5_mod_sql, q

STOP_SQL = "[" + ", ".join(q(w) for w in L.STOPWORDS) + "]"
TOK_SQL = ("list_filter(regexp_extract_all(lower(coalesce({x}, '')), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1), "
           "lambda t: NOT list_contains(" + STOP_SQL.replace("{", "{{").replace("}", "}}") + ", t))")


def _tfidf_sql(src: str, id_expr: str, text_expr: str, prefix: str = "") -> str:
    """CTEs {prefix}toks, {prefix}tf, {prefix}vocab, {prefix}wt (doc_id, term, weight)."""
    p = prefix
    return f"""{p}toks AS (
  SELECT doc_id, t || [t[i] || ' ' || t[i + 1] for i in range(1, len(t))] AS terms FROM (
    SELECT {id_expr} AS doc_id, {TOK_SQL.format(x=text_expr)} AS t FROM {src})),
{p}tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM {p}toks)
          GROUP BY doc_id, term),
{p}vocab AS (
  SELECT term, df, ln((1 + (SELECT count(*) FROM {src})) / (1 + df)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS freq FROM {p}tf GROUP BY term)
  WHERE df >= 2),
{p}raw AS (SELECT doc_id, term, (ln(tf) + 1) * idf AS w FROM {p}tf JOIN {p}vocab USING (term)),
{p}wt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM {p}raw)"""


CORPUS_SQL = b.PRODUCTS_SQL + ",\n" + b.INGREDIENTS_SQL + """,
corpus AS (
  SELECT p.product_id, p.category, p.brand,
         lower(array_to_string(list_filter([array_to_string([p.brand, p.brand, p.brand, p.brand, p.brand], ' '),
                                            array_to_string([p.category, p.category, p.category], ' '),
                                            coalesce(p.product_name, ''), coalesce(i.ingredients, '')],
                                           lambda s: s <> ''), ' ')) AS corpus
  FROM products p LEFT JOIN ingredients i USING (product_id))"""

TFIDF_SQL = CORPUS_SQL + ",\n" + _tfidf_sql("corpus", "product_id", "corpus")

PAIRS_SQL = TFIDF_SQL + """,
pairs AS (SELECT a.doc_id AS a, bb.doc_id AS b, sum(a.weight * bb.weight) AS sim
          FROM wt a JOIN wt bb ON a.term = bb.term AND a.doc_id <> bb.doc_id GROUP BY a.doc_id, bb.doc_id
          HAVING sum(a.weight * bb.weight) >= 0.2)"""


def _ranked_sql(n: int) -> str:
    return f""",
ranked AS (SELECT * FROM (SELECT a AS product_id, b AS similar_id, sim,
                                 row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank
                          FROM pairs) WHERE rank <= {n})"""


def corpus_frame(spark, sf_dir):
    p = b.products(spark, sf_dir).join(b.ingredients(spark, sf_dir).select("product_id", "ingredients"),
                                       "product_id", "left")
    return sim.weighted_corpus(p)


def weights_frame(spark, sf_dir):
    """TF-IDF weights, stored once in the shared checkpoint folder for their several readers, and the vocabulary."""
    w, vocab = sim.tfidf(corpus_frame(spark, sf_dir), "product_id", "corpus")
    return stored(w), vocab


@register("tfidf", sql=b.with_ctes(TFIDF_SQL) + f"""
SELECT doc_id, term, {b.rnd('weight', 6)} AS weight FROM wt""")
def q_tfidf(spark, sf_dir):
    w, _ = sim.tfidf(corpus_frame(spark, sf_dir), "product_id", "corpus")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("weighted_corpus", sql=b.with_ctes(CORPUS_SQL) + "SELECT product_id, corpus FROM corpus")
def q_weighted_corpus(spark, sf_dir):
    return corpus_frame(spark, sf_dir).select("product_id", "corpus")


@register("term_weights", sql=b.with_ctes(TFIDF_SQL) + f"""
SELECT doc_id, term, CAST(rank AS INTEGER) AS rank, {b.rnd('weight', 6)} AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM wt)
WHERE rank <= 10""")
def q_term_weights(spark, sf_dir):
    w, _ = sim.tfidf(corpus_frame(spark, sf_dir), "product_id", "corpus")
    t = sim.term_weights(w, 10)
    return t.select("doc_id", "term", "rank", F.round("weight", 6).alias("weight"))


@register("similar_products", sql=b.with_ctes(PAIRS_SQL) + _ranked_sql(5) + f"""
SELECT r.product_id, r.similar_id, CAST(r.rank AS INTEGER) AS rank, {b.rnd('r.sim', 6)} AS sim,
       {b.rnd('CASE WHEN ca.category = cb.category THEN least(1.0, r.sim * 1.2) ELSE r.sim END', 6)} AS score
FROM ranked r JOIN products ca ON ca.product_id = r.product_id JOIN products cb ON cb.product_id = r.similar_id""")
def q_similar_products(spark, sf_dir):
    w, _ = weights_frame(spark, sf_dir)
    s = sim.similar_products(w, b.products(spark, sf_dir))
    return s.select("product_id", "similar_id", "rank", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"))


@register("matrix_density", sql=b.with_ctes(PAIRS_SQL) + f"""
SELECT count(*) AS nnz, count_if(sim >= 0.2) AS above, (SELECT count(*) FROM part) AS n_items,
       {b.rnd('100.0 * count(*) / ((SELECT count(*) FROM part) * (SELECT count(*) FROM part))', 6)} AS density_pct
FROM pairs""")
def q_matrix_density(spark, sf_dir):
    w, _ = weights_frame(spark, sf_dir)
    n = b.products(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_items"))
    d = sim.matrix_density(sim.similar_pairs(w), n)
    return d.withColumn("density_pct", F.round("density_pct", 6))


@register("matrix_density_before", sql=b.with_ctes(TFIDF_SQL) + f""",
n AS (SELECT count(*) AS n FROM products),
drawn AS (SELECT product_id AS a FROM products, n WHERE {md5_mod_sql("CAST(product_id AS VARCHAR)", sim.DRAWS)} < least(1.0, CAST(300.0 AS DOUBLE) / n) * {sim.DRAWS}),
met AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM wt x JOIN drawn ON drawn.a = x.doc_id JOIN wt y ON y.term = x.term AND y.doc_id <> x.doc_id),
ks AS (SELECT drawn.a, count(met.b) AS k FROM drawn LEFT JOIN met USING (a) GROUP BY drawn.a),
s AS (SELECT count(*) AS m, avg(k) AS k, coalesce(stddev_samp(k), 0.0) AS sd FROM ks)
SELECT m AS n_sampled, round(100.0 * k / n, 6) AS density_pct, round(100.0 * sd / sqrt(m) / n * sqrt(greatest(0.0, 1 - m / n)), 6) AS error_pct
FROM s, n""")
def q_matrix_density_before(spark, sf_dir):
    w, _ = weights_frame(spark, sf_dir)
    d = sim.density_before_threshold(w, b.products(spark, sf_dir))
    return d.select("n_sampled", F.round("density_pct", 6).alias("density_pct"), F.round("error_pct", 6).alias("error_pct"))


QUERY_TFIDF_SQL = TFIDF_SQL + """,
qtoks AS (
  SELECT doc_id, t || [t[i] || ' ' || t[i + 1] for i in range(1, len(t))] AS terms FROM (
    SELECT item_id AS doc_id, """ + TOK_SQL.format(x="text") + """ AS t FROM benchmark)),
qtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM qtoks) GROUP BY doc_id, term),
qraw AS (SELECT doc_id, term, (ln(tf) + 1) * idf AS w FROM qtf JOIN vocab USING (term)),
qwt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM qraw),
qsims AS (SELECT qq.doc_id AS query_id, c.doc_id AS item_id, sum(qq.weight * c.weight) AS sim
          FROM qwt qq JOIN wt c USING (term) GROUP BY qq.doc_id, c.doc_id HAVING sum(qq.weight * c.weight) > 0),
qranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, item_id)
                                  AS rank FROM qsims) WHERE rank <= 75)"""


@register("similar_to_text", sql=b.with_ctes(QUERY_TFIDF_SQL) + f"""
SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, {b.rnd('sim', 6)} AS sim FROM qranked""")
def q_similar_to_text(spark, sf_dir):
    w, vocab = weights_frame(spark, sf_dir)
    qs = b.table(spark, sf_dir, "benchmark")
    qv = sim.query_vectors(qs, "item_id", "text", vocab)
    r = sim.similar_to_text(qv, w)
    return r.select("query_id", "item_id", "rank", F.round("sim", 6).alias("sim"))


SAFE_TERMS_SQL = "[" + ", ".join(q(t) for t in HIT_TERMS) + "]"


@register("safe_alternatives", sql=b.with_ctes(PAIRS_SQL) + f""",
attrs AS (SELECT p.product_id, p.category,
                 NOT list_bool_or([contains(lower(coalesce(i.ingredients, '')), w) for w in {SAFE_TERMS_SQL}]) AS is_safe
          FROM products p LEFT JOIN ingredients i USING (product_id)),
j AS (SELECT r.a AS query_id, r.b AS item_id, r.sim, a.category, qa.category AS query_category,
             CAST(a.category = qa.category AS INTEGER) AS same
      FROM pairs r JOIN attrs a ON a.product_id = r.b JOIN attrs qa ON qa.product_id = r.a
      WHERE a.is_safe),
j2 AS (SELECT *, max(same) OVER (PARTITION BY query_id) AS any_same FROM j),
j3 AS (SELECT * FROM j2 WHERE any_same = 0 OR same = 1)
SELECT query_id, item_id, CASE WHEN any_same = 1 THEN 'same_category' ELSE 'any_category' END AS mode,
       CAST(alt_rank AS INTEGER) AS alt_rank, {b.rnd('sim', 6)} AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, item_id) AS alt_rank FROM j3)
WHERE alt_rank <= 5""")
def q_safe_alternatives(spark, sf_dir):
    w, _ = weights_frame(spark, sf_dir)
    prods = b.products(spark, sf_dir).join(b.ingredients(spark, sf_dir).select("product_id", "ingredients"),
                                           "product_id", "left")
    attrs = safety.safe_flags(prods, "ingredients", HIT_TERMS).select("product_id", "is_safe", "category")
    # the best safe ones of every similar item, not the safe ones of the best few
    labels = attrs.groupBy(F.col("product_id").alias("doc_id")).agg(
        F.max("is_safe").alias("may"), F.collect_set("category").alias("kinds"), F.collect_set(F.when(F.col("is_safe"), F.col("category"))).alias("open_kinds"))
    pool = sim.similar_pairs(w, top_n=5, labels=labels).select(F.col("a").alias("query_id"), F.col("b").alias("item_id"), "sim")
    pool = pool.join(attrs.select(F.col("product_id").alias("query_id"), F.col("category").alias("query_category")),
                     "query_id")
    alt = sim.safe_alternatives(pool, attrs.withColumnRenamed("product_id", "item_id"), id_col="item_id")
    return alt.select("query_id", "item_id", "mode", "alt_rank", F.round("sim", 6).alias("sim"))


@register("ranking_metrics", sql=b.with_ctes(PAIRS_SQL) + _ranked_sql(10) + """,
rel AS (SELECT r.product_id, r.rank, CAST(qa.category = ra.category AND qa.category IS NOT NULL AS INTEGER) AS rel
        FROM ranked r JOIN products qa ON qa.product_id = r.product_id JOIN products ra ON ra.product_id = r.similar_id),
pq AS (SELECT product_id, """ + ", ".join(
    f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS n_rel_{k}, "
    f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0.0 END) AS dcg_{k}" for k in (1, 3, 5, 10)) + """,
       min(CASE WHEN rel = 1 THEN rank END) AS first_rel FROM rel GROUP BY product_id),
id AS (SELECT *, """ + ", ".join(
    f"CASE WHEN n_rel_{k} > 0 THEN list_reduce([0.0] || [1.0 / log2(i + 1) for i in range(1, CAST(least(n_rel_{k}, {k}) AS BIGINT) + 1)],"
    f" lambda a, x: a + x) ELSE 0.0 END AS idcg_{k}" for k in (1, 3, 5, 10)) + """ FROM pq)
SELECT count(*) AS n_queries, """ + ", ".join(
    f"round(avg(n_rel_{k} / {k}), 6) AS p_at_{k}, "
    f"round(avg(CASE WHEN idcg_{k} > 0 THEN dcg_{k} / idcg_{k} ELSE 0.0 END), 6) AS ndcg_at_{k}, "
    f"round(avg(CAST(n_rel_{k} > 0 AS DOUBLE)), 6) AS hr_at_{k}" for k in (1, 3, 5, 10)) + """,
       round(avg(coalesce(1.0 / first_rel, 0.0)), 6) AS mrr
FROM id""")
def q_ranking_metrics(spark, sf_dir):
    w, _ = weights_frame(spark, sf_dir)
    ranked = sim.similar_products(w, top_n=10).select("product_id", "similar_id", "rank")
    m = sim.ranking_metrics(ranked, b.products(spark, sf_dir), "category")
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in m.columns if c != "n_queries"])


@register("coverage_diversity", sql=b.with_ctes(PAIRS_SQL) + _ranked_sql(10) + """,
pp AS (SELECT x.product_id, x.similar_id AS a, y.similar_id AS b FROM ranked x JOIN ranked y
       ON x.product_id = y.product_id AND x.rank < y.rank),
ps AS (SELECT pa.a, pa.b, sum(wa.weight * wb.weight) AS sim FROM (SELECT DISTINCT a, b FROM pp) pa
       JOIN wt wa ON wa.doc_id = pa.a JOIN wt wb ON wb.doc_id = pa.b AND wb.term = wa.term GROUP BY pa.a, pa.b),
d AS (SELECT pp.product_id, avg(1 - coalesce(ps.sim, 0.0)) AS dd FROM pp LEFT JOIN ps USING (a, b) GROUP BY pp.product_id)
SELECT (SELECT count(DISTINCT similar_id) FROM ranked) AS covered, (SELECT count(*) FROM part) AS n_items,
       round((SELECT count(DISTINCT similar_id) FROM ranked) / (SELECT count(*) FROM part), 6) AS coverage,
       round(avg(dd), 6) AS diversity FROM d""")
def q_coverage_diversity(spark, sf_dir):
    w, _ = weights_frame(spark, sf_dir)
    blocks = sim.vector_blocks(w)
    ranked = sim.similar_products(w, top_n=10, blocks=blocks).select("product_id", "similar_id", "rank")
    n = b.products(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_items"))
    c = sim.coverage_diversity(ranked, w, n, blocks=blocks)
    return c.select("covered", "n_items", F.round("coverage", 6).alias("coverage"),
                    F.round("diversity", 6).alias("diversity"))


@register("embedding_topk", sql="""
WITH ev AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label AS query_id, i, avg(CAST(x AS DOUBLE)) AS x FROM ev GROUP BY label, i),
cn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM cent GROUP BY query_id),
vn AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM ev GROUP BY vec_id),
dots AS (SELECT c.query_id, e.vec_id, sum((CAST(e.x AS DOUBLE) / vn.n) * (c.x / cn.n)) AS cosine
         FROM ev e JOIN vn USING (vec_id) JOIN cent c ON c.i = e.i JOIN cn ON cn.query_id = c.query_id
         GROUP BY c.query_id, e.vec_id)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM dots)
WHERE rank <= 10""")
def q_embedding_topk(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings")
    cents = sim.label_centroids(e)
    t = sim.embedding_topk(e, cents)
    return t.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


_RISK = "CASE {x}.risk_level " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in sim.RISK_RANK) + " ELSE 0 END"
_TENTHS = "CAST(CAST(floor({x} * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor({x} * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR)"
_WHOLE = "CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"

REC_SQL = (ANALYSIS_SQL.rstrip() + ",\n" + CORPUS_SQL[CORPUS_SQL.index("corpus AS"):] + ",\n" + PAIRS_SQL[len(CORPUS_SQL) + 2:] + _ranked_sql(20) + f""",
sal AS (SELECT l_suppkey AS dealer_id, l_partkey AS product_id, avg(l_quantity) AS avg_m FROM lineitem GROUP BY ALL),
att AS (SELECT f.dealer_id, f.product_id, f.category, f.priority_score, f.risk_level, f.forecast_trend, f.avg_rating, f.stock_status, f.skin_type,
               coalesce(s.avg_m, 0.0) AS avg_m FROM final f LEFT JOIN sal s USING (dealer_id, product_id)),
ok AS (SELECT * FROM att WHERE risk_level <> 'high'),
c1 AS (SELECT t.dealer_id, t.product_id AS q, c.product_id AS c FROM ranked r JOIN att t ON t.product_id = r.product_id
       JOIN ok c ON c.dealer_id = t.dealer_id AND c.product_id = r.similar_id),
c2 AS (SELECT t.dealer_id, t.product_id AS q, c.product_id AS c FROM att t JOIN ok c ON c.dealer_id = t.dealer_id AND c.category = t.category AND c.product_id <> t.product_id
       QUALIFY row_number() OVER (PARTITION BY t.dealer_id, t.product_id ORDER BY c.priority_score DESC NULLS LAST, c.product_id) <= 30),
n2 AS (SELECT dealer_id, q, count(*) AS n FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY ALL),
few AS (SELECT t.dealer_id, t.product_id FROM att t LEFT JOIN n2 ON n2.dealer_id = t.dealer_id AND n2.q = t.product_id WHERE coalesce(n2.n, 0) < 5),
c3 AS (SELECT t.dealer_id, t.product_id AS q, c.product_id AS c FROM few t JOIN ok c ON c.dealer_id = t.dealer_id AND c.product_id <> t.product_id
       QUALIFY row_number() OVER (PARTITION BY t.dealer_id, t.product_id ORDER BY c.priority_score DESC NULLS LAST, c.product_id) <= 30),
n3 AS (SELECT dealer_id, q, count(*) AS n FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) GROUP BY ALL),
rec_last AS (SELECT t.dealer_id, t.product_id FROM few t LEFT JOIN n3 ON n3.dealer_id = t.dealer_id AND n3.q = t.product_id WHERE coalesce(n3.n, 0) < 3),
c4 AS (SELECT t.dealer_id, t.product_id AS q, c.product_id AS c FROM rec_last t JOIN att c ON c.dealer_id = t.dealer_id AND c.product_id <> t.product_id
       QUALIFY row_number() OVER (PARTITION BY t.dealer_id, t.product_id ORDER BY c.priority_score DESC NULLS LAST, c.product_id) <= 30),
rec_cand AS (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3 UNION SELECT * FROM c4),
cmp AS (SELECT d.dealer_id, d.q, d.c, t.avg_m AS ours, c.avg_m AS theirs, c.avg_rating AS rating, t.avg_rating AS own,
               c.forecast_trend = 'increasing' AS rising, {_RISK.format(x='c')} < {_RISK.format(x='t')} AS safer,
               c.risk_level = 'none' AND t.risk_level = 'none' AS clean, c.stock_status = 'normal' AS stocked,
               length(t.skin_type) > 0 AND length(c.skin_type) > 0 AND list_bool_or([contains(c.skin_type, trim(s)) for s in string_split(t.skin_type, ',')]) AS skins,
               c.category = t.category AS alike
        FROM rec_cand d JOIN att t ON t.dealer_id = d.dealer_id AND t.product_id = d.q JOIN ok c ON c.dealer_id = d.dealer_id AND c.product_id = d.c),
flags AS (SELECT *, ours > 0 AND theirs > ours * 1.2 AS faster, rating > 0 AND own > 0 AND rating > own + CAST(0.2 AS DOUBLE) AS better,
                 theirs > ours * 1.1 AND rising AND rating >= own AS confident FROM cmp),
flags2 AS (SELECT *, NOT faster AND theirs > 0 AND theirs > ours AS slightly FROM flags),
points AS (SELECT *, 5 + CASE WHEN faster THEN 40 WHEN slightly THEN 20 ELSE 0 END + CASE WHEN rising THEN 25 ELSE 0 END
                  + CASE WHEN safer THEN 45 WHEN clean THEN 5 ELSE 0 END + CASE WHEN better THEN 25 WHEN rating >= 4.0 THEN 10 ELSE 0 END
                  + CASE WHEN stocked THEN 10 ELSE 0 END + CASE WHEN skins THEN 10 ELSE 0 END + CASE WHEN confident THEN 50 ELSE 0 END
                  + CASE WHEN alike THEN 5 ELSE 0 END AS rec_score FROM flags2),
rec_best AS (SELECT *, row_number() OVER (PARTITION BY dealer_id, q ORDER BY rec_score DESC, c) AS rec_rank FROM points),
said AS (SELECT *, list_filter([
    CASE WHEN confident THEN '✨ Confident Replacement: High demand + Rising trend' END,
    CASE WHEN faster THEN 'Selling ' || {_WHOLE.format(x='((theirs - ours) / ours * 100)')} || '% more units/month than current product'
         WHEN slightly THEN 'Slightly higher sales velocity' END,
    CASE WHEN rising THEN 'Demand is trending upward this season' END,
    CASE WHEN safer THEN '🛡️ Safer alternative (No harmful ingredients)' END,
    CASE WHEN better THEN 'Superior satisfaction (⭐' || {_TENTHS.format(x='rating')} || ')' WHEN rating >= 4.0 THEN 'Highly rated by customers' END,
    CASE WHEN stocked THEN 'Well stocked and available' END,
    CASE WHEN skins THEN 'Suitable for same skin types' END], lambda x: x IS NOT NULL) AS r,
  list_filter([
    CASE WHEN faster THEN 'Higher demand (' || {_WHOLE.format(x='theirs')} || '/mo vs ' || {_WHOLE.format(x='ours')} || '/mo)' END,
    CASE WHEN rising THEN 'Rising trend — good time to stock more' END,
    CASE WHEN safer THEN 'Avoids harmful ingredients found in current product' END,
    CASE WHEN better THEN 'Better customer feedback than current (⭐' || {_TENTHS.format(x='own')} || ')' END,
    CASE WHEN confident THEN 'Top-performing alternative with better growth potential' END], lambda x: x IS NOT NULL) AS y
  FROM rec_best WHERE rec_rank <= 5)
""")


@register("recommendations", sql=REC_SQL + """
SELECT dealer_id, q AS query_id, c AS cand_id, CAST(rec_rank AS INTEGER) AS rec_rank, CAST(rec_score AS INTEGER) AS rec_score,
       CASE WHEN len(r) = 0 THEN 'Alternative product in your inventory' ELSE array_to_string(r[1:3], ' | ') END AS reasons,
       array_to_string(y[1:2], ' | ') AS why_better, rising AS is_trending, confident AS is_confident,
       CAST(round_even(theirs, 0) AS BIGINT) AS avg_monthly_sales FROM said""")
def q_recommendations(spark, sf_dir):
    w, _ = weights_frame(spark, sf_dir)
    similar = cut_lineage(sim.similar_products(w, top_n=20))
    sold = b.sales(spark, sf_dir).groupBy("dealer_id", "product_id").agg(F.avg("units_sold").alias("avg_monthly"))
    a = analysis_frame(spark, sf_dir).select("dealer_id", "product_id", "category", "priority_score", "risk_level", "forecast_trend",
                                             "avg_rating", "stock_status", "skin_type")
    items = cut_lineage(a.join(sold, ["dealer_id", "product_id"], "left"))
    r = sim.recommendations(similar, items)
    return r.withColumn("reasons", F.array_join("reasons", " | ")).withColumn("why_better", F.array_join("why_better", " | "))
