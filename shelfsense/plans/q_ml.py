"""Queries: models, forecasts and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import binding as b
from ..operators import listing as ls
from ..operators import ml
from ..operators import text_analytics as ta
from ..operators import timeseries as ts
from ..functions.text import hash_unit
from ..operators.ordering import dense_codes
from .q_series import DENSE_SQL, dense
from .q_text import valence_case_sql
from .registry import register


def labelled_docs(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    lb = b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return ts.stratified_split(d.join(lb, "doc_id"), "quality", "doc_id")


@register("train_text_classifier", sql=None)
def q_train_text_classifier(spark, sf_dir):
    data = labelled_docs(spark, sf_dir)
    model = ml.train_text_classifier(data.where("split = 'train'"), "text", "quality")
    pred = model.transform(data.where("split = 'test'"))
    return pred.select("doc_id", "quality", "predicted")


@register("train_linear_svm", sql=None)
def q_train_linear_svm(spark, sf_dir):
    data = labelled_docs(spark, sf_dir)
    model = ml.train_linear_svm(data.where("split = 'train'"), "text", "quality")
    pred = model.transform(data.where("split = 'test'"))
    return ml.margin_confidence(pred).select("doc_id", "quality", "predicted", F.round("confidence", 6).alias("confidence"))


@register("skin_hybrid_model", sql=None)
def q_skin_hybrid_model(spark, sf_dir):
    """H08 fed by I02: a linear SVM, trained on the term votes of four documents in five, gives class and confidence for all."""
    docs = ta.term_vote(b.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    model = ml.train_linear_svm(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0), "text", "skin_type", max_iter=20)
    pred = ml.margin_confidence(model.transform(docs.select("doc_id", "text")), out="ml_conf").withColumnRenamed("predicted", "ml_pred")
    out = ta.skin_hybrid(pred.select("doc_id", "text", "ml_pred", "ml_conf"), "text")
    return out.select("doc_id", "ml_pred", F.round("ml_conf", 6).alias("ml_conf"), "skin_type", "skin_confidence")


@register("tune", sql=None)
def q_tune(spark, sf_dir):
    data = labelled_docs(spark, sf_dir).where("split = 'train'")
    return ml.tune(data, "text", "quality")


@register("oversample", sql="""
WITH l AS (SELECT doc_id, CAST(quality AS VARCHAR) AS quality FROM labels),
c AS (SELECT quality, count(*) AS nc FROM l GROUP BY quality),
m AS (SELECT max(nc) AS mx FROM c),
r AS (SELECT l.doc_id, l.quality, row_number() OVER (PARTITION BY l.quality
             ORDER BY md5(CAST(l.doc_id AS VARCHAR) || '|42'), l.doc_id) - 1 AS pos FROM l),
k AS (SELECT r.*, CAST(floor(m.mx / c.nc) AS BIGINT) + CASE WHEN r.pos < m.mx - floor(m.mx / c.nc) * c.nc THEN 1 ELSE 0 END
               AS n_copies FROM r JOIN c USING (quality), m)
SELECT doc_id, quality, CAST(copy AS INTEGER) AS copy FROM k, range(1, n_copies + 1) t(copy)""")
def q_oversample(spark, sf_dir):
    lb = b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return ml.oversample(lb, "quality", "doc_id").select("doc_id", "quality", "copy")


def feature_table(spark, sf_dir):
    prods = b.products(spark, sf_dir)
    prods = prods.join(dense_codes(prods, "category", "category_code"), "category")
    return ts.forecast_feature_table(dense(spark, sf_dir), prods), prods


def fit_rf(spark, sf_dir, trees: int = 200, depth: int = 8):
    table, prods = feature_table(spark, sf_dir)
    train = ts.chronological_split(table).where("split = 'train'")
    model, asm, imps = ml.train_demand_rf(train, trees=trees, depth=depth)
    return model, imps, prods


@register("train_demand_rf", sql=None)
def q_train_demand_rf(spark, sf_dir):
    _, imps, _ = fit_rf(spark, sf_dir)
    return imps


def recursive_frame(spark, sf_dir, steps: int = 7):
    model, _, prods = fit_rf(spark, sf_dir)
    d = dense(spark, sf_dir)
    # last 12 weeks per product: rank filter (WindowGroupLimit) before the bounded collect
    w = Window.partitionBy("product_id").orderBy(F.col("week_end").desc())
    last = (d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 12)
             .groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("week_end", "units"))).alias("_s"))
             .select("product_id", F.transform("_s", lambda s: s["units"]).alias("history")))
    # the product's own features, in the same columns the model was trained on
    static = prods.select("product_id", (F.col("price") / 10000.0).alias("price_scaled"),
                          hash_unit(F.col("product_id"), 1000).alias("product_hash"), "category_code")
    hist = last.join(static, "product_id")
    names = ["price_scaled", "product_hash", "category_code"]
    return ml.forecast_recursive(hist, model, static=names, origin=b.AS_OF, steps=steps)


@register("forecast_recursive", sql=None)
def q_forecast_recursive(spark, sf_dir):
    f = recursive_frame(spark, sf_dir)
    return ts.explode_series(f, ["product_id"], "forecast", "step", "forecast")


def arima_frame(spark, sf_dir, top_n: int = 5):
    d = dense(spark, sf_dir)
    top = ls.top_n_by_total(d, "product_id", "units", top_n)
    return ml.forecast_arima(top)


@register("forecast_arima", sql=None)
def q_forecast_arima(spark, sf_dir):
    return arima_frame(spark, sf_dir).select("product_id", "n_points", "rmse", "mae",
                                             F.array_join(F.transform("forecast", lambda x: F.round(x, 3).cast("string")),
                                                          ",").alias("forecast"))


@register("forecast_dispatch", sql=None)
def q_forecast_dispatch(spark, sf_dir):
    prods = b.products(spark, sf_dir).select("product_id")
    d = dense(spark, sf_dir)
    base_hist = d.groupBy("product_id").agg(F.avg("units").alias("_m")).select(
        "product_id", F.array(F.col("_m")).alias("history"))
    base = ts.forecast_baseline(base_hist)
    disp = ml.forecast_dispatch(prods, arima_frame(spark, sf_dir), recursive_frame(spark, sf_dir), base)
    return disp.select("product_id", "method_used", F.size("forecast").alias("steps"))


@register("regression_metrics", sql=b.with_ctes(DENSE_SQL) + """
, f AS (SELECT * FROM (SELECT units, lag(units, 1) OVER (PARTITION BY product_id ORDER BY week_end) AS lag_1 FROM dense)
        WHERE lag_1 IS NOT NULL),
m AS (SELECT avg(units) AS my FROM f)
SELECT count(*) AS n, round(sqrt(avg((lag_1 - units) * (lag_1 - units))), 6) AS rmse,
       round(avg(abs(lag_1 - units)), 6) AS mae,
       round(1 - sum((lag_1 - units) * (lag_1 - units)) / sum((units - my) * (units - my)), 6) AS r2,
       round(100 * avg(CASE WHEN units <> 0 THEN abs((lag_1 - units) / units) END), 6) AS mape
FROM f, m""")
def q_regression_metrics(spark, sf_dir):
    f = ts.lag_features(dense(spark, sf_dir), lags=(1,))
    r = ml.regression_metrics(f, "units", "lag_1")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2", "mape")])


PROXY_SQL = b.with_ctes(b.REVIEWS_SQL) + f"""
, s AS (
  SELECT rating, list_reduce([0.0] || [{valence_case_sql('t')}
                     for t in regexp_extract_all(lower(coalesce(review_body, '')), '([a-z]+)', 1)],
                     lambda a, x: a + x) AS s
  FROM reviews WHERE rating IS NOT NULL),
l AS (SELECT CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS truth,
             CASE WHEN s = 0 THEN 0.0 ELSE s / sqrt(s * s + 15.0) END AS c FROM s),
p AS (SELECT truth, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS pred
      FROM l)"""


def proxy_frame(spark, sf_dir):
    r = b.reviews(spark, sf_dir).where(F.col("rating").isNotNull()).withColumn("truth", ta.rating_label(F.col("rating")))
    return ta.sentiment_lexicon(r, "review_body").withColumnRenamed("compound_label", "pred")


CLASSES = ["negative", "neutral", "positive"]


@register("confusion_matrix", sql=PROXY_SQL + """
, cls AS (SELECT * FROM (VALUES ('negative'), ('neutral'), ('positive')) t(truth))
SELECT cls.truth, """ + ", ".join(f"count_if(p.pred = '{c}') AS {c}" for c in CLASSES) + """
FROM cls LEFT JOIN p USING (truth) GROUP BY cls.truth""")
def q_confusion_matrix(spark, sf_dir):
    cm = ml.confusion_matrix(proxy_frame(spark, sf_dir), "truth", "pred", CLASSES)
    return cm.select("truth", *[F.col(c).cast("long").alias(c) for c in CLASSES])


@register("classification_metrics", sql=PROXY_SQL + """
, tp AS (SELECT truth AS cls, count(*) AS support, count_if(truth = pred) AS tp FROM p GROUP BY truth),
pp AS (SELECT pred AS cls, count(*) AS predicted FROM p GROUP BY pred),
c AS (SELECT coalesce(tp.cls, pp.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(predicted, 0) AS predicted FROM tp FULL JOIN pp ON tp.cls = pp.cls),
m AS (SELECT cls, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM m),
t AS (SELECT sum(support) AS n, sum(tp) AS ntp FROM f)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS DOUBLE) AS support FROM f
UNION ALL SELECT 'accuracy', round(ntp / n, 6), round(ntp / n, 6), round(ntp / n, 6), CAST(n AS DOUBLE) FROM t
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST((SELECT n FROM t) AS DOUBLE) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / (SELECT n FROM t), 6),
                 round(sum(recall * support) / (SELECT n FROM t), 6), round(sum(f1 * support) / (SELECT n FROM t), 6),
                 CAST((SELECT n FROM t) AS DOUBLE) FROM f""")
def q_classification_metrics(spark, sf_dir):
    m = ml.classification_metrics(proxy_frame(spark, sf_dir), "truth", "pred")
    return m.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("evaluation_report", sql=PROXY_SQL + """
SELECT 'sentiment_proxy' AS model, 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM p
UNION ALL SELECT 'sentiment_proxy', 'accuracy', round(avg(CAST(pred = truth AS DOUBLE)), 6) FROM p""")
def q_evaluation_report(spark, sf_dir):
    acc = ta.proxy_accuracy(proxy_frame(spark, sf_dir), "pred", "truth")
    acc = acc.select(F.col("n").cast("double").alias("n"), F.round("accuracy", 6).alias("accuracy"))
    return ml.evaluation_report([("sentiment_proxy", acc)])
