"""Aggregations.

Every aggregate is a ``groupBy().agg()`` so Spark plans a partial (map-side)
aggregate before the shuffle: a hot product or category contributes one
partial row per input partition, never its raw rows, to the final task.
Conditional counts use ``count_if`` in the same pass instead of one query per
class.  Global top-k uses ``orderBy().limit()`` (TakeOrderedAndProject:
per-partition top-k, then merge of k rows per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# ------------------------------------------------------------------ E05
def review_agg(reviews: DataFrame, keys=("product_id",), rating: str = "rating",
               sentiment: str | None = "sentiment_score", universe: DataFrame | None = None) -> DataFrame:
    """count, mean rating (2 dp, NULL ratings skipped), mean sentiment; 0 when none."""
    k = _k(keys)
    aggs = [F.count(F.lit(1)).alias("review_count"), F.round(F.avg(rating), 2).alias("avg_rating")]
    if sentiment:
        aggs.append(F.round(F.avg(sentiment), 3).alias("sentiment_avg"))
    g = reviews.groupBy(*k).agg(*aggs)
    if universe is None:
        return g
    out = universe.join(g, k, "left")
    fill = {"review_count": 0, "avg_rating": 0.0}
    if sentiment:
        fill["sentiment_avg"] = 0.0
    return out.fillna(fill)


# ------------------------------------------------------------------ E06
def sales_agg(sales: DataFrame, keys=("product_id",), units: str = "units_sold") -> DataFrame:
    return sales.groupBy(*_k(keys)).agg(F.sum(units).alias("total_units"), F.avg(units).alias("mean_units"))


# ------------------------------------------------------------------ E07
def rating_distribution(reviews: DataFrame, keys=("product_id",), rating: str = "rating") -> DataFrame:
    """Counts per rounded star 1..5 (zero stars kept as 0 columns)."""
    star = F.round(F.col(rating), 0)
    return reviews.groupBy(*_k(keys)).agg(*[F.count_if(star == s).alias(f"star_{s}") for s in range(1, 6)])


# ------------------------------------------------------------------ E08
def sentiment_distribution(reviews: DataFrame, keys=("product_id",), label: str = "sentiment_label") -> DataFrame:
    k = _k(keys)
    g = reviews.groupBy(*k).agg(F.count(F.lit(1)).alias("n"),
                                F.count_if(F.col(label) == "positive").alias("n_positive"),
                                F.count_if(F.col(label) == "negative").alias("n_negative"))
    g = g.withColumn("n_neutral", F.col("n") - F.col("n_positive") - F.col("n_negative"))
    for c in ("positive", "neutral", "negative"):
        g = g.withColumn(f"pct_{c}", F.round(100.0 * F.col(f"n_{c}") / F.col("n"), 1))
    return g


# ------------------------------------------------------------------ E09
def skin_breakdown(reviews: DataFrame, keys=("product_id",), label: str = "skin_type", top: int = 3) -> DataFrame:
    """Label counts per product and the top labels formatted 'label (n)'."""
    k = _k(keys)
    counts = reviews.where(F.col(label).isNotNull()).groupBy(*k, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*k).orderBy(F.desc("n"), label)
    ranked = counts.withColumn("rank", F.row_number().over(w))
    topk = (ranked.where(F.col("rank") <= top).groupBy(*k)
                  .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", label, "n"))),
                                                lambda s: F.format_string("%s (%d)", s[label], s["n"])), ", ")
                       .alias("top_labels")))
    return topk


# ------------------------------------------------------------------ E11
def concat_distinct(df: DataFrame, keys, value: str, sep: str = "; ", out: str = "joined") -> DataFrame:
    """Distinct values joined in sorted order (collect_set is bounded by distinct values)."""
    return df.groupBy(*_k(keys)).agg(F.array_join(F.sort_array(F.collect_set(value)), sep).alias(out))


def concat_first(df: DataFrame, keys, value: str, order: str, n: int = 5, sep: str = ". ",
                 out: str = "joined") -> DataFrame:
    """First n values by ``order`` joined; the rank filter runs before the collect."""
    k = _k(keys)
    w = Window.partitionBy(*k).orderBy(order)
    r = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return r.groupBy(*k).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", value))),
                                                      lambda s: s[value]), sep).alias(out))


# ------------------------------------------------------------------ E12
def mode_per_group(df: DataFrame, keys, value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group; ties -> smallest.  Counts are pre-aggregated."""
    k = _k(keys)
    c = df.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*k).orderBy(F.desc("_n"), F.col(value))
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*k, F.col(value).alias(out))


# ------------------------------------------------------------------ E13
def category_health(df: DataFrame, keys=("dealer_id", "category"), status: str = "stock_status",
                    risk: str = "risk_level") -> DataFrame:
    healthy = (F.col(status) == "normal") & F.col(risk).isin("none", "low")
    g = df.groupBy(*_k(keys)).agg(F.count(F.lit(1)).alias("total"), F.count_if(healthy).alias("healthy"))
    return g.withColumn("health_pct", F.round(100.0 * F.col("healthy") / F.greatest(F.col("total"), F.lit(1)), 1))


# ------------------------------------------------------------------ E14
def tenant_kpis(df: DataFrame, tenant: str = "dealer_id", status: str = "stock_status",
                risk: str = "risk_level", stock_risk: str = "stockout_risk",
                sales: str = "total_sales") -> DataFrame:
    return df.groupBy(tenant).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col(status) == "understock").alias("understock_count"),
        F.count_if(F.col(status) == "overstock").alias("overstock_count"),
        F.count_if(F.col(risk).isin("high", "medium")).alias("harmful_count"),
        F.count_if((F.col(stock_risk) == "HIGH") | (F.col(risk) == "high")).alias("critical_alerts"),
        F.sum(sales).alias("total_sales"))


# ------------------------------------------------------------------ E15
def catalog_stats(df: DataFrame, brand: str = "brand", category: str = "category",
                  ingredients: str = "ingredients", exclude: str = "general") -> DataFrame:
    """One row: products, distinct brands, with-ingredients, top category (excl. ``exclude``)."""
    base = df.agg(F.count(F.lit(1)).alias("total_products"),
                  F.count_distinct(brand).alias("distinct_brands"),
                  F.count_if(F.length(F.coalesce(F.col(ingredients), F.lit(""))) > 0).alias("with_ingredients"))
    cats = (df.where(F.col(category).isNotNull() & (F.lower(F.col(category)) != exclude))
              .groupBy(category).agg(F.count(F.lit(1)).alias("n")))
    top = cats.orderBy(F.desc("n"), category).limit(1).select(F.col(category).alias("top_category"))
    return base.crossJoin(top)


def top_categories(df: DataFrame, category: str = "category", n: int = 6) -> DataFrame:
    c = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), category).limit(n)


# ------------------------------------------------------------------ E16
def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Frequency and share of each value; the share uses a single global total row."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("_t"))
    out = c.crossJoin(F.broadcast(tot)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    if top is not None:
        out = out.orderBy(F.desc("n"), col).limit(top)
    return out


# ------------------------------------------------------------------ E17
def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width bins 1..bins (values == hi fall in the last bin)."""
    b = F.least(F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.where(F.col(col).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cut_labels(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """pandas.cut with right-closed bins (e0, e1], (e1, e2], ..."""
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


# ------------------------------------------------------------------ E18
def top_terms(df: DataFrame, text: str, n: int = 20, min_len: int = 1) -> DataFrame:
    toks = df.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("term"))
    toks = toks.where(F.length("term") >= min_len)
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)


# ------------------------------------------------------------------ E19
def missing_report(df: DataFrame, name: str) -> DataFrame:
    """Per column: missing count and % (one aggregate pass, then unpivot)."""
    n = F.count(F.lit(1)).alias("_rows")
    miss = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    agg = df.agg(n, *miss)
    long = agg.unpivot(["_rows"], df.columns, "column", "missing")
    return (long.withColumn("table", F.lit(name))
                .withColumn("missing_pct", F.round(100.0 * F.col("missing") / F.greatest(F.col("_rows"), F.lit(1)), 2))
                .withColumnRenamed("_rows", "rows"))


def missing_summary(df: DataFrame, name: str) -> DataFrame:
    """Per table: rows, columns, missing cells, % and status."""
    cells = sum(F.count_if(F.col(c).isNull()) for c in df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("rows"), cells.alias("missing_cells"))
    ncols = len(df.columns)
    pct = F.round(100.0 * F.col("missing_cells") / F.greatest(F.col("rows") * ncols, F.lit(1)), 2)
    return (agg.withColumn("table", F.lit(name)).withColumn("columns", F.lit(ncols))
               .withColumn("missing_pct", pct)
               .withColumn("status", F.when(F.col("rows") == 0, "empty")
                           .when(F.col("missing_cells") == 0, "complete").otherwise("has_missing")))


# ------------------------------------------------------------------ E20
def score_percentiles(df: DataFrame, col: str, pcts: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles (linear interpolation, from one distributed sort), mean,
    population std, min, max."""
    from .listing import exact_quantiles
    q = exact_quantiles(df, col, pcts)
    q = q.toDF(*[f"p{int(round(p * 100))}" for p in pcts])
    stats = df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                   F.min(col).alias("min"), F.max(col).alias("max"))
    return q.crossJoin(stats)


# ------------------------------------------------------------------ E21
def diversity_ratio(df: DataFrame, text: str, keys=("product_id",)) -> DataFrame:
    """distinct bodies / total, plus duplicate rows within a product."""
    k = _k(keys)
    dups = (df.groupBy(*k, text).agg(F.count(F.lit(1)).alias("_n"))
              .agg(F.sum(F.col("_n") - 1).alias("dup_within_product")))
    tot = df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(text).alias("distinct_bodies"))
    return tot.crossJoin(dups).withColumn("diversity", F.col("distinct_bodies") / F.col("total"))


# ------------------------------------------------------------------ E22
def drop_duplicates_keyed(df: DataFrame, keys, order: Sequence[Column]) -> DataFrame:
    """First row per key by a stated order."""
    w = Window.partitionBy(*_k(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# ------------------------------------------------------------------ E23
def safety_stats(df: DataFrame, score: str = "safety_score", safe_at: float = 80, unsafe_below: float = 50) -> DataFrame:
    s = F.col(score)
    n = F.count(F.lit(1))
    return df.agg(F.round(F.avg(s), 4).alias("mean_score"),
                  F.count_if(s >= safe_at).alias("n_safe"),
                  F.count_if((s >= unsafe_below) & (s < safe_at)).alias("n_moderate"),
                  F.count_if(s < unsafe_below).alias("n_unsafe"),
                  F.round(100.0 * F.count_if(s >= safe_at) / n, 2).alias("pct_safe"),
                  F.round(100.0 * F.count_if(s < unsafe_below) / n, 2).alias("pct_unsafe"))
