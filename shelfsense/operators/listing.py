"""Predicates, search, paging, top-k, sampling and sorts.

Per-group top-k is ``row_number() <= k`` over a partitioned window; Spark
plans it with a WindowGroupLimit that keeps only k rows per group *before*
the shuffle, so a hot group sends k rows per input partition, not all of
its rows.  Global top-k is ``orderBy().limit()`` (per-partition top-k and a
k-row merge).  Global positions use the distributed :func:`global_index`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_index


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def top_per_group(df: DataFrame, keys, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*_k(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


# ------------------------------------------------------------------ C01
def product_list(products: DataFrame, analysis: DataFrame, inventory: DataFrame,
                 keys=("dealer_id", "product_id"), category: str | None = None, name_like: str | None = None,
                 stock_status: Sequence[str] | None = None, risk: Sequence[str] | None = None,
                 page: int = 1, page_size: int = 20) -> DataFrame:
    """Filtered product list with the total count; one page ordered by the key."""
    k = _k(keys)
    df = products.join(analysis, k, "left").join(inventory, k, "left")
    if category is not None:
        df = df.where(F.col("category") == category)
    if name_like is not None:
        df = df.where(F.col("product_name").ilike(f"%{name_like}%"))
    if stock_status:
        df = df.where(F.col("stock_status").isin(list(stock_status)))
    if risk:
        df = df.where(F.col("risk_level").isin(list(risk)))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page_df = df.orderBy(*k).offset((page - 1) * page_size).limit(page_size)
    return page_df.crossJoin(F.broadcast(total))


# ------------------------------------------------------------------ C02
def search_products(df: DataFrame, term: str, columns: Sequence[str],
                    has_ingredients: str | None = None, has_reviews: str | None = None) -> DataFrame:
    t = term.lower()
    cond = None
    for c in columns:
        cc = F.instr(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(t)) > 0
        cond = cc if cond is None else (cond | cc)
    out = df.where(cond)
    if has_ingredients:
        out = out.where(F.length(F.coalesce(F.col(has_ingredients), F.lit(""))) > 0)
    if has_reviews:
        out = out.where(F.col(has_reviews) > 0)
    return out


# ------------------------------------------------------------------ C03
def review_list(reviews: DataFrame, products: DataFrame, product: str = "product_id",
                category: str = "category", date: str = "review_date", source: str | None = None,
                min_rating: float | None = None, max_rating: float | None = None,
                sentiment: str | None = None, peers: int = 20, page_size: int = 10) -> DataFrame:
    """Per product its newest reviews (one page); products with none get the
    reviews of up to ``peers`` same-category products (smallest ids) instead."""
    r = reviews
    if source is not None:
        r = r.where(F.col("source") == source)
    if min_rating is not None:
        r = r.where(F.col("rating") >= min_rating)
    if max_rating is not None:
        r = r.where(F.col("rating") <= max_rating)
    if sentiment is not None:
        r = r.where(F.col("sentiment_label") == sentiment)
    own = r.join(products.select(product), product, "left_semi").withColumn("for_product", F.col(product)) \
           .withColumn("fallback", F.lit(False))
    with_rev = r.select(product).distinct()
    empties = products.select(product, category).join(with_rev, product, "left_anti")
    cand = products.select(F.col(product).alias("_peer"), category).join(
        with_rev.withColumnRenamed(product, "_peer"), "_peer", "left_semi")
    peer_ids = top_per_group(cand, category, [F.col("_peer")], peers, "_pr").drop("_pr")
    fb = (empties.join(peer_ids, category)
                 .join(r.withColumnRenamed(product, "_peer"), "_peer")
                 .withColumnRenamed(product, "for_product").withColumnRenamed("_peer", product)
                 .withColumn("fallback", F.lit(True)).drop(category))
    allr = own.unionByName(fb, allowMissingColumns=True)
    return top_per_group(allr, "for_product", [F.col(date).desc(), F.col("review_id").desc()], page_size)


# ------------------------------------------------------------------ C04
def recent_reviews(reviews: DataFrame, keys=("product_id",), date: str = "review_date",
                   tie: str = "review_id", n: int = 10) -> DataFrame:
    return top_per_group(reviews, keys, [F.col(date).desc(), F.col(tie).desc()], n)


# ------------------------------------------------------------------ C05
def top_products(df: DataFrame, tenant: str = "dealer_id", trend: str = "forecast_trend",
                 priority: str = "priority_score", sales: str = "total_sales", key: str = "product_id",
                 n: int = 10) -> DataFrame:
    order = [F.when(F.col(trend) == "increasing", 1).otherwise(0).desc(), F.col(priority).desc(),
             F.col(sales).desc(), F.col(key)]
    return top_per_group(df, tenant, order, n)


# ------------------------------------------------------------------ C06
def diverse_top_k(df: DataFrame, score: str, keys=("dealer_id",), category: str = "category",
                  per_category: int = 2, k: int = 10, tie: str = "product_id") -> DataFrame:
    kk = _k(keys)
    cat = F.coalesce(F.trim(F.col(category)), F.lit("Other"))
    first = top_per_group(df.withColumn("_cat", cat), kk + ["_cat"], [F.col(score).desc(), F.col(tie)],
                          per_category, "_cr")
    return top_per_group(first, kk, [F.col(score).desc(), F.col(tie)], k).drop("_cat", "_cr")


# ------------------------------------------------------------------ C07
def top_n_by_total(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Rows of the n groups with the largest sum; the n-row key list is broadcast."""
    tops = (df.groupBy(group).agg(F.sum(value).alias("_t"))
              .orderBy(F.desc("_t"), group).limit(n).select(group))
    return df.join(F.broadcast(tops), group, "left_semi")


# ------------------------------------------------------------------ C08
def min_class_count(df: DataFrame, label: str, k: int) -> DataFrame:
    """Rows whose class has >= k rows: pre-aggregated counts, then a semi join
    (AQE splits a skewed class partition)."""
    keep = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(label)
    return df.join(keep, label, "left_semi")


# ------------------------------------------------------------------ C09
def exact_quantiles(df: DataFrame, col: str, ps: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation from a distributed sort.

    Values are globally indexed (distributed sort, per-partition offsets);
    only the two order statistics around each target position are kept.
    Returns one row with columns q_<p>.
    """
    vals = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    idx = global_index(vals, [F.col("_v")], "_i")
    n = vals.agg(F.count(F.lit(1)).alias("_n"))
    targets = []
    for p in ps:
        pos = (F.col("_n") - 1) * float(p)
        targets.append(F.struct(F.lit(float(p)).alias("p"), F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"),
                                (pos - F.floor(pos)).alias("frac")))
    t = n.select(F.explode(F.array(*targets)).alias("t")).select("t.*")
    lo = idx.join(F.broadcast(t), idx["_i"] == t["lo"]).select("p", "frac", F.col("_v").alias("v_lo"))
    hi = idx.join(F.broadcast(t.select(F.col("p").alias("p2"), "hi")), idx["_i"] == F.col("hi")) \
            .select(F.col("p2").alias("p"), F.col("_v").alias("v_hi"))
    both = lo.join(hi, "p").withColumn("q", F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac"))
    return both.groupBy().pivot("p", [float(p) for p in ps]).agg(F.first("q")) \
               .toDF(*[f"q_{str(p).replace('.', '_')}" for p in ps])


def outlier_trim(df: DataFrame, col: str, p: float = 0.99) -> DataFrame:
    q = exact_quantiles(df, col, [p]).withColumnRenamed(f"q_{str(p).replace('.', '_')}", "_q")
    return df.crossJoin(F.broadcast(q)).where(F.col(col) <= F.col("_q")).drop("_q")


# ------------------------------------------------------------------ C10
def valid_reviews(df: DataFrame, text: str, min_len: int = 20) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.where((F.length(t) >= min_len) & ~F.trim(t).rlike(r"^[0-9\s.,]+$"))


# ------------------------------------------------------------------ C11
def sample_every_k(df: DataFrame, order: str, k: int, cap: int | None = None) -> DataFrame:
    idx = global_index(df, [F.col(order)], "_i")
    out = idx.where(F.pmod(F.col("_i"), F.lit(k)) == 0)
    if cap is not None:
        out = out.where(F.col("_i") < cap * k)
    return out.drop("_i")


def sample_seeded(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Reproducible random n rows: smallest md5(id || seed)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(n).drop("_h")


def head_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


# ------------------------------------------------------------------ L01 / L02
def ranked_sort(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Sort with an explicit 0-based position column (distributed)."""
    return global_index(df, order, out)


# ------------------------------------------------------------------ L03
def set_ops(a: DataFrame, b: DataFrame, col: str) -> dict[str, DataFrame]:
    aa, bb = a.select(col), b.select(col)
    return {"intersect": aa.intersect(bb), "union": aa.union(bb).distinct(), "difference": aa.subtract(bb)}


# ------------------------------------------------------------------ L04
def union_dedup_priority(sources: Sequence[tuple[int, DataFrame]], keys, item: str) -> DataFrame:
    """Union of candidate lists; for each (keys, item) the row of the highest
    priority source (lowest number), then its own rank, wins."""
    parts = [df.withColumn("_prio", F.lit(p)) for p, df in sources]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*_k(keys), item).orderBy("_prio", *([F.col("src_rank")] if "src_rank" in u.columns else []))
    return u.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r") \
            .withColumnRenamed("_prio", "source_priority")
