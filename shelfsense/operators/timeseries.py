"""Demand aggregation and time-series features.

All functions are lazy DataFrame -> DataFrame transformations.  Windows are
always partitioned by product (or tenant, product) and run *after* the data
has been aggregated to one row per (product, period), so a window partition
holds at most one row per period and never a raw-sales group.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# ------------------------------------------------------------------ E01
def monthly_units(sales: DataFrame, keys=("dealer_id", "product_id"), units: str = "units_sold",
                  year: str = "year", month: str = "month", out: str = "units") -> DataFrame:
    """Sum of units per (keys, year, month); NULL periods and units <= 0 excluded."""
    k = _keys(keys)
    return (sales.where(F.col(year).isNotNull() & F.col(month).isNotNull() & (F.col(units) > 0))
                 .groupBy(*k, year, month)
                 .agg(F.sum(units).alias(out)))


# ------------------------------------------------------------------ E02
def week_ending_sunday(ts: Column) -> Column:
    """Sunday that closes the Monday-based week containing ``ts``."""
    return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)


def weekly_demand(sales: DataFrame, keys=("product_id",), units: str = "units_sold",
                  ts: str = "sale_date", out: str = "units") -> DataFrame:
    """Sum of units per (keys, week ending Sunday); negative or unparseable rows dropped."""
    k = _keys(keys)
    return (sales.where(F.col(ts).isNotNull() & F.col(units).isNotNull() & (F.col(units) >= 0))
                 .groupBy(*k, week_ending_sunday(F.col(ts)).alias("week_end"))
                 .agg(F.sum(units).alias(out)))


# ------------------------------------------------------------------ E03
def weekly_dense(weekly: DataFrame, keys=("product_id",), week: str = "week_end",
                 value: str = "units", calendar: bool = True) -> DataFrame:
    """Zero-filled weekly series.

    ``calendar=True``: every week between the product's first and last week
    (pandas ``resample``).  ``calendar=False``: every week observed for any
    product (``unstack(fill_value=0)``), from the product's series only.
    The calendar is filled from each week to the product's next one (its last to ``_hi``),
    inside the product's own partition: the filled rows, many times the observed ones,
    are not shuffled, and windows by product find them in place.  A week off the 7-day grid of the
    product's first one has no slot.  Rows without a key have no sales of their own: zeros.
    """
    k = _keys(keys)
    if calendar:
        own, in_order = Window.partitionBy(*k), Window.partitionBy(*k).orderBy(week)
        days = F.expr("INTERVAL 7 DAYS")
        w = weekly.where(F.col(week).isNotNull()).select(*k, week, value, F.min(week).over(own).alias("_lo"), F.max(week).over(own).alias("_hi"))
        w = w.where(F.pmod(F.datediff(week, "_lo"), F.lit(7)) == 0).withColumn("_next", F.lead(week).over(in_order))
        until = F.when(F.col("_next").isNull(), F.col("_hi")).otherwise(F.greatest(F.col(week), (F.col("_next") - days).cast(weekly.schema[week].dataType)))
        known = F.lit(True)
        for c in k:
            known = known & F.col(c).isNotNull()
        # not ``posexplode``: the filter that is derived from it would build each sequence twice
        filled = w.select(*k, F.when(known, F.col(value)).alias("_v"), F.posexplode_outer(F.sequence(F.col(week), until, days)).alias("_i", week))
        return filled.select(*k, week, F.coalesce(F.when(F.col("_i") == 0, F.col("_v")), F.lit(0.0)).alias(value))
    else:
        weeks = weekly.select(week).distinct()
        prods = weekly.select(*k).distinct()
        # weeks is bounded by the calendar span of the data (52 per year)
        spine = prods.crossJoin(F.broadcast(weeks))
    return (spine.join(weekly, [*k, week], "left")
                 .select(*k, week, F.coalesce(F.col(value), F.lit(0.0)).alias(value)))


# ------------------------------------------------------------------ E04
def weekly_pivot(weekly: DataFrame, product: str = "product_id", week: str = "week_end",
                 value: str = "units", products: Sequence | None = None) -> DataFrame:
    """Wide weeks x products.  ``products`` (the top-N ids) fixes the columns."""
    g = weekly.groupBy(week)
    g = g.pivot(product, list(products)) if products is not None else g.pivot(product)
    return g.agg(F.sum(value)).na.fill(0.0)


# ------------------------------------------------------------------ F06
def month_index(year: Column, month: Column) -> Column:
    return year * 12 + (month - 1)


def last_n_months(monthly: DataFrame, universe: DataFrame, as_of: _dt.date,
                  keys=("dealer_id", "product_id"), value: str = "units",
                  year: str = "year", month: str = "month", n: int = 12,
                  out: str = "monthly_sales") -> DataFrame:
    """12-slot monthly series ending at the month of ``as_of`` (slot n-1).

    * no sales at all                -> zeros
    * no sales inside the window     -> mean of all historic monthly totals
    * otherwise months without sales -> mean of the months with sales

    Months come from calendar arithmetic (``add_months`` semantics), so no
    month repeats or is skipped.  The aggregation buffer holds ``n`` numbers, so it is
    bounded whatever the history length and of fixed width: groups are hashed, not sorted.
    Every row of ``universe`` (all products) gets a series.
    """
    k = _keys(keys)
    end = as_of.year * 12 + as_of.month - 1
    ym = month_index(F.col(year), F.col(month))
    in_win = (ym >= F.lit(end - n + 1)) & (ym <= F.lit(end))
    stats = (monthly.groupBy(*k).agg(
        F.avg(value).alias("_hist_avg"),
        F.avg(F.when(in_win, F.col(value))).alias("_recent_avg"),
        *[F.max(F.when(ym == F.lit(end - n + 1 + i), F.col(value).cast("double"))).alias(f"_m{i}") for i in range(n)],
    ))
    filled = F.array(*[F.coalesce(F.col(f"_m{i}"), F.col("_recent_avg")) for i in range(n)])
    series = (F.when(F.col("_hist_avg").isNull(), F.array_repeat(F.lit(0.0), n))
               .when(F.col("_recent_avg").isNull(), F.array_repeat(F.col("_hist_avg").cast("double"), n))
               .otherwise(filled))
    return (universe.join(stats, k, "left")
                    .withColumn(out, series)
                    .withColumn("has_sales", F.col("_hist_avg").isNotNull())
                    .drop("_hist_avg", "_recent_avg", *[f"_m{i}" for i in range(n)]))


def explode_series(df: DataFrame, keys, series: str = "monthly_sales",
                   slot: str = "slot", value: str = "units") -> DataFrame:
    """One row per element of ``series``, with its place.

    Not by ``posexplode``: the planner derives a filter on the array's size from it and pushes that below the
    joins, where the whole expression that makes the array is inlined, each part as often as it is named."""
    k = _keys(keys)
    return df.select(*k, F.posexplode_outer(series).alias(slot, value)).where(F.col(slot).isNotNull())


# ------------------------------------------------------------------ F01-F04
def lag_features(series: DataFrame, keys=("product_id",), order: str = "week_end",
                 value: str = "units", lags: Sequence[int] = (1, 2, 4, 8),
                 drop_incomplete: bool = True) -> DataFrame:
    """lag_k of ``value`` per product ordered by week; rows with NULL lags dropped."""
    w = Window.partitionBy(*_keys(keys)).orderBy(order)
    out = series.select("*", *[F.lag(value, l).over(w).alias(f"lag_{l}") for l in lags])
    if drop_incomplete:
        out = out.dropna(subset=[f"lag_{l}" for l in lags])
    return out


def rolling_features(series: DataFrame, keys=("product_id",), order: str = "week_end",
                     value: str = "units", windows: Sequence[int] = (4, 8),
                     std: str = "samp") -> DataFrame:
    """Mean/std of the previous k values (current row excluded)."""
    base = Window.partitionBy(*_keys(keys)).orderBy(order)
    stdf = F.stddev_samp if std == "samp" else F.stddev_pop
    cols = []
    for k in windows:
        w = base.rowsBetween(-k, -1)
        cols += [F.avg(value).over(w).alias(f"rolling_mean_{k}"),
                 stdf(value).over(w).alias(f"rolling_std_{k}")]
    return series.select("*", *cols)


def trend_feature(df: DataFrame, short: str = "lag_1", long: str = "lag_4",
                  out: str = "trend_4") -> DataFrame:
    return df.withColumn(out, F.col(short) - F.col(long))


def expanding_mean(series: DataFrame, keys=("product_id",), order: str = "week_end",
                   value: str = "units", out: str = "expanding_mean") -> DataFrame:
    w = (Window.partitionBy(*_keys(keys)).orderBy(order)
               .rowsBetween(Window.unboundedPreceding, -1))
    return series.withColumn(out, F.avg(value).over(w))


# ------------------------------------------------------------------ F07
def recent_sales_tail(sales: DataFrame, keys=("product_id",), order: str = "sale_date",
                      value: str = "units_sold", n: int = 12, tie: str | None = None) -> DataFrame:
    """Last ``n`` observations per product as an ordered array, plus total and count.

    The rank filter runs before the collect (planned as a WindowGroupLimit,
    i.e. a map-side top-n), so a hot product never collects its whole history.
    """
    k = _keys(keys)
    order_cols = [F.col(order).desc()] + ([F.col(tie).desc()] if tie else [])
    w = Window.partitionBy(*k).orderBy(*order_cols)
    totals = sales.groupBy(*k).agg(F.sum(value).alias("total_units"),
                                   F.count(F.lit(1)).alias("n_obs"))
    tail = (sales.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
                 .groupBy(*k)
                 .agg(F.sort_array(F.collect_list(F.struct(F.col("_rn"), F.col(value).alias("v"))),
                                   asc=False).alias("_t")))
    return (totals.join(tail, k)
                  .select(*k, "total_units", "n_obs",
                          F.transform("_t", lambda s: s["v"]).alias("recent_sales")))


# ------------------------------------------------------------------ F08-F09
def demand_change(df: DataFrame, history: str = "history", forecast: str = "forecast",
                  up: float = 2.0, down: float = -2.0, pattern_band: float = 0.10) -> DataFrame:
    """% change of last forecast vs last history value and its direction/pattern."""
    last_h = F.element_at(F.col(history), -1)
    last_f = F.element_at(F.col(forecast), -1)
    pct = (last_f - last_h) / F.greatest(F.lit(1.0), last_h) * 100.0
    mean_h = F.aggregate(F.col(history), F.lit(0.0), lambda a, x: a + x) / F.size(history)
    return (df.withColumn("demand_change_pct", pct)
              .withColumn("trend", F.when(pct > up, "increasing")
                                    .when(pct < down, "decreasing").otherwise("stable"))
              .withColumn("pattern", F.when(last_f > mean_h * (1 + pattern_band), "upward")
                                      .when(last_f < mean_h * (1 - pattern_band), "downward")
                                      .otherwise("stable")))


def array_mean(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)


def array_std_pop(c: Column) -> Column:
    # the mean travels in the buffer: a lambda that refers to it would work it out again for each element
    start = F.struct(F.lit(0.0).alias("s"), array_mean(c).alias("m"))
    total = F.aggregate(c, start, lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")))
    return F.sqrt(total["s"] / F.size(c))


def volatility(df: DataFrame, history: str = "history", high: float = 0.4,
               medium: float = 0.15) -> DataFrame:
    """CV = population std / max(1, mean); label and confidence = clip(95 - 25 CV, 10, 99)."""
    cv = array_std_pop(F.col(history)) / F.greatest(F.lit(1.0), array_mean(F.col(history)))
    return (df.withColumn("cv", cv)
              .withColumn("volatility", F.when(F.col("cv") > high, "high")
                                         .when(F.col("cv") > medium, "medium").otherwise("low"))
              .withColumn("confidence_score",
                          F.least(F.lit(99.0), F.greatest(F.lit(10.0), 95.0 - 25.0 * F.col("cv")))))


def volatility_grouped(series: DataFrame, keys=("product_id",), value: str = "units",
                       high: float = 0.4, medium: float = 0.15) -> DataFrame:
    """Same as :func:`volatility` computed from a long series with one aggregation."""
    cv = F.stddev_pop(value) / F.greatest(F.lit(1.0), F.avg(value))
    return (series.groupBy(*_keys(keys)).agg(cv.alias("cv"))
                  .withColumn("volatility", F.when(F.col("cv") > high, "high")
                                             .when(F.col("cv") > medium, "medium").otherwise("low"))
                  .withColumn("confidence_score",
                              F.least(F.lit(99.0), F.greatest(F.lit(10.0), 95.0 - 25.0 * F.col("cv")))))


# ------------------------------------------------------------------ F10
def popularity_score(df: DataFrame, reviews: str = "review_count", sales: str = "total_sales",
                     w_reviews: float = 0.4, w_sales: float = 0.6, out: str = "popularity") -> DataFrame:
    """w_r * reviews/max + w_s * sales/max over all rows, 4 dp.

    The two maxima are one global aggregate (a single row) joined back by
    broadcast; the per-row work stays distributed.
    """
    mx = df.agg(F.max(reviews).alias("_mr"), F.max(sales).alias("_ms"))
    score = (w_reviews * F.coalesce(F.try_divide(F.col(reviews), F.col("_mr")), F.lit(0.0))
             + w_sales * F.coalesce(F.try_divide(F.col(sales), F.col("_ms")), F.lit(0.0)))
    return df.crossJoin(F.broadcast(mx)).withColumn(out, F.round(score, 4)).drop("_mr", "_ms")


# ------------------------------------------------------------------ F11-F12
def chronological_split(series: DataFrame, keys=("product_id",), order: str = "week_end",
                        train_frac: float = 0.8, out: str = "split") -> DataFrame:
    """First ``train_frac`` of each product's rows by time -> train, rest -> test."""
    k = _keys(keys)
    w = Window.partitionBy(*k).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*k))
    cut = F.floor(n * train_frac)
    return series.withColumn(out, F.when(F.row_number().over(w) <= cut, "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 42,
                     test_frac: float = 0.2, out: str = "split") -> DataFrame:
    """Seeded 80/20 per class: rows ranked by md5(id || seed) inside their class.

    A class can hold half of all rows, so the in-class rank comes from one
    distributed global index over (class, hash) minus the class's start offset
    (a per-class table), not from a window partitioned by class."""
    from .ordering import global_index
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    cw = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    starts = counts.withColumn("_start", F.coalesce(F.sum("_nc").over(cw), F.lit(0)))
    idx = global_index(df.withColumn("_h", h), [F.col(label), F.col("_h"), F.col(id_col)], "_g")
    j = idx.join(F.broadcast(starts), label)
    pos = F.col("_g") - F.col("_start") + 1
    return (j.withColumn(out, F.when(pos <= F.ceil(F.col("_nc") * test_frac), "test").otherwise("train"))
             .drop("_h", "_g", "_nc", "_start"))


# ------------------------------------------------------------------ F13
def trend_label(series: DataFrame, keys=("product_id",), x: str = "week_idx", value: str = "units",
                strong: float = 0.015, moderate: float = 0.004) -> DataFrame:
    """Relative slope regr_slope(value, x)/avg(value) and its five-way label."""
    rel = F.try_divide(F.regr_slope(value, x), F.avg(value))
    return (series.groupBy(*_keys(keys)).agg(rel.alias("rel_slope"))
                  .withColumn("trend_label",
                              F.when(F.col("rel_slope") > strong, "strong_growth")
                               .when(F.col("rel_slope") > moderate, "moderate_growth")
                               .when(F.col("rel_slope") >= -moderate, "stable")
                               .when(F.col("rel_slope") >= -strong, "moderate_decline")
                               .otherwise("strong_decline")))


# ------------------------------------------------------------------ I07
def forecast_baseline(df: DataFrame, history: str = "history", steps: int = 7, growth: float = 0.03,
                      method: str = "mean_growth", empty_mean: float = 100.0, out: str = "forecast") -> DataFrame:
    """Model-free forecast: round(mean * (1 + growth * i), 1) for i = 0..steps-1,
    or the last value repeated (``method='repeat_last'``)."""
    h = F.col(history)
    if method == "repeat_last":
        fc = F.array_repeat(F.element_at(h, -1), steps)
    else:
        m = F.when(F.size(h) > 0, array_mean(h)).otherwise(F.lit(empty_mean))
        # the mean is the lambda's own argument, so that it is worked out once and not for each step
        fc = F.transform(F.array_repeat(m, steps), lambda v, i: F.round(v * (1 + F.lit(growth) * i), 1))
    return df.withColumn(out, fc)


# ------------------------------------------------------------------ F05
def forecast_feature_table(weekly: DataFrame, products: DataFrame, keys=("product_id",), week: str = "week_end",
                           value: str = "units", price: str = "price", category_code: str = "category_code",
                           price_scale: float = 10000.0, hash_mod: int = 1000) -> DataFrame:
    """Training table: lags 1,2,4,8, rolling mean/std (4, 8; sample std), trend, calendar
    features, season, Q4 holiday flag, scaled price, md5 product hash, encoded category.
    One window spec (partition by product, order by week) serves every feature."""
    from ..functions.text import hash_unit, season
    k = _keys(keys)
    f = lag_features(weekly, k, week, value, (1, 2, 4, 8), drop_incomplete=False)
    f = rolling_features(f, k, week, value, (4, 8), std="samp")
    f = trend_feature(f)
    f = (f.withColumn("month", F.month(week)).withColumn("week_of_year", F.weekofyear(week))
          .withColumn("quarter", F.quarter(week)).withColumn("season", season(F.month(week)))
          .withColumn("is_holiday_season", (F.quarter(week) == 4).cast("int")))
    p = products.select(*k, (F.col(price) / price_scale).alias("price_scaled"),
                        hash_unit(F.col(k[0]), hash_mod).alias("product_hash"), category_code)
    return f.join(p, k, "left").dropna(subset=["lag_1", "lag_2", "lag_4", "lag_8"])
