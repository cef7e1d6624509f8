"""Business rules: stock status, decisions, priorities, verification.

Each rule is a column expression (a ``when`` chain) evaluated inside one
projection, so it is fused into the surrounding whole-stage-codegen span and
needs no shuffle.  Thresholds are parameters whose defaults are the
reference's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import array_mean


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


# ------------------------------------------------------------------ G01
def stock_status(df: DataFrame, stock: str = "current_stock", series: str = "monthly_sales",
                 last_k: int = 3, floor: float = 1.0, cap: float = 5000.0,
                 high_days: float = 7, medium_days: float = 30, watch_days: float = 90,
                 over_days: float = 180) -> DataFrame:
    """Days of cover from the mean of the last ``last_k`` months.

    Adds avg_monthly_raw (unfloored, used by the decision rule), avg_monthly,
    daily_rate, days_until_stockout (1 dp), stock_status and stockout_risk.
    The status is decided on the unrounded days.
    """
    # the mean is a column of its own, read by the others: not worked out again for each of them
    raw = array_mean(F.slice(F.col(series), -last_k, last_k))
    avg = _clip(F.col("avg_monthly_raw"), floor, cap)
    days = F.col(stock) / (avg / 30.0)
    status = (F.when(days < high_days, "understock").when(days < medium_days, "understock")
               .when(days > over_days, "overstock").when(days > watch_days, "watch")
               .otherwise("normal"))
    risk = (F.when(days < high_days, "HIGH").when(days < medium_days, "MEDIUM").otherwise("LOW"))
    return (df.withColumn("avg_monthly_raw", raw)
              .withColumn("avg_monthly", F.round(avg, 1))
              .withColumn("daily_rate", F.round(avg / 30.0, 2))
              .withColumn("days_until_stockout", F.round(days, 1))
              .withColumn("stock_status", status)
              .withColumn("stockout_risk", risk))


# ------------------------------------------------------------------ H04
def risk_level(score: Column, high: float = 60, medium: float = 80) -> Column:
    return F.when(score < high, "high").when(score < medium, "medium").otherwise("none")


# ------------------------------------------------------------------ G02
def stock_decision(df: DataFrame, days: str = "days_until_stockout", status: str = "stock_status",
                   risk: str = "risk_level", avg_monthly: str = "avg_monthly_raw",
                   trend: str = "forecast_trend") -> DataFrame:
    """Nine ordered rules -> (stock_decision, decision_reason, priority_score).

    ``avg_monthly`` should be the unfloored mean so the "no sales" rule is
    reachable; the reorder quantities use it as well.
    """
    d = F.coalesce(F.col(days), F.lit(9999.0))
    am = F.col(avg_monthly)
    r3 = F.greatest(F.floor(am * 3), F.lit(50)).cast("long")
    r2 = F.greatest(F.floor(am * 2), F.lit(30)).cast("long")
    r15 = F.floor(am * 1.5).cast("long")
    d1 = F.round(d, 1).cast("string")
    d0 = F.round(d, 0).cast("long")
    rules = [
        (F.col(risk) == "high", "REMOVE FROM SALE",
         F.lit("Product contains HIGH risk harmful ingredients. Immediate removal recommended "
               "to protect customers and avoid liability."), 100.0),
        ((am <= 0) & (F.col(status) == "understock"), "INVESTIGATE",
         F.lit("Stock is low but no sales history found. Confirm if product is new or discontinued."), 40.0),
        (am <= 0, "MONITOR",
         F.lit("No sales history available. Add sales data to get accurate decisions."), 20.0),
        (d < 3, "AGGRESSIVE RESTOCK",
         F.format_string("CRITICAL: Only %s day(s) of stock remaining at current sales rate. "
                         "Order at least %d units immediately to cover 3 months of demand.", d1, r3), 95.0),
        (d < 7, "RESTOCK URGENTLY",
         F.format_string("Stock will run out in %s days. Order %d units within 48 hours to avoid stockout.",
                         d1, r2), 85.0),
        (d < 14, "RESTOCK SOON",
         F.format_string("%d days of stock left. Place order for %d units within the week.", d0, r2), 70.0),
        (F.col(risk) == "medium", "CAUTION — DO NOT RESTOCK",
         F.lit("Product contains medium-risk ingredients. Do not order more stock. "
               "Evaluate safety report before next purchase order."), 65.0),
        ((F.col(status) == "overstock") & (F.col(trend) == "decreasing"), "REDUCE PRICE — CLEAR STOCK",
         F.format_string("%d days of supply on hand and demand is declining. "
                         "Offer 15-25%% discount to clear inventory.", d0), 60.0),
        (F.col(status) == "overstock", "HOLD — MONITOR SALES",
         F.format_string("%d days of supply on hand. Sales are stable. "
                         "Do not reorder until stock drops below %d units.", d0, r15), 35.0),
        ((F.col(trend) == "increasing") & (F.col(status) == "normal"), "INCREASE STOCK",
         F.format_string("Demand is trending upward. Consider ordering %d extra units to prepare for surge.",
                         r15), 50.0),
    ]
    default = ("MAINTAIN STOCK",
               F.format_string("Stock levels healthy with %d days of supply. "
                               "Reorder when stock drops below %d units.", d0, r15), 25.0)

    def chain(idx: int):
        dec, rea, pri = F.lit(default[0]), default[1], F.lit(default[2])
        for cond, dd, rr, pp in reversed(rules):
            dec = F.when(cond, F.lit(dd)).otherwise(dec)
            rea = F.when(cond, rr).otherwise(rea)
            pri = F.when(cond, F.lit(pp)).otherwise(pri)
        return (dec, rea, pri)[idx]

    return (df.withColumn("stock_decision", chain(0))
              .withColumn("decision_reason", chain(1))
              .withColumn("priority_score", chain(2)))


# ------------------------------------------------------------------ G03
def retail_decision(df: DataFrame, price: str = "price", cost: str = "cost_price",
                    stock: str = "current_stock", lead: str = "lead_time_days",
                    history: str = "history", forecast: str = "forecast",
                    safety: str = "safety_score", change: str = "demand_change_pct") -> DataFrame:
    """Inventory engine: days of inventory, reorder point, lead-time risk, margin, decision.

    The stricter CLEARANCE rule is tested before REDUCE so it is reachable.
    """
    f_daily = array_mean(F.col(forecast)) / 7.0
    margin = F.greatest(F.lit(0.01), (F.col(price) - F.col(cost)) / F.greatest(F.lit(0.01), F.col(price)))
    doi = F.col(stock) / F.greatest(F.lit(1.0), F.col("_f_daily"))
    rop = F.col("_f_daily") * F.col(lead)
    out = (df.withColumn("_f_daily", f_daily)
             .withColumn("profit_margin", margin)
             .withColumn("days_of_inventory", doi)
             .withColumn("reorder_point", rop))
    lrisk = (F.when(F.col("days_of_inventory") < F.col(lead), "HIGH")
              .when(F.col("days_of_inventory") < F.col(lead) * 1.5, "MEDIUM").otherwise("LOW"))
    out = out.withColumn("lead_time_risk", lrisk)
    s, ch, st, rp = F.col(safety), F.col(change), F.col(stock), F.col("reorder_point")
    decision = (F.when(s < 60, "REMOVE FROM SALE")
                 .when(s < 85, "CAUTION / REVIEW")
                 .when((F.col("lead_time_risk") == "HIGH") & (F.col("profit_margin") > 0.4), "AGGRESSIVE RESTOCK")
                 .when(F.col("lead_time_risk") == "HIGH", "RESTOCK CAREFULLY")
                 .when((ch > 5) & (st <= rp * 1.5), "INCREASE STOCK")
                 .when((ch < -10) & (st > rp * 3), "CLEARANCE SALE")
                 .when((ch < -5) & (st > rp * 2), "REDUCE STOCK")
                 .when(F.col("cv") > 0.35, "MONITOR CLOSELY")
                 .otherwise("MAINTAIN STOCK"))
    return out.withColumn("retail_decision", decision).drop("_f_daily")


# ------------------------------------------------------------------ G04
def priority_score(df: DataFrame, change: str = "demand_change_pct", doi: str = "days_of_inventory",
                   margin: str = "profit_margin", cv: str = "cv", safety: str = "safety_score",
                   out: str = "retail_priority") -> DataFrame:
    inv = F.least(F.lit(10.0), 1.0 / F.greatest(F.lit(0.1), F.col(doi)))
    raw = F.col(change) + 50.0 * inv + 2000.0 * F.col(margin) - 100.0 * F.col(cv)
    base = _clip(30.0 + 0.5 * raw, 0.0, 100.0)
    score = (F.when(F.col(safety) < 60, F.lit(0.0))
              .when(F.col(safety) < 85, F.least(base, F.lit(40.0)))
              .otherwise(base))
    return df.withColumn(out, score)


# ------------------------------------------------------------------ G05
def confidence_band(df: DataFrame, forecast: str = "forecast", cv: str = "cv",
                    out: str = "confidence_band") -> DataFrame:
    """Per step i: p -/+ (0.05 + 0.02 i + 0.1 cv) p, as array<struct<lo, hi>>."""
    def band(p, i):
        m = (0.05 + 0.02 * i + 0.1 * F.col(cv)) * p
        return F.struct((p - m).alias("lo"), (p + m).alias("hi"))
    return df.withColumn(out, F.transform(F.col(forecast), band))


# ------------------------------------------------------------------ G06
def restock_recommendation(df: DataFrame, forecast: str = "forecast",
                           stock: str | None = "current_stock", out: str = "recommendation") -> DataFrame:
    avg = array_mean(F.col(forecast))
    if stock is not None:
        cover = F.when(avg > 0, F.col(stock) / avg).otherwise(F.lit(0.0))
        by_cover = (F.when(cover < 2, "Buy More").when(cover > 6, "Hold").otherwise("Monitor"))
        by_mean = (F.when(avg > 500, "Buy More").when(avg > 100, "Maintain").otherwise("Review slow-moving"))
        rec = F.when(F.col(stock).isNotNull(), by_cover).otherwise(by_mean)
    else:
        rec = (F.when(avg > 500, "Buy More").when(avg > 100, "Maintain").otherwise("Review slow-moving"))
    return df.withColumn(out, rec)


# ------------------------------------------------------------------ G07
def verification_status(df: DataFrame, ingredients: str = "ingredients", safety: str = "safety_score",
                        skin: str = "skin_type", reviews: str = "review_count",
                        rating: str = "avg_rating", sales: str = "total_sales",
                        risk: str = "risk_level", out: str = "verification_status",
                        ingredients_is_length: bool = False) -> DataFrame:
    ing_len = F.col(ingredients) if ingredients_is_length else F.length(F.col(ingredients))
    checks = [
        F.coalesce(ing_len > 10, F.lit(False)),
        F.coalesce(F.col(safety) >= 60, F.lit(False)),
        F.coalesce((F.col(skin).isNotNull()) & (F.col(skin) != ""), F.lit(False)),
        F.coalesce(F.col(reviews) >= 3, F.lit(False)),
        F.coalesce(F.col(rating) >= 3.5, F.lit(False)),
        F.coalesce(F.col(sales) > 0, F.lit(False)),
        F.lit(True),
        F.coalesce(F.col(risk) != "high", F.lit(True)),
    ]
    passed = sum(c.cast("int") for c in checks)
    return df.withColumn("checks_passed", passed).withColumn(
        out, F.when(F.col("checks_passed") == 8, "fully_verified")
              .when(F.col("checks_passed") >= 6, "partial")
              .when(F.col(risk) == "high", "flagged")
              .otherwise("unverified"))


# ------------------------------------------------------------------ G15
def horizon_band(horizon: int) -> tuple[int, int]:
    for lim, band in ((1, (0, 1)), (7, (0, 7)), (21, (3, 21)), (30, (7, 30)), (90, (14, 90))):
        if horizon <= lim:
            return band
    return (30, 180)


def horizon_score(df: DataFrame, horizon: int = 30, days: str = "days_until_stockout",
                  trend: str = "forecast_trend", status: str = "stock_status",
                  risk: str = "stockout_risk", rating: str = "avg_rating") -> DataFrame:
    """Relevance of a product for a forecast horizon; keeps the candidates only.

    Candidates: days inside the band, or (horizon >= 21) rising with days > 0,
    or (shorter horizons) days within [0, horizon].  Score > 0 kept.
    """
    lo, hi = horizon_band(horizon)
    d = F.coalesce(F.col(days).cast("double"), F.lit(999.0))
    t = F.lower(F.coalesce(F.col(trend), F.lit("stable")))
    st = F.lower(F.coalesce(F.col(status), F.lit("normal")))
    rk = F.upper(F.coalesce(F.col(risk), F.lit("LOW")))
    pos = F.when((d >= lo) & (d <= hi), (1.0 - (d - lo) / max(hi - lo, 1)) * 60.0).otherwise(0.0)
    tr_bonus = 10.0 if horizon <= 7 else (30.0 if horizon <= 30 else 55.0)
    sc = (pos
          + F.when(t == "increasing", tr_bonus).when(t == "stable", 5.0).otherwise(0.0)
          + (F.when((st == "overstock") & (t == "increasing"), 20.0).otherwise(0.0) if horizon >= 30 else F.lit(0.0))
          + F.when(rk == "HIGH", 15.0).when(rk == "MEDIUM", 7.0).otherwise(0.0)
          + F.coalesce(F.col(rating).cast("double"), F.lit(0.0)) * 2.0)
    in_band = F.col(days).between(lo, hi)
    alt = ((F.col(trend) == "increasing") & (F.col(days) > 0)) if horizon >= 21 \
        else F.col(days).between(0, horizon)
    return (df.where(in_band | alt)
              .withColumn("horizon_score", F.round(sc, 2))
              .where(F.col("horizon_score") > 0))


# ------------------------------------------------------------------ G18
def retail_kpis(df: DataFrame, keys=("dealer_id",), risk: str = "lead_time_risk",
                change: str = "demand_change_pct", growth: float = 2.0) -> DataFrame:
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(
        F.count_if(F.col(risk) == "HIGH").alias("high_risk"),
        F.count_if(F.col(change) > growth).alias("growing"))
