"""Notifications and alert feeds.

The rules are classes of one pass: each row of the analysis gives a row for every
class that it belongs to, and one window by (tenant, class) keeps the first ones of those
with a limit.  The analysis behind them is worked out once, not once for each rule.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_ORDER = ["critical", "high", "medium", "low"]


def _name40(n: int = 40) -> Column:
    return F.substring(F.coalesce(F.col("product_name"), F.lit("")), 1, n)


def _days0() -> Column:
    return F.round(F.col("days_until_stockout"), 0).cast("long")


def _ranked(df: DataFrame, tenant: str, classes: Sequence[tuple]) -> DataFrame:
    """One row per row of ``df`` and class whose condition holds, in one pass over ``df``.

    ``classes``: (condition, limit or None, order columns, struct of the output).  Adds ``_out`` and ``_r``, the place in the
    tenant's class; rows beyond the limit go.  Orders are of doubles, by the class's first column and then by key."""
    kinds = [F.when(cond, F.struct(F.lit(n).alias("c"), F.lit(limit).cast("int").alias("most"), first.cast("double").alias("x"), second.alias("y"), out.alias("out")))
             for n, (cond, limit, (first, second), out) in enumerate(classes)]
    # outer: a filter derived from the array would work out the analysis twice
    one = df.select(tenant, F.explode_outer(F.array_compact(F.array(*kinds))).alias("_k")).where(F.col("_k").isNotNull())
    w = Window.partitionBy(tenant, "_k.c").orderBy("_k.x", "_k.y")
    one = one.withColumn("_r", F.row_number().over(w)).where(F.col("_k.most").isNull() | (F.col("_r") <= F.col("_k.most")))
    return one.select(tenant, F.col("_k.out").alias("_out"), "_r")


# ------------------------------------------------------------------ G10
def notifications(analysis: DataFrame, tenant: str = "dealer_id", key: str = "product_id",
                  harmful_limit: int = 10, overstock_limit: int = 10, surge_limit: int = 5) -> DataFrame:
    """Alerts of six classes by their own rules, limits and orders, from one pass over ``analysis``."""
    none, by_key = F.lit(None).cast("double"), F.col(key)

    def kind(cond, limit, first, ntype, severity, title, message):
        out = F.struct(F.col("product_id").alias("product_id"), F.lit(ntype).alias("notif_type"), title.alias("title"),
                       message.alias("message"), F.lit(severity).alias("severity"))
        return cond, limit, (first, by_key), out
    classes = [
        kind(F.col("stockout_risk") == "HIGH", None, none, "understock", "critical",
             F.concat(F.lit("⚠️ Critical Stockout: "), _name40()),
             F.format_string("Will stock out in %d days. Restock immediately.", _days0())),
        kind(F.col("stockout_risk") == "MEDIUM", None, none, "understock", "high",
             F.concat(F.lit("Low Stock: "), _name40()),
             F.format_string("%d days of inventory remaining.", _days0())),
        kind(F.col("risk_level") == "high", harmful_limit, none, "harmful", "critical",
             F.concat(F.lit("☠️ Harmful Ingredients: "), _name40()),
             F.lit("Product contains HIGH risk ingredients. Consider removing from inventory.")),
        kind(F.col("risk_level") == "medium", harmful_limit, none, "harmful", "medium",
             F.concat(F.lit("⚠️ Safety Warning: "), _name40()),
             F.lit("Product contains MEDIUM risk ingredients. Review before promoting.")),
        kind(F.col("stock_status") == "overstock", overstock_limit, none, "overstock", "low",
             F.concat(F.lit("Overstock: "), _name40()),
             F.format_string("Overstocked by %d days. Consider promotions.", _days0())),
        # highest score first, nulls last
        kind(F.col("forecast_trend") == "increasing", surge_limit, F.coalesce(-F.col("priority_score"), F.lit(float("inf"))),
             "surge", "medium", F.concat(F.lit("📈 Demand Surge: "), _name40()),
             F.lit("Demand is increasing. Ensure adequate stock levels.")),
    ]
    return _ranked(analysis, tenant, classes).select(tenant, "_out.*")


# ------------------------------------------------------------------ G11
def notification_dedup(new: DataFrame, existing: DataFrame, keys=("dealer_id", "product_id", "title")) -> DataFrame:
    """Keep a new alert only if no unread alert with the same (tenant, product, title) exists."""
    unread = existing.where(~F.col("is_read")).select(*keys).distinct()
    return new.join(unread, list(keys), "left_anti")


def severity_rank(c: Column) -> Column:
    out = None
    for i, s in enumerate(SEVERITY_ORDER):
        out = F.when(c == s, i) if out is None else out.when(c == s, i)
    return out.otherwise(len(SEVERITY_ORDER))


# ------------------------------------------------------------------ G12
def notification_feed(notifs: DataFrame, tenant: str = "dealer_id", limit: int = 50) -> DataFrame:
    """Unread, ordered by severity (critical first) then newest id; top ``limit`` per tenant."""
    w = Window.partitionBy(tenant).orderBy(severity_rank(F.col("severity")), F.col("notif_id").desc())
    return (notifs.where(~F.col("is_read")).withColumn("feed_rank", F.row_number().over(w))
                  .where(F.col("feed_rank") <= limit))


def notification_counts(notifs: DataFrame, tenant: str = "dealer_id") -> DataFrame:
    return notifs.where(~F.col("is_read")).groupBy(tenant, "notif_type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ G13
def notification_retention(notifs: DataFrame, as_of: _dt.datetime, days: int = 7) -> DataFrame:
    """Drop read notifications older than ``days`` before ``as_of``."""
    cutoff = F.lit(as_of - _dt.timedelta(days=days))
    return notifs.where(~(F.col("is_read") & (F.col("created_at") < cutoff)))


def mark_read(notifs: DataFrame, notif_ids: DataFrame | None = None, tenant_value=None,
              tenant: str = "dealer_id") -> DataFrame:
    """Mark one set of ids (semi-join list) or all of a tenant's notifications read."""
    if notif_ids is not None:
        hit = notif_ids.select(F.col("notif_id").alias("_hit")).distinct().withColumn("_m", F.lit(True))
        j = notifs.join(hit, notifs["notif_id"] == hit["_hit"], "left")
        return j.withColumn("is_read", F.col("is_read") | F.coalesce(F.col("_m"), F.lit(False))).drop("_hit", "_m")
    return notifs.withColumn("is_read", F.col("is_read") | (F.col(tenant) == F.lit(tenant_value)))


# ------------------------------------------------------------------ G14
def alert_feed(analysis: DataFrame, notifs: DataFrame | None = None, tenant: str = "dealer_id",
               key: str = "product_id", limit: int = 10, name_len: int = 45) -> DataFrame:
    """Six prioritised alert classes with their own limits and orders, plus up to
    five unread notifications not already present by (product, type); top ``limit``."""
    none, d = F.lit(None).cast("double"), F.col("days_until_stockout")
    nm = _name40(name_len)

    def kind(prio, cond, lim, first, atype, sev, title):
        out = F.struct(F.col(key).alias(key), F.lit(atype).alias("alert_type"), F.lit(sev).alias("severity"),
                       F.lit(prio).alias("priority"), title.alias("title"))
        return cond, lim, (first, F.col(key)), out
    classes = [
        kind(1, F.col("risk_level") == "high", 5, none, "harmful", "critical", F.concat(F.lit("☠️ Harmful: "), nm)),
        kind(2, (d >= 0) & (d < 3), 5, d, "understock", "critical", F.concat(F.lit("🔴 Critical Stock: "), nm)),
        kind(3, (d >= 3) & (d < 7), 3, d, "understock", "warning", F.concat(F.lit("🟠 Low Stock: "), nm)),
        kind(4, F.col("risk_level") == "medium", 3, none, "harmful", "medium", F.concat(F.lit("⚠️ Safety Warning: "), nm)),
        kind(5, (F.col("forecast_trend") == "increasing") & (F.col("stock_status") != "understock"), 3, none,
             "opportunity", "info", F.concat(F.lit("📈 Demand Rising: "), nm)),
        kind(6, F.col("stock_status") == "overstock", 3, none, "overstock", "warning", F.concat(F.lit("🟡 Excess Stock: "), nm)),
    ]
    out = _ranked(analysis, tenant, classes).select(tenant, "_out.*", F.col("_r").alias("class_rank"))
    if notifs is not None:
        present = out.select(tenant, key, F.col("alert_type").alias("notif_type"))
        # the five newest unread ones, then without those that a rule reports anyway; they come first
        w = Window.partitionBy(tenant).orderBy(F.col("notif_id").desc())
        extra = (notifs.where(~F.col("is_read")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 5)
                      .join(present, [tenant, key, "notif_type"], "left_anti")
                      .select(tenant, key, F.col("notif_type").alias("alert_type"), "severity",
                              F.lit(0).alias("priority"), "title", F.col("_r").alias("class_rank")))
        out = out.unionByName(extra)
    w = Window.partitionBy(tenant).orderBy("priority", "class_rank")
    return out.withColumn("feed_rank", F.row_number().over(w)).where(F.col("feed_rank") <= limit)
