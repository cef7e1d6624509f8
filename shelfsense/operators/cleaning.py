"""Frame-level cleaning and standardisation.

Column renames are resolved once on the driver from the schema (metadata
only); all value work is column expressions.  Global statistics needed by a
rule (a max, a median) are one aggregate row joined back by broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .ordering import dense_codes

# FIXED VALUES: header aliases, first present alias wins.
ALIASES: dict[str, list[str]] = {
    "product_name": ["product_name", "name", "productname", "product", "title", "label", "item",
                     "item_name", "product_title"],
    "brand": ["brand", "brand_name", "brandname", "manufacturer", "company"],
    "price": ["price", "price_usd", "cost", "amount", "sale_price", "list_price"],
    "rating": ["rating", "ratings", "avg_rating", "average_rating", "stars", "review_score", "score"],
    "ingredients": ["ingredients", "ingredient", "ingredient_list", "chemicals", "chemical_ingredients",
                    "composition"],
    "review_text": ["review", "review_text", "reviews", "comment", "feedback", "text", "review_body",
                    "review_comment", "cleaned_review"],
}


# B01
def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[tx.normalise_header(c) for c in df.columns])


# B02
def null_sentinels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: tx.null_if_sentinel(F.col(c)) for c in cols})


# B03
def unify_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    renames = {}
    for target, names in aliases.items():
        hit = next((a for a in names if a in df.columns and a not in renames), None)
        if hit and hit != target and target not in df.columns:
            renames[hit] = target
    return df.withColumnsRenamed(renames) if renames else df


def coalesce_aliases(df: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    """Row-level variant: first non-NULL among the alias columns present."""
    present = [F.col(a) for a in names if a in df.columns]
    return df.withColumn(target, F.coalesce(*present)) if present else df


# B10
def rescale_rating(df: DataFrame, col: str = "rating", scale: float = 5.0) -> DataFrame:
    mx = df.agg(F.max(col).alias("_mx"))
    return (df.crossJoin(F.broadcast(mx))
              .withColumn(col, F.when(F.col("_mx") > scale, F.col(col) / F.col("_mx") * scale)
                          .otherwise(F.col(col)))
              .drop("_mx"))


# B11
def impute(df: DataFrame, numeric: Sequence[str] | None = None, strings: Sequence[str] | None = None,
           fill_text: str = "unknown") -> DataFrame:
    """numeric NULL -> exact column median; string NULL -> 'unknown'.

    Each median is an exact order statistic from a distributed sort
    (:func:`listing.exact_quantiles`); the medians form one row joined back by
    broadcast.
    """
    from .listing import exact_quantiles
    num = numeric if numeric is not None else [f.name for f in df.schema.fields
                                               if isinstance(f.dataType, T.NumericType)]
    st = strings if strings is not None else [f.name for f in df.schema.fields
                                              if isinstance(f.dataType, T.StringType)]
    out = df
    if num:
        med = None
        for c in num:
            m = exact_quantiles(df, c, [0.5]).toDF(f"_med_{c}")
            med = m if med is None else med.crossJoin(m)
        out = out.crossJoin(F.broadcast(med)).withColumns(
            {c: F.coalesce(F.col(c), F.col(f"_med_{c}").cast(df.schema[c].dataType)) for c in num}
        ).drop(*[f"_med_{c}" for c in num])
    if st:
        out = out.fillna(fill_text, subset=list(st))
    return out


# B12
def dense_surrogate_id(df: DataFrame, col: str, prefix: str, out: str = "surrogate_id", width: int = 5) -> DataFrame:
    """PREFIX_00042 = 0-based rank of the normalised value among the sorted distinct values.

    Ranking runs over the distinct values only (one row per value); NULLs get no id.
    """
    norm = tx.normalise_text(F.col(col))
    ids = dense_codes(df.select(norm.alias("_v")), "_v", "_code")
    ids = ids.withColumn(out, F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("_code").cast("string"), width, "0")))
    return df.withColumn("_v", norm).join(ids.drop("_code"), "_v", "left").drop("_v")


# B16
def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Alphabetical 0-based codes over the distinct values (the code map is the distinct set);
    codes come from a distributed sort, not a single-partition window."""
    codes = dense_codes(df, col, out or f"{col}_code")
    return df.join(codes, col, "left")


# B22
# FIXED VALUES: category season profiles (peak month, amplitude).
SEASON_PROFILES = {"sunscreen": (5, 0.35), "cream": (12, 0.25), "serum": (1, 0.10), "default": (6, 0.0)}


def season_factor(df: DataFrame, category: str, month: str, units: str | None = None,
                  profiles: Mapping[str, tuple[int, float]] = SEASON_PROFILES) -> DataFrame:
    """1 + amplitude * cos(pi * d / 6), d = circular month distance to the peak;
    effective units = max(5, units * factor)."""
    pm = F.create_map(*[x for k, (p, _a) in profiles.items() for x in (F.lit(k), F.lit(p))])
    am = F.create_map(*[x for k, (_p, a) in profiles.items() for x in (F.lit(k), F.lit(float(a)))])
    dflt = profiles.get("default", (6, 0.0))
    peak = F.coalesce(F.try_element_at(pm, F.col(category)), F.lit(dflt[0]))
    amp = F.coalesce(F.try_element_at(am, F.col(category)), F.lit(float(dflt[1])))
    d = F.abs(F.col(month) - peak)
    dist = F.least(d, 12 - d)
    out = df.withColumn("season_factor", 1 + amp * F.cos(F.lit(3.141592653589793) * dist / 6.0))
    if units:
        out = out.withColumn("effective_units", F.greatest(F.lit(5.0), F.col(units) * F.col("season_factor")))
    return out


# B24
def preprocess_reviews(df: DataFrame, text: str = "review_text", rating: str = "rating_value",
                       min_len: int = 5) -> DataFrame:
    out = (df.withColumn(text, tx.clean_text(F.col(text)))
             .where(F.length(F.col(text)) > min_len)
             .withColumn(rating, F.least(F.greatest(tx.parse_numeric(F.col(rating)), F.lit(1.0)), F.lit(5.0))))
    if "sentiment" not in df.columns:
        out = out.withColumn("sentiment", F.when(F.col(rating) >= 4, "positive")
                             .when(F.col(rating) <= 2, "negative")
                             .when(F.col(rating).isNotNull(), "neutral"))
    return out


# B25
SKIN_ALIASES = {"oily skin": "oily", "oily": "oily", "greasy": "oily", "dry skin": "dry", "dry": "dry",
                "sensitive skin": "sensitive", "sensitive": "sensitive", "combination": "combination",
                "combo": "combination", "normal": "normal", "normal skin": "normal", "acne": "acne",
                "acne-prone": "acne", "acne prone": "acne", "all": "all", "all skin types": "all"}


def preprocess_master(df: DataFrame) -> DataFrame:
    out = df
    for c in ("product_name", "brand"):
        if c in df.columns:
            out = out.withColumn(c, tx.clean_text(F.col(c), remove_punctuation=False))
    if "skin_suitability" in df.columns:
        out = out.withColumn("skin_suitability", tx.alias_lookup(F.col("skin_suitability"), SKIN_ALIASES))
    if "total_sales" in df.columns:
        out = out.withColumn("total_sales", tx.parse_numeric(F.col("total_sales")))
    if "average_rating" in df.columns:
        out = out.withColumn("average_rating", tx.parse_numeric(F.col("average_rating"), lo=0.0, hi=5.0))
    if "safety_score" in df.columns:
        out = out.withColumn("safety_score", tx.parse_numeric(F.col("safety_score"), fill=50.0, lo=0.0, hi=100.0))
    return out


# B26
def preprocess_sales(df: DataFrame, dates: Sequence[str] = ("start_date", "end_date", "order_date", "ship_date"),
                     measures: Sequence[str] = ("units_sold", "sales", "avg_daily_footfall", "sell_through_pct")
                     ) -> DataFrame:
    out = df
    for c in dates:
        if c in df.columns:
            out = out.withColumn(c, F.to_date(F.col(c).cast("string")))
    for c in measures:
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("string").try_cast("double"))
    if "units_sold" in df.columns:
        out = out.where(F.col("units_sold") >= 0)
    return out


# B27
def assemble_enriched(df: DataFrame, supplied_ingredients: str, generated_ingredients: str,
                      supplied_review: str, generated_review: str,
                      min_ingredients: int = 5, min_review: int = 10) -> DataFrame:
    """Supplied values win when long enough; provenance flags; nested struct output."""
    ing_ok = F.length(F.coalesce(F.col(supplied_ingredients), F.lit(""))) >= min_ingredients
    rev_ok = F.length(F.coalesce(F.col(supplied_review), F.lit(""))) >= min_review
    return (df.withColumn("ingredients_final", F.when(ing_ok, F.col(supplied_ingredients))
                          .otherwise(F.col(generated_ingredients)))
              .withColumn("review_final", F.when(rev_ok, F.col(supplied_review)).otherwise(F.col(generated_review)))
              .withColumn("provenance", F.struct(ing_ok.alias("ingredients_supplied"),
                                                 rev_ok.alias("review_supplied"))))


# B28
def validate_required(df: DataFrame, defaults: Mapping[str, object], price: str = "price",
                      units: str = "units") -> DataFrame:
    """Backfill required fields with defaults, clamp price >= 0 and units >= 1; count backfills."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(f"_bf_{c}", F.col(c).isNull()).withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    out = out.withColumn("backfilled", sum(F.col(f"_bf_{c}").cast("int") for c in defaults) if defaults else F.lit(0))
    out = out.drop(*[f"_bf_{c}" for c in defaults])
    if price in out.columns:
        out = out.withColumn(price, F.greatest(F.col(price), F.lit(0.0)))
    if units in out.columns:
        out = out.withColumn(units, F.greatest(F.col(units), F.lit(1)))
    return out


# B29
def forecast_json_parse(c: Column) -> Column:
    """Stored forecast as '[..]' or '{"forecast": [..]}' -> array<double>."""
    arr = F.from_json(c, "array<double>")
    obj = F.from_json(F.get_json_object(c, "$.forecast"), "array<double>")
    return F.coalesce(arr, obj)


# B30
def derive_measures(df: DataFrame, price: str = "price", units: str = "units_sold") -> DataFrame:
    return (df.withColumn("revenue", F.round(F.col(price) * F.col(units), 2))
              .withColumn("cost_price", F.round(F.col(price) * 0.4, 2))
              .withColumn("margin", F.try_divide(F.col(price) - F.col("cost_price"), F.col(price))))
