"""Column-level text, number and date functions.

All return :class:`pyspark.sql.Column` built from JVM-side built-ins, so they
stay inside whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

WS_TRIM = r"^\s+|\s+$"
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: the characters that ``\s`` stands for
WS = " \t\n\x0b\f\r"
#: runs of the characters of PUNCT
PUNCT_RUN = r"[!-/:-@\[-`{-~]+"
#: runs of white space that are not one space already
WS_RUN = r"[\t\n\x0B\f\r]\s*| \s+"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, WS_TRIM, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often and in whatever lambdas ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# B01
def normalise_header(name: str) -> str:
    """strip, lower, runs of space/-// -> '_', other non-word characters dropped."""
    s = re.sub(r"[\s\-/]+", "_", name.strip().lower())
    return re.sub(r"[^\w]", "", s)


# B02
def null_if_sentinel(c: Column, sentinels: Sequence[str] = L.NULL_SENTINELS) -> Column:
    return F.when(F.lower(strip_ws(c)).isin(list(sentinels)), F.lit(None)).otherwise(c)


# B04
def normalise_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_ws(c)), r"\s+", " ")


# B05
def clean_text(c: Column, lowercase: bool = True, remove_punctuation: bool = True,
               remove_extra_spaces: bool = True, remove_numbers: bool = False,
               letters_only: bool = False) -> Column:
    out = c
    if lowercase:
        out = F.lower(out)
    if letters_only:
        out = F.regexp_replace(out, r"[^a-zA-Z\s]", " ")
    else:
        if remove_punctuation:
            out = F.regexp_replace(out, PUNCT_RUN, "")
        if remove_numbers:
            out = F.regexp_replace(out, r"\d+", "")
    if remove_extra_spaces:
        # most runs are one space already and need no replacement; then only spaces are left to trim
        out = F.trim(F.regexp_replace(out, WS_RUN, " "))
    return out


# B06
def tokenise_stopwords(c: Column, stopwords: Sequence[str] = L.STOPWORDS, min_len: int = 3) -> Column:
    toks = F.regexp_extract_all(F.lower(c), F.lit(r"([a-zA-Z]+)"), 1)
    sw = F.array(*[F.lit(w) for w in stopwords])
    kept = F.filter(toks, lambda t: (~F.array_contains(sw, t)) & (F.length(t) >= min_len))
    return F.array_join(kept, " ")


# B07
def ingredient_items(c: Column, pattern: str = r"[,;\n\r]+") -> Column:
    """split on separators, trim, lower, drop empties; order kept."""
    parts = F.transform(F.split(c, pattern), lambda x: F.lower(F.btrim(x, F.lit(WS))))
    return F.filter(parts, lambda x: x != "")


def parse_list(c: Column, pattern: str = r"[;,]", min_len: int = 2) -> Column:
    """Ingredient list parser: split, lower, strip quotes/space, keep length >= min_len."""
    parts = F.transform(F.split(c, pattern),
                        lambda x: F.regexp_replace(F.lower(x), r"^[\s'\"]+|[\s'\"]+$", ""))
    return F.filter(parts, lambda x: F.length(x) >= min_len)


# B08
def dedup_list(c: Column) -> Column:
    """Order-preserving dedup on a key with parenthesised content removed."""
    keyed = F.transform(c, lambda x: F.struct(
        strip_ws(F.regexp_replace(F.lower(x), r"\([^)]*\)", "")).alias("k"), x.alias("v")))
    first = F.aggregate(keyed, F.array().cast("array<struct<k:string,v:string>>"),
                        lambda acc, e: F.when(F.exists(acc, lambda a: a["k"] == e["k"]), acc)
                                        .otherwise(F.array_append(acc, e)))
    return F.transform(first, lambda e: e["v"])


# B09
def parse_numeric(c: Column, fill: float | None = None, lo: float | None = None,
                  hi: float | None = None) -> Column:
    digits = F.regexp_replace(c.cast("string"), r"[^0-9.]", "")
    out = digits.try_cast("double")
    if fill is not None:
        out = F.coalesce(out, F.lit(float(fill)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return out


# B13
def md5_mod(c: Column, modulus: int) -> Column:
    """int(md5(text), 16) % modulus, exactly, from the two 64-bit halves.

    (hi * 2^64 + lo) mod m = ((hi mod m) * (2^64 mod m) + lo mod m) mod m,
    computed in decimal(38,0) so nothing overflows.
    """
    h = F.md5(c.cast("string"))
    hi = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    m = F.lit(modulus).cast("decimal(20,0)")
    two64 = F.lit((1 << 64) % modulus).cast("decimal(20,0)")
    return F.pmod(F.pmod(hi, m) * two64 + F.pmod(lo, m), m).cast("long")


def hash_id(c: Column, prefix: str, modulus: int = 100000) -> Column:
    return F.concat(F.lit(f"{prefix}_"), md5_mod(c, modulus).cast("string"))


def hash_unit(c: Column, modulus: int = 1000) -> Column:
    return md5_mod(c, modulus) / float(modulus)


# B14
def date_features(c: Column) -> dict[str, Column]:
    d = F.to_date(c)
    return {
        "year": F.year(d), "month": F.month(d), "day_of_week": F.weekday(d),
        "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
        "is_weekend": F.weekday(d) >= 5,
    }


# B15
def season(month: Column) -> Column:
    out = None
    for name, months in L.SEASONS:
        cond = month.isin(months)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unknown")


# B17
def alias_lookup(c: Column, aliases: Mapping[str, str]) -> Column:
    m = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    key = F.lower(strip_ws(c))
    return F.coalesce(F.try_element_at(m, key), c)


# B18
def flags_to_list(flags: Mapping[str, Column], none_label: str = "all") -> Column:
    arr = F.array_compact(F.array(*[F.when(col, F.lit(name)) for name, col in flags.items()]))
    return F.when(F.size(arr) == 0, F.lit(none_label)).otherwise(F.array_join(arr, ","))


# B19 / H06
def first_match(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None,
                lower: bool = True) -> Column:
    """Label of the first rule with any keyword contained in the text."""
    t = F.lower(c) if lower else c
    out = None
    for label, kws in rules:
        cond = None
        for k in kws:
            ck = F.instr(t, F.lit(k)) > 0
            cond = ck if cond is None else (cond | ck)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def first_term(c: Column, terms: Sequence[str], default: str | None = None) -> Column:
    return first_match(c, [(t, [t]) for t in terms], default)


# B20
def currency_fix(price: Column, below: float = 200.0, rate: float = 83.5) -> Column:
    return F.when(price < below, F.round(price * rate, 0)).otherwise(price)


# B21
def price_tier(price: Column, budget: float = 15.0, mid: float = 50.0) -> Column:
    return F.when(price < budget, "budget").when(price < mid, "mid").otherwise("premium")


def price_tier_factor(price: Column, budget: float = 15.0, mid: float = 50.0) -> Column:
    return F.when(price < budget, 0.7).when(price < mid, 1.0).otherwise(1.3)


def price_sensitivity(price: Column, ref: float = 25.0) -> Column:
    return F.least(F.greatest(F.lit(ref) / price, F.lit(0.1)), F.lit(2.0))
