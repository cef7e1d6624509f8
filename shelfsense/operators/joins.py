"""Joins.

Equi joins are left to the planner: sort-merge (or shuffled hash) on the key
for two large sides, broadcast only for sides whose size is bounded by
construction or checked here.  AQE's skew-join splitting handles a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..session import cut_lineage
from .ordering import global_index


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# D01
def product_analysis_join(products: DataFrame, analysis: DataFrame, keys=("product_id", "dealer_id")) -> DataFrame:
    return products.join(analysis, _k(keys), "inner")


# D02
def product_left_join(products: DataFrame, inventory: DataFrame, keys=("product_id", "dealer_id"),
                      defaults: Mapping[str, object] | None = None) -> DataFrame:
    defaults = defaults if defaults is not None else {"current_stock": 50.0, "lead_time_days": 14.0}
    out = products.join(inventory, _k(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# D03
def label_join(reviews: DataFrame, labels: DataFrame, key: str = "product_id") -> DataFrame:
    """Dedup the label side on the key first so the join cannot fan out."""
    return reviews.join(labels.dropDuplicates([key]), key, "inner")


# D04
def without_match(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right.select(*_k(keys)), _k(keys), "left_anti")


# D05
def referential_check(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """ok / orphan counts and match rate of children whose key is (not) in parents."""
    p = parents.select(key).distinct().withColumn("_ok", F.lit(True))
    j = children.select(key).join(p, key, "left")
    return (j.agg(F.count_if(F.col("_ok").isNotNull()).alias("ok"),
                  F.count_if(F.col("_ok").isNull()).alias("orphan"),
                  F.count(F.lit(1)).alias("total"))
             .withColumn("match_rate", F.round(F.col("ok") / F.greatest(F.col("total"), F.lit(1)), 4)))


# D07
def name_words(c) -> "F.Column":
    toks = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+")
    sw = F.array(*[F.lit(w) for w in L.STOPWORDS])
    return F.array_distinct(F.filter(toks, lambda t: (F.length(t) > 2) & ~F.array_contains(sw, t)))


def name_match_join(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str,
                    min_shared: int = 2) -> DataFrame:
    """Join on id; accept only pairs whose names share >= min_shared non-stop words (>2 chars)."""
    j = left.join(right, key)
    shared = F.size(F.array_intersect(name_words(F.col(left_name)), name_words(F.col(right_name))))
    return j.withColumn("shared_words", shared).withColumn("accepted", F.col("shared_words") >= min_shared)


# D08
def orphan_relink(orphans: DataFrame, valid: DataFrame, orphan_order: str, valid_key: str,
                  out: str = "new_product_id") -> DataFrame:
    """Orphan i (deterministic order) -> valid id number i mod n (sorted)."""
    o = global_index(orphans, [F.col(orphan_order)], "_i")
    v = global_index(valid.select(valid_key).distinct(), [F.col(valid_key)], "_j")
    n = v.agg(F.count(F.lit(1)).alias("_n"))
    o = o.crossJoin(F.broadcast(n)).withColumn("_j", F.pmod(F.col("_i"), F.col("_n")))
    return o.join(v, "_j").withColumnRenamed(valid_key, out).drop("_i", "_j", "_n")


# D09
def piece(text: Column, length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Begin and length of the i-th of ``parts`` pieces of a string of ``length`` characters."""
    at = F.floor(i * length / parts)
    return at.cast("int"), (F.floor((i + 1) * length / parts) - at).cast("int")


def within_distance(queries: DataFrame, names: DataFrame, d: int) -> DataFrame:
    """(_q, _n, dist) of all pairs of distinct strings of ``queries`` (_q) and ``names`` (_n) at most ``d`` edits apart.

    A name is cut into d + 1 pieces.  d edits leave one of them intact, and it lies in the query no further
    from its place than the edits before and after it allow (Li, Deng, Wang & Feng, "Pass-Join", VLDB 2011).  So pairs meet by an equi-join on
    the name's length, the piece's number and its text.  Names of at most d characters have empty pieces; they
    meet the queries whose length is within d of theirs."""
    q = queries.select("_q", F.length("_q").alias("_len"))
    n = names.select("_n", F.length("_n").alias("_l"))
    near = q.withColumn("_l", F.explode(F.sequence(F.greatest(F.col("_len") - d, F.lit(0)), F.col("_len") + d)))
    short = near.where(F.col("_l") <= d).join(n.where(F.col("_l") <= d), "_l").select("_q", "_n")
    parts = F.explode(F.sequence(F.lit(0), F.lit(d)))
    at, size = piece(F.col("_n"), F.col("_l"), F.col("_i"), d + 1)
    of_names = n.where(F.col("_l") > d).withColumn("_i", parts).select("_n", "_l", "_i", F.substring("_n", at + 1, size).alias("_piece"))
    at, size = piece(F.col("_q"), F.col("_l"), F.col("_i"), d + 1)
    before, after = F.col("_i"), d - F.col("_i")
    shift = F.col("_len") - F.col("_l")
    low = F.greatest(at - before, at + shift - after, F.lit(0))
    high = F.least(at + before, at + shift + after, F.col("_len") - size)
    of_queries = (near.where(F.col("_l") > d).withColumn("_i", parts).where(low <= high)
                  .withColumn("_at", F.explode(F.sequence(low, high)))
                  .select("_q", "_l", "_i", F.substring("_q", F.col("_at") + 1, size).alias("_piece")).distinct())
    met = of_queries.join(of_names, ["_l", "_i", "_piece"]).select("_q", "_n")
    return (met.withColumn("dist", F.levenshtein("_q", "_n", d)).where(F.col("dist") >= 0)
               .unionByName(short.withColumn("dist", F.levenshtein("_q", "_n", d)).where(F.col("dist") >= 0)).distinct())


def fuzzy_match(queries: DataFrame, names: DataFrame, q_id: str, q_name: str, n_id: str, n_name: str,
                min_score: float = 0.0) -> DataFrame:
    """Best name of each query by Levenshtein ratio 1 - distance / max(length), of at least ``min_score``; ties -> smallest id.

    Exact: distances 0, 1, 2, 4, ... are searched until no name further away can be as good as the best found.
    A name more than d edits away has a ratio of at most 1 - (d + 1) / (length + d + 1).  Most queries end after
    a round or two; those unlike any name go on until ``min_score`` ends the search, at worst (0.0) to all pairs of
    them and the names.  Strings are compared in lower case without white space at their ends, each distinct one once.
    A row for each query; no match (null) for a null name, and where nothing is good enough."""
    q = queries.select(q_id, F.lower(F.trim(F.col(q_name))).alias("_q"))
    names = names.where(F.col(n_name).isNotNull()).groupBy(F.lower(F.trim(F.col(n_name))).alias("_n")).agg(
        F.min(F.struct(F.col(n_id).alias("id"), F.col(n_name).alias("name"))).alias("_best"))
    names = cut_lineage(names)
    left = cut_lineage(q.where("_q is not null").select("_q").distinct())
    longest = names.agg(F.max(F.length("_n"))).first()[0]
    found, d = None, 0
    while longest is not None and (most := left.agg(F.max(F.length("_q"))).first()[0]) is not None:
        reach = max(longest, most)
        size = F.greatest(F.length("_q"), F.length("_n"), F.lit(1))
        pairs = within_distance(left, names, d).withColumn("_size", size).join(names, "_n")
        better = F.struct((F.col("dist") / F.col("_size")).alias("r"), F.col("_best.id").alias("id"), F.col("_best.name").alias("name"),
                          F.col("dist"), F.col("_size").alias("size"))
        best = pairs.groupBy("_q").agg(F.min(better).alias("b"))
        state = cut_lineage(left.join(best, "_q", "left"))
        # no name more than d edits away is as good, or good enough
        beyond, over = F.lit(d + 1), F.length("_q") + d + 1
        done = F.col("b.dist") * over < beyond * F.col("b.size")
        over_limit = F.lit(1.0) - beyond / over < min_score - 1e-12
        ends = F.coalesce(done, F.lit(False)) | over_limit | F.lit(d >= reach)
        part = state.where(ends & F.col("b").isNotNull())
        found = part if found is None else found.unionByName(part)
        left = cut_lineage(state.where(~ends).select("_q"))
        d = min(max(1, 2 * d), max(reach, 1))
    if found is None:
        none = names.limit(0).select(F.col("_n").alias("_q"), F.struct(F.lit(0.0).alias("r"), F.col("_best.id").alias("id"), F.col("_best.name").alias("name")).alias("b"))
        found = none
    good = found.select("_q", F.col("b.id").alias(n_id), F.col("b.name").alias("match_name"), (1 - F.col("b.r")).alias("match_score"))
    return q.join(good.where(F.col("match_score") >= min_score - 1e-12), "_q", "left").drop("_q")


# D10
def product_360(products: DataFrame, inventory: DataFrame, series: DataFrame, safety: DataFrame,
                reviews_summary: DataFrame, keys=("dealer_id", "product_id")) -> DataFrame:
    """One record per product from pre-aggregated sides (each side is already one
    row per key, so the left joins never fan out)."""
    k = _k(keys)
    return (products.join(inventory, k, "left").join(series, k, "left")
                    .join(safety, "product_id", "left").join(reviews_summary, "product_id", "left"))


# D11
def backfill_join(df: DataFrame, other: DataFrame, key: str, col: str, max_null_share: float = 0.5) -> DataFrame:
    """Take ``col`` from ``other`` when it is absent in ``df`` or more than half NULL."""
    if col not in df.columns:
        return df.join(other.select(key, col).dropDuplicates([key]), key, "left")
    share = df.agg(F.avg(F.col(col).isNull().cast("double")).alias("_share"))
    src = other.select(key, F.col(col).alias("_other")).dropDuplicates([key])
    j = df.crossJoin(F.broadcast(share)).join(src, key, "left")
    return j.withColumn(col, F.when(F.col("_share") > max_null_share, F.col("_other")).otherwise(F.col(col))) \
            .drop("_share", "_other")


def name_lookup(queries: DataFrame, catalogue: DataFrame, q_key: str, q_name: str,
                c_key: str, c_name: str, out: str = "resolved_id") -> DataFrame:
    """Resolve by id, else by lower-trimmed name (first id per name)."""
    by_id = catalogue.select(F.col(c_key).alias("_id_hit"))
    by_name = (catalogue.select(F.lower(F.trim(F.col(c_name))).alias("_nm"), F.col(c_key).alias("_name_hit"))
                        .groupBy("_nm").agg(F.min("_name_hit").alias("_name_hit")))
    j = (queries.join(by_id, queries[q_key] == by_id["_id_hit"], "left")
                .join(by_name, F.lower(F.trim(F.col(q_name))) == by_name["_nm"], "left"))
    return j.withColumn(out, F.coalesce("_id_hit", "_name_hit")).drop("_id_hit", "_name_hit", "_nm")
