"""Sentiment, keyword classes and text helpers.

Lexicon lookups are map/array literals evaluated with higher-order functions
in one projection: tokens never leave their row, so the operators need no
join and no shuffle and scale linearly with text volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import clean_text, first_match, md5_mod


def _contains_count(text: Column, terms: Sequence[str]) -> Column:
    return sum(F.contains(text, F.lit(t)).cast("int") for t in terms)


# ------------------------------------------------------------------ H09
def sentiment_lexicon(df: DataFrame, text: str, valence: Sequence[tuple[str, float]] = L.VALENCE,
                      alpha: float = 15.0, threshold: float = 0.05, out: str = "compound") -> DataFrame:
    """Compound score s / sqrt(s^2 + alpha) of the summed token valences (Hutto & Gilbert 2014)."""
    vmap = F.create_map(*[x for w, v in valence for x in (F.lit(w), F.lit(float(v)))])
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([a-z]+)"), 1)
    s = F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(vmap, t), F.lit(0.0)))
    sv = F.col("_valence_sum")
    comp = F.when(sv == 0, F.lit(0.0)).otherwise(sv / F.sqrt(sv * sv + alpha))
    return (df.withColumn("_valence_sum", s).withColumn(out, comp).drop("_valence_sum")
              .withColumn(f"{out}_label", F.when(F.col(out) >= threshold, "positive")
                          .when(F.col(out) <= -threshold, "negative").otherwise("neutral")))


# ------------------------------------------------------------------ H10
def sentiment_boost(df: DataFrame, text: str, base: str | None = None, step: float = 0.4,
                    positive: Sequence[str] = L.STRONG_POSITIVE, negative: Sequence[str] = L.STRONG_NEGATIVE,
                    threshold: float = 0.15) -> DataFrame:
    """+step / -step per strong term contained in the cleaned text, added to ``base``.

    With a base compound the sum is clipped to [-1, 1]; without, to [-0.9, 0.9].
    Label at +/- threshold, score 3 dp, confidence = |score| 2 dp.
    """
    # cleaned text and compound are materialised as columns: every term test and
    # every output column then reads them instead of re-running the regex chain
    clean = F.col("_clean")
    manual = F.lit(0.0)
    for w in positive:
        manual = manual + F.when(F.contains(clean, F.lit(w)), step).otherwise(0.0)
    for w in negative:
        manual = manual - F.when(F.contains(clean, F.lit(w)), step).otherwise(0.0)
    if base is not None:
        comp = F.least(F.greatest(F.col(base) + manual, F.lit(-1.0)), F.lit(1.0))
    else:
        comp = F.least(F.greatest(manual, F.lit(-0.9)), F.lit(0.9))
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    comp = F.when(empty, F.lit(0.0)).otherwise(comp)
    c = F.col("_comp")
    return (df.withColumn("_clean", clean_text(F.coalesce(F.col(text), F.lit(""))))
              .withColumn("_comp", comp)
              .withColumn("sentiment_score", F.round(c, 3))
              .withColumn("sentiment_label", F.when(c > threshold, "positive")
                          .when(c < -threshold, "negative").otherwise("neutral"))
              .withColumn("sentiment_confidence", F.round(F.abs(c), 2))
              .drop("_clean", "_comp"))


# ------------------------------------------------------------------ H11
POSITIVE_REVIEW_TERMS = ["love", "amazing", "best", "incredible", "game changer", "highly recommend", "five stars"]
NEGATIVE_REVIEW_TERMS = ["breakout", "irritat", "waste", "disappointed", "avoid", "redness", "itching"]


def sentiment_aggregate(reviews: DataFrame, keys, text: str, raw_score: str | None = None,
                        positive: Sequence[str] = POSITIVE_REVIEW_TERMS,
                        negative: Sequence[str] = NEGATIVE_REVIEW_TERMS) -> DataFrame:
    """Per product: review count, reviews with any positive / negative term, neutral rest."""
    reviews = reviews.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    t = F.col("_low")
    pos = F.exists(F.array(*[F.lit(w) for w in positive]), lambda w: F.instr(t, w) > 0)
    neg = F.exists(F.array(*[F.lit(w) for w in negative]), lambda w: F.instr(t, w) > 0)
    aggs = [F.count(F.lit(1)).alias("review_count"), F.count_if(pos).alias("positive_count"),
            F.count_if(neg).alias("negative_count")]
    if raw_score:
        aggs.append(F.avg(raw_score).alias("raw_score"))
    g = reviews.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(*aggs)
    g = g.withColumn("neutral_count", F.greatest(F.lit(0), F.col("review_count") - F.col("positive_count")
                                                 - F.col("negative_count")).cast("long"))
    if raw_score:
        g = (g.withColumn("sentiment", F.when(F.col("raw_score") > 0.15, "positive")
                          .when(F.col("raw_score") < -0.15, "negative").otherwise("neutral")))
    return g


# ------------------------------------------------------------------ H12
def rating_label(rating: Column, pos_at: float = 4.0, neg_at: float = 2.0) -> Column:
    return F.when(rating >= pos_at, "positive").when(rating <= neg_at, "negative").otherwise("neutral")


def proxy_accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("accuracy"))


# ------------------------------------------------------------------ H13
SENTIMENT_VOCAB = ["positive", "negative", "neutral", "pos", "neg", "neu", "good", "bad",
                   "5", "4", "3", "2", "1", "mixed", "very positive", "very negative"]


def detect_label_column(df: DataFrame, candidates: Sequence[str],
                        vocabulary: Sequence[str] = SENTIMENT_VOCAB) -> DataFrame:
    """For each candidate column: is it a sentiment label (>= 2 distinct values, all in vocabulary)?

    Uses counts only (distinct values and values outside the vocabulary), so a
    free-text column of any cardinality is rejected without collecting it.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, n_outside long, is_label boolean")
    vocab = [F.lit(v) for v in vocabulary]
    aggs = []
    for c in present:
        v = F.lower(F.trim(F.col(c).cast("string")))
        aggs += [F.count_distinct(v).alias(f"{c}__d"), F.count_if(v.isNotNull() & ~v.isin(*vocab)).alias(f"{c}__o")]
    row = df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").alias("n_distinct"),
                                            F.col(f"{c}__o").alias("n_outside")) for c in present]))
    return (row.select(stacked.alias("s")).select("s.*")
               .withColumn("is_label", (F.col("n_distinct") >= 2) & (F.col("n_outside") == 0)))


# ------------------------------------------------------------------ H14
# FIXED VALUES: augmentation synonym pairs.
AUGMENTATION_PAIRS = [("skin", "complexion"), ("reduces", "minimises"), ("great", "excellent"),
                      ("perfect", "ideal"), ("formula", "product"), ("helps", "works to"),
                      ("skin types", "skin conditions"), ("highly", "very"), ("feel", "appear")]


def synonym_augment(df: DataFrame, id_col: str, text: str, factor: int = 2, seed: int = 42,
                    pairs: Sequence[tuple[str, str]] = AUGMENTATION_PAIRS) -> DataFrame:
    """Original rows plus, per round, one variant with the first occurrence of a
    hash-chosen word replaced; a variant is kept only if the text changed."""
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    base = df.withColumn("augmented_round", F.lit(0))
    outs = [base]
    for r in range(1, factor + 1):
        idx = md5_mod(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(f"{seed}:{r}")), len(pairs)) + 1
        pair = F.element_at(arr, idx.cast("int"))
        t = F.col(text)
        pos = F.instr(t, pair["a"])
        new = F.when(pos > 0, F.concat(t.substr(F.lit(1), pos - 1), pair["b"],
                                       t.substr(pos + F.length(pair["a"]), F.length(t) + 1)))
        v = (df.withColumn("_new", new).where(F.col("_new").isNotNull() & (F.col("_new") != t))
               .withColumn(text, F.col("_new")).drop("_new")
               .withColumn("augmented_round", F.lit(r)))
        outs.append(v)
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


# ------------------------------------------------------------------ H06
def keyword_category(df: DataFrame, text: str, rules=L.CATEGORY_RULES, default: str = "default",
                     out: str = "category_detected") -> DataFrame:
    return (df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
              .withColumn(out, first_match(F.col("_low"), rules, default, lower=False)).drop("_low"))


def exact_partial_default(c: Column, mapping: dict[str, str], default: str) -> Column:
    """3-step lookup: exact key, else first key contained, else default."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    low = F.lower(F.trim(c))
    partial = first_match(low, [(v, [k]) for k, v in mapping.items()], None, lower=False)
    return F.coalesce(F.try_element_at(m, low), partial, F.lit(default))


# ------------------------------------------------------------------ H07
def term_vote(df: DataFrame, text: str, classes=L.SKIN_VOTE_CLASSES, default: str = "normal",
              bonus_text: str | None = None, bonus: dict[str, float] | None = None,
              out: str = "skin_type") -> DataFrame:
    """Per class, the number of its terms contained; argmax in class order; default if 0."""
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    t = F.col("_low")
    scores = []
    for name, terms in classes:
        s = _contains_count(t, terms).cast("double")
        if bonus_text and bonus and name in bonus:
            bt = F.lower(F.coalesce(F.col(bonus_text), F.lit("")))
            s = s + F.when(F.instr(bt, F.lit(name)) > 0, bonus[name]).otherwise(0.0)
        scores.append((name, s))
    # as in skin_hybrid: one column of scores, of which the first greatest gives the class
    names = F.array(*[F.lit(name) for name, _ in scores])
    df = df.withColumn("_scores", F.array(*[s for _, s in scores])).withColumn("_best", F.array_max("_scores"))
    label = F.element_at(names, F.array_position("_scores", F.col("_best")).cast("int"))
    return df.withColumn(out, F.when(F.col("_best") > 0, label).otherwise(F.lit(default))).drop("_low", "_scores", "_best")


# ------------------------------------------------------------------ H08
def skin_hybrid(df: DataFrame, text: str, model_pred: str = "ml_pred", model_conf: str = "ml_conf",
                classes=L.SKIN_BOOST_CLASSES, strong_step: float = 0.08, agree_bonus: float = 0.12,
                cap: float = 0.95) -> DataFrame:
    """Keyword boosts combined with a classifier's prediction and confidence."""
    df = df.withColumn("_clean", clean_text(F.coalesce(F.col(text), F.lit(""))))
    clean = F.col("_clean")
    # one column of counts, which the greatest and its class are read from: each term is looked for once
    names = F.array(*[F.lit(n) for n, _ in classes])
    df = df.withColumn("_counts", F.array(*[_contains_count(clean, terms) for _, terms in classes]))
    df = df.withColumn("_topn", F.array_max("_counts"))
    out = df.withColumn("_top", F.when(F.col("_topn") > 0, F.element_at(names, F.array_position("_counts", F.col("_topn")).cast("int")))).drop("_counts")
    st = (F.when(F.col("_topn") >= 2, F.col("_top"))
           .when((F.col("_topn") == 1) & (F.col(model_pred) == F.col("_top")), F.col("_top"))
           .otherwise(F.col(model_pred)))
    conf = (F.when(F.col("_topn") >= 2, F.least(F.lit(cap), F.col(model_conf) + strong_step * F.col("_topn")))
             .when((F.col("_topn") == 1) & (F.col(model_pred) == F.col("_top")),
                   F.least(F.lit(cap), F.col(model_conf) + agree_bonus))
             .otherwise(F.col(model_conf)))
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    return (out.withColumn("skin_type", F.when(empty, "all_skin_types").otherwise(st))
               .withColumn("skin_confidence", F.round(F.when(empty, 0.5).otherwise(conf), 3))
               .drop("_top", "_topn", "_clean"))


# ------------------------------------------------------------------ B23
def sentence_split(df: DataFrame, text: str, min_len: int = 15, max_n: int = 8,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Sentences (split after . ! ? and whitespace) longer than ``min_len``, first ``max_n``;
    the whole text when none qualifies.  One output row per sentence with its position."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+")
    kept = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > min_len)
    chosen = F.when(F.size(kept) > 0, F.slice(kept, 1, max_n)).otherwise(F.array(F.col(text)))
    return df.select(*keys, F.posexplode(chosen).alias("pos", "sentence"))
