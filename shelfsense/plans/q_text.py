"""Queries: sentiment, keyword classes, sentences over documents/reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import binding as b
from ..functions import lexicons as L
from ..operators import text_analytics as ta
from .registry import register
from .sqlgen import clean_sql, contains_count_sql, md5_mod_sql, q, valence_case_sql

DOCS = "documents"


@register("sentiment_lexicon", sql=f"""
WITH s AS (
  SELECT doc_id, list_reduce([0.0] || [{valence_case_sql('t')}
                                for t in regexp_extract_all(lower(coalesce(text, '')), '([a-z]+)', 1)],
                             lambda a, x: a + x) AS s
  FROM documents),
c AS (SELECT doc_id, CASE WHEN s = 0 THEN 0.0 ELSE s / sqrt(s * s + 15.0) END AS compound FROM s)
SELECT doc_id, {b.rnd('compound', 6)} AS compound,
       CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END
         AS compound_label
FROM c""")
def q_sentiment_lexicon(spark, sf_dir):
    d = b.table(spark, sf_dir, DOCS)
    s = ta.sentiment_lexicon(d, "text")
    return s.select("doc_id", F.round("compound", 6).alias("compound"), "compound_label")


def _boost_sql(clean: str) -> str:
    expr = "0.0"
    for w in L.STRONG_POSITIVE:
        expr = f"({expr} + CASE WHEN contains({clean}, {q(w)}) THEN 0.4 ELSE 0.0 END)"
    for w in L.STRONG_NEGATIVE:
        expr = f"({expr} - CASE WHEN contains({clean}, {q(w)}) THEN 0.4 ELSE 0.0 END)"
    return expr


@register("sentiment_boost", sql=f"""
WITH c AS (SELECT doc_id, {clean_sql("coalesce(text, '')")} AS clean, coalesce(text, '') = '' AS empty
           FROM documents),
m AS (SELECT doc_id, CASE WHEN empty THEN 0.0 ELSE least(greatest({_boost_sql('clean')}, -0.9), 0.9) END AS comp
      FROM c)
SELECT doc_id, {b.rnd('comp', 3)} AS sentiment_score,
       CASE WHEN comp > 0.15 THEN 'positive' WHEN comp < -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       {b.rnd('abs(comp)', 2)} AS sentiment_confidence
FROM m""")
def q_sentiment_boost(spark, sf_dir):
    d = b.table(spark, sf_dir, DOCS)
    return ta.sentiment_boost(d, "text").select("doc_id", "sentiment_score", "sentiment_label",
                                               "sentiment_confidence")


def _any_sql(text: str, terms) -> str:
    return " OR ".join(f"contains({text}, {q(t)})" for t in terms)


@register("sentiment_aggregate", sql=b.with_ctes(b.REVIEWS_SQL) + f"""
, r AS (SELECT product_id, lower(coalesce(review_body, '')) AS t FROM reviews)
SELECT product_id, count(*) AS review_count,
       count_if({_any_sql('t', ta.POSITIVE_REVIEW_TERMS)}) AS positive_count,
       count_if({_any_sql('t', ta.NEGATIVE_REVIEW_TERMS)}) AS negative_count,
       greatest(0, count(*) - count_if({_any_sql('t', ta.POSITIVE_REVIEW_TERMS)})
                - count_if({_any_sql('t', ta.NEGATIVE_REVIEW_TERMS)})) AS neutral_count
FROM r GROUP BY product_id""")
def q_sentiment_aggregate(spark, sf_dir):
    r = b.reviews(spark, sf_dir)
    return ta.sentiment_aggregate(r, "product_id", "review_body")


@register("sentiment_proxy_accuracy", sql=b.with_ctes(b.REVIEWS_SQL) + f"""
, s AS (
  SELECT rating, list_reduce([0.0] || [{valence_case_sql('t')}
                     for t in regexp_extract_all(lower(coalesce(review_body, '')), '([a-z]+)', 1)],
                     lambda a, x: a + x) AS s
  FROM reviews WHERE rating IS NOT NULL),
l AS (SELECT CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS truth,
             CASE WHEN s = 0 THEN 0.0 ELSE s / sqrt(s * s + 15.0) END AS c FROM s),
p AS (SELECT truth, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS pred
      FROM l)
SELECT count(*) AS n, {b.rnd('avg(CAST(pred = truth AS DOUBLE))', 6)} AS accuracy FROM p""")
def q_sentiment_proxy_accuracy(spark, sf_dir):
    r = b.reviews(spark, sf_dir).withColumn("truth", ta.rating_label(F.col("rating")))
    s = ta.sentiment_lexicon(r, "review_body")
    a = ta.proxy_accuracy(s, "compound_label", "truth")
    return a.select("n", F.round("accuracy", 6).alias("accuracy"))


@register("detect_label_column", sql=b.with_ctes(b.REVIEWS_SQL) + f"""
, r AS (SELECT CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative'
                    WHEN rating IS NOT NULL THEN 'neutral' END AS sentiment_label, lang, source FROM reviews),
v AS (SELECT * FROM (VALUES {', '.join(f'({q(x)})' for x in ta.SENTIMENT_VOCAB)}) t(w)),
u AS (SELECT 'sentiment_label' AS "column", lower(trim(sentiment_label)) AS x FROM r
      UNION ALL SELECT 'lang', lower(trim(lang)) FROM r
      UNION ALL SELECT 'source', lower(trim(source)) FROM r)
SELECT "column", count(DISTINCT x) AS n_distinct,
       count_if(x IS NOT NULL AND x NOT IN (SELECT w FROM v)) AS n_outside,
       count(DISTINCT x) >= 2 AND count_if(x IS NOT NULL AND x NOT IN (SELECT w FROM v)) = 0 AS is_label
FROM u GROUP BY "column" """)
def q_detect_label_column(spark, sf_dir):
    r = b.reviews(spark, sf_dir).withColumn(
        "sentiment_label", F.when(F.col("rating").isNotNull(), ta.rating_label(F.col("rating"))))
    return ta.detect_label_column(r, ["sentiment_label", "lang", "source"])


def _augment_sql() -> str:
    pairs = ta.AUGMENTATION_PAIRS
    arr_a = "[" + ", ".join(q(a) for a, _ in pairs) + "]"
    arr_b = "[" + ", ".join(q(bb) for _, bb in pairs) + "]"
    parts = [f"SELECT item_id, text, 0 AS augmented_round FROM benchmark"]
    for r in (1, 2):
        key = "CAST(item_id AS VARCHAR) || '|42:" + str(r) + "'"
        idx = f"({md5_mod_sql(key, len(pairs))} + 1)"
        parts.append(f"""SELECT item_id, new_text AS text, {r} AS augmented_round FROM (
  SELECT item_id, text, a, bb, instr(text, a) AS pos,
         CASE WHEN instr(text, a) > 0 THEN substring(text, 1, instr(text, a) - 1) || bb ||
              substring(text, instr(text, a) + length(a)) END AS new_text
  FROM (SELECT item_id, text, {arr_a}[{idx}] AS a, {arr_b}[{idx}] AS bb FROM benchmark))
WHERE new_text IS NOT NULL AND new_text <> text""")
    return "\nUNION ALL\n".join(parts)


@register("synonym_augment", sql=_augment_sql())
def q_synonym_augment(spark, sf_dir):
    bm = b.table(spark, sf_dir, "benchmark")
    return ta.synonym_augment(bm, "item_id", "text").select(
        "item_id", "text", F.col("augmented_round").cast("int").alias("augmented_round"))


def _first_match_sql(text: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {_any_sql(text, kws)} THEN {q(lab)}" for lab, kws in rules)
    return f"CASE {whens} ELSE {q(default)} END"


@register("keyword_category", sql=f"""
SELECT doc_id, {_first_match_sql("lower(coalesce(text, ''))", L.CATEGORY_RULES, 'default')} AS category_detected
FROM documents""")
def q_keyword_category(spark, sf_dir):
    d = b.table(spark, sf_dir, DOCS)
    return ta.keyword_category(d, "text").select("doc_id", "category_detected")


def _vote_sql(text: str, classes, default: str) -> str:
    cnts = [(n, f"CAST({contains_count_sql(text, terms)} AS DOUBLE)") for n, terms in classes]
    best = "greatest(" + ", ".join(c for _, c in cnts) + ")"
    whens = " ".join(f"WHEN {c} = {best} THEN {q(n)}" for n, c in cnts)
    return f"CASE WHEN {best} > 0 THEN CASE {whens} END ELSE {q(default)} END"


@register("term_vote", sql=f"""
SELECT doc_id, {_vote_sql("lower(coalesce(text, ''))", L.SKIN_VOTE_CLASSES, 'normal')} AS skin_type
FROM documents""")
def q_term_vote(spark, sf_dir):
    d = b.table(spark, sf_dir, DOCS)
    return ta.term_vote(d, "text").select("doc_id", "skin_type")


def _hybrid_sql() -> str:
    clean = clean_sql("coalesce(text, '')")
    cnts = [(n, contains_count_sql("clean", terms)) for n, terms in L.SKIN_BOOST_CLASSES]
    topn = "greatest(" + ", ".join(c for _, c in cnts) + ")"
    top = "CASE " + " ".join(f"WHEN {c} = {topn} THEN {q(n)}" for n, c in cnts) + " END"
    return f"""
WITH c AS (SELECT doc_id, {clean} AS clean, coalesce(text, '') = '' AS empty, 'normal' AS ml_pred, 0.6 AS ml_conf
           FROM documents),
t AS (SELECT *, CASE WHEN {topn} > 0 THEN {top} END AS top, {topn} AS topn FROM c)
SELECT doc_id,
  CASE WHEN empty THEN 'all_skin_types' WHEN topn >= 2 THEN top
       WHEN topn = 1 AND ml_pred = top THEN top ELSE ml_pred END AS skin_type,
  {b.rnd('''CASE WHEN empty THEN 0.5 WHEN topn >= 2 THEN least(0.95, ml_conf + 0.08 * topn)
       WHEN topn = 1 AND ml_pred = top THEN least(0.95, ml_conf + 0.12) ELSE ml_conf END''', 3)} AS skin_confidence
FROM t"""


@register("skin_hybrid", sql=_hybrid_sql())
def q_skin_hybrid(spark, sf_dir):
    d = (b.table(spark, sf_dir, DOCS)
          .withColumn("ml_pred", F.lit("normal")).withColumn("ml_conf", F.lit(0.6)))
    return ta.skin_hybrid(d, "text").select("doc_id", "skin_type", "skin_confidence")


@register("sentence_split", sql=r"""
WITH p AS (
  SELECT doc_id, text,
         list_filter([trim(s) for s in string_split(regexp_replace(text, '([.!?])\s+', '\1<<S>>', 'g'), '<<S>>')],
                     lambda s: length(s) > 15) AS kept
  FROM documents),
c AS (SELECT doc_id, CASE WHEN len(kept) > 0 THEN kept[1:8] ELSE [text] END AS chosen FROM p)
SELECT doc_id, CAST(generate_subscripts(chosen, 1) - 1 AS INTEGER) AS pos, unnest(chosen) AS sentence FROM c""")
def q_sentence_split(spark, sf_dir):
    d = b.table(spark, sf_dir, DOCS)
    return ta.sentence_split(d, "text", keys=["doc_id"])
