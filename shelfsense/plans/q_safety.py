"""Queries: ingredient safety over document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import binding as b
from ..functions import lexicons as L
from ..operators import rules, safety
from .registry import register

LEX = L.test_lexicon()
HIT_TERMS = L.HIT_TERMS + ["license", "apache", "token", "mit"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lexicon_values_sql(lexicon=LEX) -> str:
    rows = ", ".join(f"({i}, {_q(kw)}, {_q(name)}, {int(sev)}, {_q(safety.family_of(kw))})"
                     for i, (kw, name, sev, _r) in enumerate(lexicon))
    return f"lex AS (SELECT * FROM (VALUES {rows}) t(ord, kw, name, sev, fam))"


ITEMS_SQL = lexicon_values_sql() + r""",
parts AS (
  SELECT doc_id, list_filter([lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))
                              for x in string_split_regex(coalesce(text, ''), '[,;\n\r]+')],
                             lambda x: x <> '') AS items
  FROM documents),
it AS (SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM parts),
best AS (
  SELECT * FROM (
    SELECT it.doc_id, it.pos, lex.kw, lex.sev, lex.fam,
           row_number() OVER (PARTITION BY it.doc_id, it.pos ORDER BY length(lex.kw) DESC, lex.ord) AS rn
    FROM it JOIN lex ON contains(it.item, lex.kw)) WHERE rn = 1),
fam AS (SELECT doc_id, fam, max(sev) AS sev FROM best WHERE sev >= 5 GROUP BY doc_id, fam),
pen AS (SELECT doc_id, sum(sev * 3.5) AS penalty FROM fam GROUP BY doc_id),
harm AS (SELECT doc_id, count(*) AS n_harm FROM best WHERE sev >= 5 GROUP BY doc_id),
scored AS (
  SELECT p.doc_id, greatest(0.0, 100.0 - coalesce(pen.penalty, 0.0)) AS safety_score,
         CAST(coalesce(harm.n_harm, 0) AS INTEGER) AS harmful_count,
         CAST(len(p.items) - coalesce(harm.n_harm, 0) AS INTEGER) AS safe_count
  FROM parts p LEFT JOIN pen USING (doc_id) LEFT JOIN harm USING (doc_id))"""


def family_frame(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ingredients"))
    return safety.safety_family(d, lexicon=LEX)


@register("safety_family", sql="WITH " + ITEMS_SQL + f"""
SELECT doc_id, safety_score,
       CASE WHEN safety_score >= 85 THEN 'Safe' WHEN safety_score >= 60 THEN 'Moderate' ELSE 'Unsafe' END
         AS safety_status,
       {b.rnd('(100.0 - safety_score) / 10.0', 1)} AS toxicity_level, harmful_count, safe_count
FROM scored""")
def q_safety_family(spark, sf_dir):
    return family_frame(spark, sf_dir).select(
        "doc_id", "safety_score", "safety_status", "toxicity_level", "harmful_count", "safe_count")


@register("risk_level", sql="WITH " + ITEMS_SQL + """
SELECT doc_id, CASE WHEN safety_score < 60 THEN 'high' WHEN safety_score < 80 THEN 'medium'
                    ELSE 'none' END AS risk_level
FROM scored""")
def q_risk_level(spark, sf_dir):
    return family_frame(spark, sf_dir).select("doc_id", rules.risk_level(F.col("safety_score")).alias("risk_level"))


SUBSTR_SQL = lexicon_values_sql() + """,
hits AS (SELECT doc_id, sum(sev) AS total, count(*) AS n, avg(sev) AS tox
         FROM documents JOIN lex ON contains(lower(coalesce(text, '')), lex.kw) GROUP BY doc_id),
sub AS (SELECT d.doc_id, greatest(0.0, 100.0 - least(coalesce(h.total, 0) * 4.0, 100.0)) AS safety_score,
               h.tox AS toxicity, CAST(coalesce(h.n, 0) AS INTEGER) AS n_terms
        FROM documents d LEFT JOIN hits h USING (doc_id))"""


@register("safety_substring", sql="WITH " + SUBSTR_SQL + f"""
SELECT doc_id, {b.rnd('safety_score', 1)} AS safety_score,
       CASE WHEN safety_score >= 80 THEN 'safe' WHEN safety_score < 50 THEN 'unsafe' ELSE 'moderate' END
         AS safety_tier, {b.rnd('toxicity', 6)} AS toxicity, n_terms
FROM sub""")
def q_safety_substring(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ingredients"))
    s = safety.safety_substring(d, lexicon=LEX)
    return s.select("doc_id", "safety_score", "safety_tier", F.round("toxicity", 6).alias("toxicity"),
                    F.size("harmful_terms").alias("n_terms"))


@register("safety_stats", sql="WITH " + SUBSTR_SQL + f""",
r AS (SELECT {b.rnd('safety_score', 1)} AS s FROM sub)
SELECT {b.rnd('avg(s)', 4)} AS mean_score, count_if(s >= 80) AS n_safe,
       count_if(s >= 50 AND s < 80) AS n_moderate, count_if(s < 50) AS n_unsafe,
       {b.rnd('100.0 * count_if(s >= 80) / count(*)', 2)} AS pct_safe,
       {b.rnd('100.0 * count_if(s < 50) / count(*)', 2)} AS pct_unsafe
FROM r""")
def q_safety_stats(spark, sf_dir):
    s = q_safety_substring(spark, sf_dir)
    from ..operators.aggregates import safety_stats
    return safety_stats(s, "safety_score")


@register("safety_hits", sql=f"""
SELECT doc_id, CAST(greatest(0, 10 - ({' + '.join(f"CAST(contains(lower(coalesce(text, '')), {_q(t)}) AS INTEGER)"
                                               for t in HIT_TERMS)})) AS INTEGER) AS safety_hits
FROM documents""")
def q_safety_hits(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return safety.safety_hits(d, "text", HIT_TERMS).select("doc_id", "safety_hits")


@register("safe_flags", sql=f"""
SELECT doc_id, array_to_string(list_filter([{', '.join(_q(t) for t in HIT_TERMS)}],
                                           lambda w: contains(lower(coalesce(text, '')), w)), ',') AS flagged_terms,
       NOT list_bool_or([contains(lower(coalesce(text, '')), w) for w in [{', '.join(_q(t) for t in HIT_TERMS)}]])
         AS is_safe,
       substring(coalesce(text, ''), 1, 120) AS preview
FROM documents""")
def q_safe_flags(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    s = safety.safe_flags(d, "text", HIT_TERMS)
    return s.select("doc_id", F.array_join("flagged_terms", ",").alias("flagged_terms"), "is_safe", "preview")


@register("lexicon_match", sql="WITH " + lexicon_values_sql() + """
SELECT doc_id, kw AS keyword, sev AS severity
FROM documents JOIN lex ON contains(lower(coalesce(text, '')), lex.kw)""")
def q_lexicon_match(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    lex = safety.lexicon_frame(spark, LEX)
    m = safety.lexicon_match(d, lex, "doc_id", "text", "keyword")
    return m.select("doc_id", "keyword", "severity")
