"""Ingredient safety scoring and lexicon matching.

A fixed lexicon (tens of terms) is compiled into an array literal and matched
with higher-order functions inside one projection: no join, no shuffle, the
whole scorer runs map-side in whole-stage codegen, and a hot product or a
huge text only makes its own row slower.

A lexicon that is itself a table (the chemicals dimension, arbitrary size)
goes through :func:`lexicon_match`: an equi-join of texts' 3-grams with an index of
each term's rarest one, and a test of the terms that this names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import ingredient_items, let
from ..session import stored

Lexicon = Sequence[tuple[str, str, int, str]]


def family_of(kw: str) -> str:
    """Family key of a lexicon keyword (paraben / peg / formaldehyde releasers / self)."""
    for sub, fam in L.FAMILY_SUBSTRINGS[:1]:
        if sub in kw:
            return fam
    for pre, fam in L.FAMILY_PREFIXES:
        if kw.startswith(pre):
            return fam
    if L.FAMILY_SUBSTRINGS[1][0] in kw or kw in L.FORMALDEHYDE_RELEASERS:
        return L.FAMILY_SUBSTRINGS[1][1]
    return kw


def severity_label(sev: int) -> str:
    return "high" if sev >= 8 else ("medium" if sev >= 5 else "low")


def _lexicon_array(lexicon: Lexicon, longest_first: bool) -> Column:
    entries = list(enumerate(lexicon))
    if longest_first:
        entries.sort(key=lambda e: (-len(e[1][0]), e[0]))
    return F.array(*[F.struct(F.lit(kw).alias("kw"), F.lit(name).alias("name"),
                              F.lit(int(sev)).alias("sev"), F.lit(family_of(kw)).alias("fam"),
                              F.lit(severity_label(int(sev))).alias("level"))
                     for _, (kw, name, sev, _r) in entries])


# ------------------------------------------------------------------ H03
def safety_family(df: DataFrame, text: str = "ingredients", lexicon: Lexicon = L.HARMFUL_TERMS,
                  weight: float = 3.5, safe_at: float = 85, moderate_at: float = 60,
                  prefix: str = "") -> DataFrame:
    """Per-item family scorer.

    Items = text split on ``[,;\\n\\r]+``, trimmed, lower-cased, empties dropped.
    Each item takes the longest contained keyword (lexicon order on ties).
    Severity >= 8 high, >= 5 medium (harmful), else safe.  Only the highest
    severity per family counts: score = max(0, 100 - weight * sum).

    The lexicon is first narrowed, text by text, to the entries whose keyword is in some item; items are tested on
    those only, in lexicon order as before.
    """
    lex = _lexicon_array(lexicon, longest_first=True)
    items = ingredient_items(F.coalesce(F.col(text), F.lit("")))

    def match(found: Column, few: Column) -> Column:
        return F.transform(found, lambda it: F.struct(
            it.alias("item"), F.try_element_at(F.filter(few, lambda k: F.contains(it, k["kw"])), F.lit(1)).alias("m")))

    def narrowed(joined: Column) -> Column:
        return F.filter(lex, lambda k: F.contains(joined, k["kw"]))
    # items, their join and the narrowed lexicon are arguments, not columns: the planner would inline them into the
    # lambdas and work them out again for each item
    matched = let(items, lambda found: let(F.array_join(found, "\n"), lambda joined: let(narrowed(joined), lambda few: match(found, few))))
    p = prefix
    out = (df.withColumn(f"{p}_matched", matched)
             .withColumn(f"{p}_harm", F.filter(f"{p}_matched", lambda x: x["m"]["sev"] >= 5)))
    fams = F.array_distinct(F.transform(f"{p}_harm", lambda x: x["m"]["fam"]))
    fam_max = F.transform(fams, lambda f: F.array_max(
        F.transform(F.filter(f"{p}_harm", lambda x: x["m"]["fam"] == f), lambda x: x["m"]["sev"])))
    penalty = F.aggregate(fam_max, F.lit(0.0), lambda a, s: a + s * weight)
    score = F.greatest(F.lit(0.0), 100.0 - penalty)
    harmful = F.transform(f"{p}_harm", lambda x: F.struct(
        x["m"]["kw"].alias("keyword"), x["m"]["name"].alias("name"),
        x["item"].alias("ingredient_found"), x["m"]["sev"].alias("severity"),
        x["m"]["level"].alias("risk_level")))
    out = (out.withColumn(f"{p}safety_score", score)
              .withColumn(f"{p}safety_status", F.when(F.col(f"{p}safety_score") >= safe_at, "Safe")
                          .when(F.col(f"{p}safety_score") >= moderate_at, "Moderate").otherwise("Unsafe"))
              .withColumn(f"{p}toxicity_level", F.round((100.0 - F.col(f"{p}safety_score")) / 10.0, 1))
              .withColumn(f"{p}harmful_count", F.size(f"{p}_harm"))
              .withColumn(f"{p}safe_count", F.size(f"{p}_matched") - F.size(f"{p}_harm"))
              .withColumn(f"{p}harmful_ingredients", harmful))
    return out.drop(f"{p}_matched", f"{p}_harm")


# ------------------------------------------------------------------ H02
def safety_substring(df: DataFrame, text: str = "ingredients", lexicon: Lexicon = L.HARMFUL_TERMS,
                     weight: float = 4.0, safe_at: float = 80, unsafe_below: float = 50) -> DataFrame:
    """100 - min(100, weight * sum of severities of contained terms) over the whole text."""
    lex = _lexicon_array(lexicon, longest_first=False)
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    found = F.filter(lex, lambda k: F.instr(F.col("_low"), k["kw"]) > 0)
    total = F.aggregate(found, F.lit(0), lambda a, k: a + k["sev"])
    score = F.greatest(F.lit(0.0), 100.0 - F.least(total * weight, F.lit(100.0)))
    return (df.withColumn("_found", found)
              .withColumn("safety_score", F.round(score, 1))
              .withColumn("safety_tier", F.when(F.col("safety_score") >= safe_at, "safe")
                          .when(F.col("safety_score") < unsafe_below, "unsafe").otherwise("moderate"))
              .withColumn("toxicity", F.when(F.size("_found") > 0,
                          F.aggregate("_found", F.lit(0.0), lambda a, k: a + k["sev"]) / F.size("_found")))
              .withColumn("harmful_terms", F.transform("_found", lambda k: k["kw"]))
              .drop("_found", "_low"))


# ------------------------------------------------------------------ H01
def safety_hits(df: DataFrame, text: str = "ingredients", terms: Sequence[str] = L.HIT_TERMS,
                out: str = "safety_hits") -> DataFrame:
    """max(0, 10 - number of terms contained in the lower-cased text)."""
    t = F.col("_low")
    hits = sum((F.instr(t, F.lit(w)) > 0).cast("int") for w in terms)
    return (df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
              .withColumn(out, F.greatest(F.lit(0), 10 - hits)).drop("_low"))


# ------------------------------------------------------------------ H05
def safe_flags(df: DataFrame, text: str = "ingredients", terms: Sequence[str] = L.HIT_TERMS,
               preview: int = 120) -> DataFrame:
    """is_safe, flagged terms (in list order) and a 120-character preview."""
    t = F.col("_low")
    flagged = F.filter(F.array(*[F.lit(w) for w in terms]), lambda w: F.instr(t, w) > 0)
    return (df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
              .withColumn("flagged_terms", flagged).drop("_low")
              .withColumn("is_safe", F.size("flagged_terms") == 0)
              .withColumn("preview", F.substring(F.coalesce(F.col(text), F.lit("")), 1, preview)))


# ------------------------------------------------------------------ D06
def grams(df: DataFrame, key: str, text: str, sizes: Sequence[int] | None = None) -> DataFrame:
    """(key, _gram): the distinct runs of ``sizes`` (0 to 3) characters of each row's text; without ``sizes`` its runs of 3, or a shorter text itself.

    A run is packed into one number, 21 bits a character, each one more than its code point, so that runs of all
    sizes differ and none stands for two."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                held = []
                for data in batch.column(1).slice(first, 256):
                    x = np.frombuffer(data.as_py().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64) + 1
                    runs = []
                    for m in sizes if sizes is not None else [min(len(x), 3)]:
                        n = len(x) - m + 1
                        packed = np.zeros(max(n, 0) if m else 1, np.int64)
                        for k in range(m if n > 0 else 0):
                            packed = packed << 21 | x[k:k + n]
                        runs.append(packed)
                    held.append(np.unique(np.concatenate(runs)))
                at = np.repeat(np.arange(first, first + len(held)), [len(h) for h in held])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(held))], [key, "_gram"])

    return df.select(key, F.col(text).cast("binary")).mapInArrow(run, f"{key} {kind}, _gram long")


def lexicon_match(texts: DataFrame, lexicon: DataFrame, id_col: str, text: str, term: str, max_broadcast_terms: int | None = None) -> DataFrame:
    """(id, term, other columns of the lexicon) of all pairs where the lower-cased text contains the lower-cased term.

    A term is looked up under one of its 3-grams (a shorter term under itself): the one that the fewest texts hold.  A
    term with a gram that no text holds is in none.  Texts give their distinct grams, without the text; those
    that are looked up name the terms that may be in the text, and all of a text's are tested on it at
    once.  One plan at every size; the planner broadcasts the index if it is small by its own check, or with
    ``max_broadcast_terms`` never one of more terms.  The grams that texts and terms share are found in one pass over the
    texts and stored.
    A null text is empty, which contains the empty term only; rows that repeat are matched once each."""
    lex = lexicon.where(F.col(term).isNotNull()).select(F.lower(F.col(term)).alias("_term"), *[c for c in lexicon.columns if c != term])
    terms = lex.select("_term").distinct()
    sizes = sorted(r[0] for r in terms.select(F.least(F.length("_term"), F.lit(3)).alias("n")).distinct().collect())     # at most 4 values
    out = [id_col, F.col("_term").alias(term), *[c for c in lexicon.columns if c != term]]
    t = texts.select(F.col(id_col), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    t = t.withColumn("_hash", F.xxhash64("_text"))
    if not sizes:
        return t.crossJoin(lex).where("false").select(out)
    of_text = grams(t, "_hash", "_text", sizes)
    of_term = grams(terms.withColumn("_whole", F.col("_term")), "_term", "_whole")
    few = max_broadcast_terms is None or terms.limit(max_broadcast_terms + 1).count() <= max_broadcast_terms
    small = lambda d: d if few else d.hint("merge")
    of_text = stored(of_text.join(small(of_term.select("_gram").distinct()), "_gram"))
    held = of_text.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    index = (of_term.join(held, "_gram", "left").groupBy("_term")
                    .agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), "_gram")).alias("_rarest"))
                    .where("_rarest.n > 0").select("_term", F.col("_rarest._gram").alias("_gram")))
    maybe = of_text.join(small(index), "_gram").groupBy("_hash").agg(F.collect_set("_term").alias("_maybe"))
    hits = t.join(maybe, "_hash").withColumn("_term", F.explode("_maybe")).where(F.contains(F.col("_text"), F.col("_term")))
    return hits.select(id_col, "_term").join(lex, "_term").select(out)


def lexicon_frame(spark, lexicon: Lexicon = L.HARMFUL_TERMS) -> DataFrame:
    rows = [(i, kw, name, int(sev), reason, family_of(kw)) for i, (kw, name, sev, reason) in enumerate(lexicon)]
    return spark.createDataFrame(rows, "ord int, keyword string, name string, severity int, "
                                       "reason string, family string")
