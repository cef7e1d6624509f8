"""Scorers whose cost per character matters: same results as their plain definitions, each term looked for once."""
import re

from pyspark.sql import functions as F

from shelfsense.functions import lexicons as L
from shelfsense.functions.text import PUNCT, clean_text, ingredient_items
from shelfsense.operators import rules, safety
from shelfsense.operators import text_analytics as ta

TEXTS = ["", None, " \t ", "a  b\tc\n\n d -- e!", "Sodium Lauryl Sulfate , paraben;;\n methylparaben\r\nPEG-40,  water \x0b",
         "para,ben; sodium\nlauryl sulfate", "oily greasy shine, dry! flaky", "LOVE it - the worst ,  holy\tgrail."]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_clean_text_and_items(spark):
    for r in frame(spark).select("text", clean_text(F.col("text")).alias("c"), ingredient_items(F.col("text")).alias("i")).collect():
        if r.text is None:
            assert r.c is None and r.i is None
            continue
        bare = "".join(ch for ch in r.text.lower() if ch not in PUNCT)
        assert r.c == re.sub(r"[ \t\n\x0b\f\r]+", " ", bare).strip(" ")
        parts = [x.strip(" \t\n\x0b\f\r").lower() for x in re.split(r"[,;\n\r]+", r.text)]
        assert r.i == [x for x in parts if x]


def test_narrowed_lexicon_finds_what_the_whole_one_does(spark):
    lex = sorted(enumerate(L.HARMFUL_TERMS), key=lambda e: (-len(e[1][0]), e[0]))
    got = safety.safety_family(frame(spark), text="text").select("text", F.expr("transform(harmful_ingredients, x -> struct(x.ingredient_found, x.keyword)) h")).collect()
    for r in got:
        items = [x.strip(" \t\n\x0b\f\r").lower() for x in re.split(r"[,;\n\r]+", r.text or "")]
        first = [(it, next((k for _, k in lex if k[0] in it), None)) for it in items if it]
        assert [tuple(x) for x in r.h] == [(it, k[0]) for it, k in first if k and k[2] >= 5]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_term_is_looked_for_once(spark):
    skin = plan(ta.skin_hybrid(frame(spark).withColumn("ml_pred", F.lit("normal")).withColumn("ml_conf", F.lit(0.6)), "text"))
    vote = plan(ta.term_vote(frame(spark), "text"))
    assert skin.count(", greasy)") == 1 and vote.count(f", {L.SKIN_VOTE_CLASSES[0][1][0]})") == 1


def test_mean_of_the_last_months_is_worked_out_once(spark):
    rows = spark.createDataFrame([(10.0, [1.0, 2.0, 3.0, 4.0])], "current_stock double, monthly_sales array<double>")
    assert plan(rules.stock_status(rows)).count("aggregate(slice(") == 1
