import pytest
from pyspark.sql import functions as F

from shelfsense.operators import safety
from shelfsense.operators import text_analytics as ta

# FIXTURES H03 case table, expected values recomputed by hand from the family rule
FAMILY_CASES = [
    ("aqua, glycerin, niacinamide, hyaluronic acid, ceramide np, vitamin e, aloe vera", 100.0, "Safe"),
    ("aqua, glycerin, methylparaben, propylparaben, cetyl alcohol", 100 - 7 * 3.5, "Moderate"),
    ("aqua, formaldehyde, lead acetate, hydroquinone, mercury, quaternium-15", 0.0, "Unsafe"),
    ("aqua, zinc oxide, titanium dioxide, avobenzone, oxybenzone, glycerin", 100 - 8 * 3.5, "Moderate"),
    ("aqua, peg-100 stearate, peg-40 castor oil, glycerin, carbomer", 100 - 5 * 3.5, "Moderate"),
]


def test_safety_family_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(FAMILY_CASES)], "id int, ingredients string")
    out = {r.id: r for r in safety.safety_family(df).collect()}
    for i, (_, score, status) in enumerate(FAMILY_CASES):
        assert out[i].safety_score == pytest.approx(score), FAMILY_CASES[i]
        assert out[i].safety_status == status


def test_safety_monotone_in_severity(spark):
    df = spark.createDataFrame([(1, "aqua, talc"), (2, "aqua, talc, coal tar")], "id int, ingredients string")
    s = {r.id: r.safety_score for r in safety.safety_family(df).collect()}
    assert s[2] < s[1] <= 100


def test_lexicon_match_blocked_equals_broadcast(spark):
    texts = spark.createDataFrame([(1, "Contains LEAD and talc"), (2, "pure water"), (3, "paraben-free, sls")],
                                  "id int, text string")
    lex = safety.lexicon_frame(spark)
    a = {tuple(r) for r in safety.lexicon_match(texts, lex, "id", "text", "keyword").select("id", "keyword").collect()}
    b = {tuple(r) for r in safety.lexicon_match(texts, lex, "id", "text", "keyword", max_broadcast_terms=0)
         .select("id", "keyword").collect()}
    assert a == b and (1, "lead") in a and (3, "sls") in a


SENTIMENT_CASES = [
    ("I absolutely love this product! It's amazing, my holy grail!", "positive"),
    ("Pretty good moisturizer, nice texture.", "positive"),
    ("The product arrived. It is okay.", "neutral"),
    ("Not what I expected, rather disappointed.", "negative"),
    ("Worst product ever. Terrible breakout. Horrible. Avoid it!", "negative"),
]


def test_sentiment_lexicon_plus_boost(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTIMENT_CASES)], "id int, text string")
    s = ta.sentiment_boost(ta.sentiment_lexicon(df, "text"), "text", base="compound")
    out = {r.id: r.sentiment_label for r in s.collect()}
    assert [out[i] for i in range(len(SENTIMENT_CASES))] == [lab for _, lab in SENTIMENT_CASES]


def test_sentiment_boost_only_clips(spark):
    df = spark.createDataFrame([(1, SENTIMENT_CASES[0][0]), (2, SENTIMENT_CASES[4][0])], "id int, text string")
    out = {r.id: r.sentiment_score for r in ta.sentiment_boost(df, "text").collect()}
    assert out == {1: 0.9, 2: -0.9}
