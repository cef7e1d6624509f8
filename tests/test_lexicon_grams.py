"""Packed grams of the lexicon index, on short, empty and non-ASCII texts, against containment."""
from shelfsense.operators import safety


def test_packed_grams_differ_by_size(spark):
    df = spark.createDataFrame([(1, "a\x00b"), (2, ""), (3, "é𝄞")], "k long, t string")
    got = {}
    for k, g in safety.grams(df, "k", "t", [0, 1, 2, 3]).collect():
        got.setdefault(k, set()).add(g)
    one = lambda c: ord(c) + 1
    assert got[2] == {0} and got[3] == {0, one("é"), one("𝄞"), one("é") << 21 | one("𝄞")}
    assert len(got[1]) == 1 + 3 + 2 + 1


def test_lexicon_against_containment(spark):
    texts = [(1, "Lead and TALC é𝄞x"), (1, "lead"), (2, None), (3, ""), (None, "sl"), (4, "a"), (5, "lea d")]
    terms = ["lead", "talc", "é𝄞", "é𝄞x", "a", "sl", "", "d", "zinc"]
    t, lex = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x, len(x)) for x in terms], "keyword string, n int")
    for most in (None, 0):
        got = sorted(map(tuple, safety.lexicon_match(t, lex, "id", "text", "keyword", most).collect()), key=str)
        assert got == sorted([(i, x, len(x)) for i, s in texts for x in terms if x in (s or "").lower()], key=str)
