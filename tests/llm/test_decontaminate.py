"""Decontamination: edits down to the score threshold, and keys that several rows share."""
import pytest

from shelfsense.llm import decontaminate

ITEM = [f"q{k}" for k in range(38)]
WORDS = "item_id long, text string"


def edited(changed):
    """The item with the words at the places ``changed`` replaced, amid other words."""
    return "other words " * 40 + " ".join("changed" if k in changed else w for k, w in enumerate(ITEM)) + " and more" * 40


def test_most_ngrams_broken(spark):
    """No place is lost to n-grams that an edit destroyed, whether the copy is the only trace or the exact item is there too."""
    bench = spark.createDataFrame([(1, " ".join(ITEM))], WORDS)
    for exact in ([], [(100, " ".join(ITEM))]):
        docs = spark.createDataFrame([(4, edited(range(3, 38, 4)))] + exact, "doc_id long, text string")
        got = {r["doc_id"]: r["score"] for r in decontaminate.matches(docs, bench).collect()}
        assert set(got) == {4, *dict(exact)} and got[4] == pytest.approx((2 * 29 - 9) / 76)


def test_only_a_frequent_ngram_is_intact(spark):
    """Just over the threshold: one 3-gram is left, and many documents have it that hold no more of the item."""
    bench = spark.createDataFrame([(1, " ".join(ITEM))], WORDS)
    docs = spark.createDataFrame([(k, "q0 q1 q2 of other things") for k in range(30)] + [(50, edited(range(3, 38, 3)))], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] for r in decontaminate.matches(docs, bench).collect()} == {50: pytest.approx((2 * 26 - 12) / 76)}


def test_shared_and_null_doc_ids(spark):
    """Only rows with a match of their own go; rows with the same doc_id or none stay."""
    bench = spark.createDataFrame([(1, " ".join(ITEM))], WORDS)
    leak, fine = "before " + " ".join(ITEM), "nothing of it here"
    docs = spark.createDataFrame([(None, leak), (None, fine), (None, None), (5, leak + " x"), (5, fine + " x"), (6, fine)], "doc_id long, text string")
    kept = decontaminate.clean(docs, bench)
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(None, fine), (None, None), (5, fine + " x"), (6, fine)]))


def test_shared_and_null_item_ids(spark):
    """Items are told apart by their texts, and one without an id is found too."""
    other = [f"z{k}" for k in range(30)]
    bench = spark.createDataFrame([(None, " ".join(ITEM)), (2, " ".join(other)), (2, "one two three four five"), (2, "one two three four five")], WORDS)
    docs = spark.createDataFrame([(1, " ".join(ITEM)), (2, "x " + " ".join(other)), (3, "one two three four five"), (4, "nothing")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["n_passages"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(1, None): (1.0, 1), (2, 2): (1.0, 1), (3, 2): (1.0, 1)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [4]
