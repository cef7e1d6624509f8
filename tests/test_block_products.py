"""Similarity by pairs of blocks: against brute force over vectors of a few terms, with ties, repeats and nulls."""
import random

import pytest
from pyspark.sql import functions as F

from shelfsense.operators import similarity as sim

KINDS = {1: "A", 2: "B", 3: None}


@pytest.fixture(scope="module")
def vectors():
    r, out = random.Random(5), {}
    for k in range(60):
        out[k] = dict(out[k - 1]) if k % 7 == 3 else {r.choice("abcdefghijklmnop") + r.choice("xyz"): r.choice([0.2, 0.5, 1.0]) for _ in range(r.randint(1, 9))}
        norm = sum(x * x for x in out[k].values()) ** 0.5
        out[k] = {t: x / norm for t, x in out[k].items()}
    return out


def frame(spark, vectors):
    rows = [(k, t, x) for k, v in vectors.items() for t, x in v.items()] + [(None, "ax", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, term string, weight double")


def brute(vectors, a, b):
    return sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items())


@pytest.mark.parametrize("block, dense", [(2048, 1 / 800), (7, 1e-9), (7, 2.0)])
def test_pairs_and_best_of_blocks(spark, monkeypatch, vectors, block, dense):
    monkeypatch.setattr(sim, "BLOCK", block)
    monkeypatch.setattr(sim, "DENSE", dense)
    w = frame(spark, vectors)
    want = {(a, b): brute(vectors, a, b) for a in vectors for b in vectors if a != b and brute(vectors, a, b) >= 0.2}
    rows = sim.similar_pairs(w, 0.2).collect()
    got = {(r.a, r.b): r.sim for r in rows}
    assert len(rows) == len(got) and got == pytest.approx(want, abs=1e-12)
    best = {(r.product_id, r["rank"]): r.similar_id for r in sim.top_neighbours(sim.similar_pairs(w, 0.2, top_n=3), 3).collect()}
    for a in vectors:
        near = sorted((-round(s, 9), b) for (x, b), s in want.items() if x == a)[:3]
        assert [best.get((a, k + 1)) for k in range(3)] == [b for _, b in near] + [None] * (3 - len(near))


@pytest.mark.parametrize("dense", [1 / 800, 2.0])
def test_given_pairs(spark, monkeypatch, vectors, dense):
    monkeypatch.setattr(sim, "BLOCK", 7)
    asked = [(a, (a * 7 + k) % 60) for a in vectors for k in (1, 2)] + [(1, 999), (None, 2)]
    got = {(r.a, r.b): r.sim for r in sim.dot_products(spark.createDataFrame(asked, "a long, b long"), frame(spark, vectors)).collect()}
    want = {p: brute(vectors, *p) for p in asked if None not in p and 999 not in p and set(vectors[p[0]]) & set(vectors[p[1]])}
    assert got == pytest.approx(want, abs=1e-12) and len(got) > 40
    monkeypatch.setattr(sim, "BLOCK", 2048)
    x = [(r.a, r.b) for r in sim.dot_products(spark.createDataFrame([(a, b) for a in vectors for b in vectors], "a long, b long"), frame(spark, vectors)).collect()]
    assert len(x) == len(set(x)) == sum(bool(set(vectors[a]) & set(vectors[b])) for a in vectors for b in vectors)


def test_safe_alternatives_from_the_best_of_each_choice(spark, monkeypatch, vectors):
    """The pool of the best of each choice gives what the pool of all pairs gives; ids with two rows, kinds that are null."""
    monkeypatch.setattr(sim, "BLOCK", 7)
    r = random.Random(3)
    attrs = [(k, r.random() < 0.3, r.choice(["A", "B", "C", None, None])) for k in vectors] + [(5, True, "B"), (6, False, "A"), (6, True, "C")]
    attrs = spark.createDataFrame(attrs, "product_id long, is_safe boolean, category string")
    labels = attrs.groupBy(F.col("product_id").alias("doc_id")).agg(
        F.max("is_safe").alias("may"), F.collect_set("category").alias("kinds"), F.collect_set(F.when(F.col("is_safe"), F.col("category"))).alias("open_kinds"))
    w = frame(spark, vectors)

    def alternatives(pairs):
        pool = pairs.select(F.col("a").alias("query_id"), F.col("b").alias("item_id"), "sim")
        pool = pool.join(attrs.select(F.col("product_id").alias("query_id"), F.col("category").alias("query_category")), "query_id")
        alt = sim.safe_alternatives(pool, attrs.withColumnRenamed("product_id", "item_id"), top_n=2)
        return sorted((x.query_id, x.alt_rank, x.mode, x.item_id) for x in alt.collect())
    want = alternatives(sim.similar_pairs(w, 0.2))
    assert len(want) > 30 and alternatives(sim.similar_pairs(w, 0.2, top_n=2, labels=labels)) == want


def test_buckets_in_blocks_equal_a_join(spark, monkeypatch, vectors):
    monkeypatch.setattr(sim, "BLOCK", 7)
    w = frame(spark, vectors).where("doc_id is not null")
    codes = {r.doc_id: (r.own, r.probes) for r in sim.hyperplane_codes(w, 2, 6, 1, 42).collect()}
    looks = lambda a, b: any(codes[b][0][t] in codes[a][1][3 * t:3 * t + 3] for t in range(2))
    want = {(a, b) for a in vectors for b in vectors if a != b and brute(vectors, a, b) >= 0.2 and (looks(a, b) or looks(b, a))}
    every = sum(a != b and brute(vectors, a, b) >= 0.2 for a in vectors for b in vectors)
    got = [(r.a, r.b) for r in sim.lsh_pairs(w, 0.2, 2, 6, 1).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got) < every
