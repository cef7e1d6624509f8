"""Blocked top-k against brute force: several blocks on both sides, ties, zero and null vectors."""
import numpy as np
import pytest

from shelfsense.operators import similarity as sim


@pytest.mark.parametrize("n, n_q, block, k", [(300, 40, 64, 10), (5, 3, 2, 10), (300, 300, 7, 3)])
def test_equal_to_brute_force(spark, n, n_q, block, k):
    rng = np.random.default_rng(n)
    x = rng.integers(-2, 3, (n, 4)).astype(float)      # few values: many ties
    q = rng.integers(-2, 3, (n_q, 4)).astype(float)
    x[0] = 0
    items = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(10_000, None)]
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(q)]
    got = sim.embedding_topk(spark.createDataFrame(items, "vec_id long, embedding array<float>").repartition(3),
                             spark.createDataFrame(queries, "query_id string, query_vec array<double>").repartition(2), k=k, block=block).collect()
    unit = lambda v: v / max(np.sqrt((v * v).sum()), 1e-300)
    want = set()
    for i, v in enumerate(q):
        order = sorted((-(round(float(unit(v) @ unit(y)), 9) + 0.0), j) for j, y in enumerate(x))[:k]
        want |= {(f"q{i}", j, r, -s) for r, (s, j) in enumerate(order, 1)}
    assert {(r["query_id"], r["vec_id"], r["rank"], r["cosine"] + 0.0) for r in got} == want


def test_empty_sides(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert sim.embedding_topk(items.where("false"), queries).count() == 0 and sim.embedding_topk(items, queries.where("false")).count() == 0
