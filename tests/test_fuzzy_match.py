"""The edit-distance join against all pairs."""
import random

import pytest

from shelfsense.operators import joins


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def strings(r, n):
    words = ["red", "large", "gizmo", "ring", "plate", "rod", "", "a", "éclair", "x"]
    out = []
    for _ in range(n):
        t = list(" ".join(r.choice(words) for _ in range(r.randint(0, 4))))
        for _ in range(r.randint(0, 5)):
            k = r.randint(0, len(t))
            t[k:k + r.randint(0, 1)] = r.choice(["", "z", "e", "Q"])
        out.append("".join(t))
    return out


@pytest.mark.parametrize("min_score", [0.0, 0.6, 1.0])
def test_equal_to_all_pairs(spark, min_score):
    r = random.Random(5)
    queries = list(enumerate(strings(r, 40) + [None, "", " Large GIZMO ", "completely different from all of them " * 2]))
    names = [(i, t) for i, t in enumerate(strings(r, 60))] + [(99, None), (7, "duplicate id")]
    clean = lambda t: t.strip(" ").lower()
    want = {}
    for i, q in queries:
        best = min(((distance(clean(q), clean(n)) / max(len(clean(q)), len(clean(n)), 1), k, n) for k, n in names if n is not None), default=None) if q is not None else None
        want[i] = (best[1], best[2], round(1 - best[0], 9)) if best and 1 - best[0] >= min_score - 1e-12 else (None, None, None)
    got = joins.fuzzy_match(spark.createDataFrame(queries, "q int, q_name string"), spark.createDataFrame(names, "n int, n_name string"), "q", "q_name", "n", "n_name", min_score).collect()
    assert len(got) == len(queries)
    assert {x["q"]: (x["n"], x["match_name"], None if x["match_score"] is None else round(x["match_score"], 9)) for x in got} == want


@pytest.mark.parametrize("d", [0, 1, 2, 5])
def test_every_pair_within_the_distance(spark, d):
    r = random.Random(d)
    a, b = sorted(set(strings(r, 40))), sorted(set(strings(r, 40)))
    got = joins.within_distance(spark.createDataFrame([(x,) for x in a], "_q string"), spark.createDataFrame([(x,) for x in b], "_n string"), d).collect()
    assert sorted((x["_q"], x["_n"], x["dist"]) for x in got) == sorted((x, y, distance(x, y)) for x in a for y in b if distance(x, y) <= d)


def test_no_names(spark):
    q = spark.createDataFrame([(1, "a"), (2, None)], "q int, q_name string")
    none = spark.createDataFrame([], "n int, n_name string")
    assert [(x["n"], x["match_score"]) for x in joins.fuzzy_match(q, none, "q", "q_name", "n", "n_name").collect()] == [(None, None)] * 2
    assert joins.fuzzy_match(q.where("false"), none, "q", "q_name", "n", "n_name").count() == 0
