"""Mixing by exact weights over many slots."""
from collections import Counter
from fractions import Fraction
from math import isqrt

from shelfsense.llm import mixing


def deviation(seen, share):
    """The largest deviation of a source's blocks from its weight times the time, exactly."""
    total, had, worst = sum(share.values()), Counter(), 0
    for t, s in enumerate(seen, 1):
        had[s] += 1
        worst = max(worst, *(abs(had[x] * total - w * t) for x, w in share.items()))
    return Fraction(worst, total)


def test_irrational_weights_over_many_slots():
    blocks = {f"s{k:02}": n for k, n in enumerate([78_000] + [3_000 + 977 * k for k in range(19)])}
    weights = {s: n ** 0.5 for s, n in blocks.items()}
    exact = {s: isqrt(n * 10**30) for s, n in blocks.items()}
    seen = []
    for s, _ in mixing.order(blocks, weights):
        seen.append(s)
        blocks[s] -= 1
        if not blocks[s]:
            break
    assert len(seen) > 30_000 and deviation(seen, exact) < 1


def test_weights_below_a_thousandth():
    seen = [s for s, _ in mixing.order({"a": 60_000, "b": 20, "c": 9}, {"a": 0.9997, "b": 0.0002, "c": 0.0001})]
    first = seen[:seen.index("a") + 50_000]
    assert deviation(first, {"a": 9997, "b": 2, "c": 1}) < 1 and Counter(seen) == {"a": 60_000, "b": 20, "c": 9}


def test_mix_keeps_to_the_weights(spark):
    """On rows: more periods than one, sources that run out, a source without weight."""
    docs = spark.range(12_000).selectExpr("id as doc_id", "case when id % 12 < 7 then 'a' when id % 12 < 10 then 'b' when id % 12 < 11 then 'c' end as source")
    weights = {"a": 2 ** 0.5, "b": 3 ** 0.5, "c": 0.0005}
    got = mixing.mix(docs, weights, block=2, period=100).collect()
    assert sorted(r["position"] for r in got) == list(range(12_000)) and max(r["slot"] for r in got) == 5_999
    of = {(r["slot"], r["source"], r["source_block"]) for r in got}
    assert len(of) == 6_000 and min(r["slot"] for r in got if r["source"] is None) == 5_500
    seen = [s for _, s, _ in sorted(of, key=lambda x: x[0])]
    first = seen[:[k for k, s in enumerate(seen) if s == "b"][-1] + 1]
    assert deviation(first, {"a": isqrt(2 * 10**30), "b": isqrt(3 * 10**30), "c": 5 * 10**11}) < 1
