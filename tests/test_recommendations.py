"""Recommendations against the rules written out item by item: stages, fallbacks, exclusions, scores."""
import random

import pytest

from shelfsense.operators import similarity as sim


def brute(items, similar, n):
    out = {}
    rank = dict(sim.RISK_RANK)
    for t in items:
        mates = [c for c in items if c["dealer_id"] == t["dealer_id"] and c["product_id"] != t["product_id"]]
        safe = sorted((c for c in mates if c["risk_level"] != "high"), key=lambda c: (c["priority_score"] is None, -(c["priority_score"] or 0), c["product_id"]))
        every = sorted(mates, key=lambda c: (c["priority_score"] is None, -(c["priority_score"] or 0), c["product_id"]))
        near = {b for a, b, r in similar if a == t["product_id"] and r <= 20}
        cand = [c for c in safe if c["product_id"] in near] + [c for c in safe if c["category"] == t["category"]][:30]
        if len(cand) < 5:
            cand += safe[:30]
        if len(cand) < 3:
            cand += every[:30]
        scored = {}
        for c in cand:
            if c["risk_level"] == "high":
                continue
            ours, theirs = t["avg_monthly"] or 0, c["avg_monthly"] or 0
            rising, own, rating = c["forecast_trend"] == "increasing", t["avg_rating"] or 0, c["avg_rating"] or 0
            s = 5 + (40 if ours > 0 and theirs > ours * 1.2 else 20 if theirs > 0 and theirs > ours else 0) + 25 * rising
            s += 45 if rank.get(c["risk_level"], 0) < rank.get(t["risk_level"], 0) else 5 if (c["risk_level"] or "none") == (t["risk_level"] or "none") == "none" else 0
            s += 25 if rating and own and rating > own + 0.2 else 10 if rating >= 4 else 0
            s += 10 * (c["stock_status"] == "normal")
            s += 10 * bool(t["skin_type"] and c["skin_type"] and any(x.strip() in c["skin_type"] for x in t["skin_type"].split(",")))
            s += 50 * (theirs > ours * 1.1 and rising and rating >= own) + 5 * bool(t["category"] and c["category"] == t["category"])
            scored[c["product_id"]] = s
        for r, (c, s) in enumerate(sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out[t["dealer_id"], t["product_id"], c] = (r, s)
    return out


SCHEMA = ("dealer_id int, product_id int, category string, priority_score double, risk_level string, forecast_trend string, "
          "avg_rating double, stock_status string, skin_type string, avg_monthly double")


@pytest.mark.parametrize("seed, high", [(1, 0.2), (2, 0.9), (3, 0.97)])
def test_against_the_rules(spark, seed, high):
    r, items = random.Random(seed), []
    for dealer, size in ((1, 90), (2, 6), (3, 2), (4, 1), (5, 40)):
        for p in r.sample(range(200), size):
            items.append(dict(dealer_id=dealer, product_id=p, category=r.choice(["A", "A", "A", "B", None]), priority_score=r.choice([None, 1.0, 5.0, 9.0]),
                              risk_level="high" if r.random() < high else r.choice(["medium", "low", "none", None]), forecast_trend=r.choice(["increasing", "stable", None]),
                              avg_rating=r.choice([None, 0.0, 3.9, 4.0, 4.5]), stock_status=r.choice(["normal", "watch"]), skin_type=r.choice([None, "", "oily", "oily, dry", "dry"]),
                              avg_monthly=r.choice([None, 0.0, 10.0, 11.5, 30.0])))
    similar = [(a, b, k) for a in range(200) for k, b in enumerate(r.sample(range(200), 25), 1) if a != b]
    got = sim.recommendations(spark.createDataFrame(similar, "product_id int, similar_id int, rank int"),
                              spark.createDataFrame([tuple(x.values()) for x in items], SCHEMA), top_n=5).collect()
    assert {(x["dealer_id"], x["query_id"], x["cand_id"]): (x["rec_rank"], x["rec_score"]) for x in got} == brute(items, similar, 5)
    risk = {(x["dealer_id"], x["product_id"]): x["risk_level"] for x in items}
    assert got and all(risk[x["dealer_id"], x["cand_id"]] != "high" and 1 <= len(x["reasons"]) <= 3 and len(x["why_better"]) <= 2 for x in got)
    assert all("Confident" in x["reasons"][0] for x in got if x["is_confident"])
