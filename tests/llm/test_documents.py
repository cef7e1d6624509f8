"""Document operators against brute force, on a small table and on odd cases."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfsense.llm import decontaminate, fingerprints, language_model, mixing, near_dedup, quality, secret_scan

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, n):
    w = words(t)
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(texts, n, percent):
    sets, root = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(docs, texts):
    want, size = groups(texts, 3, 85)
    got = near_dedup.near_duplicates(docs, near_dedup.Params(3, 85, 48, 19, 10)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(i, size[i], want[i], want[i] == i) for i in texts}


def test_representatives(docs, texts):
    want, _ = groups(texts, 5, 80)
    assert {r["doc_id"] for r in near_dedup.representatives(docs).select("doc_id").collect()} == {i for i in texts if want[i] == i}


def test_near_duplicates_odd(odd, none):
    got = near_dedup.near_duplicates(odd, near_dedup.Params(3, 80)).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)] == [1, 1, 1, 4, 5, 6, 7, 9, 9]
    assert by[4]["n_shingles"] == by[6]["n_shingles"] == 0 and by[8]["n_shingles"] == 1
    assert sorted((r["component_id"] is None, r["kept"]) for r in got if r["doc_id"] is None) == [(False, False), (True, False)]
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 9, 11, 12]


def test_columns_named_like_the_operators_own(odd, tmp_path):
    """A caller's columns with names that stages use themselves come back unchanged."""
    names = ["blob", "found", "found_before", "_id", "_same", "__ID", "root"]
    rows = odd.where("doc_id in (1, 3, 12)").select("doc_id", "text", "n_chars").withColumns({c: F.lit(f"{c} of the caller") for c in names})
    hidden = secret_scan.redact(rows, str(tmp_path / "l")).collect()
    assert len(hidden) == 3 and all(r[c] == f"{c} of the caller" for r in hidden for c in names)
    assert {r["doc_id"]: r["text"].count("[secret]") for r in hidden} == {1: 0, 3: 0, 12: 3}
    kept = near_dedup.representatives(rows).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 12] and all(r[c] == f"{c} of the caller" for r in kept for c in names)


def test_hamming_keys_find_all_pairs(spark):
    """Signatures with up to max_errors different positions always share a key."""
    import random
    p, r = near_dedup.Params(), random.Random(3)
    rows = []
    for i in range(60):
        a = [r.randrange(1 << 15) for _ in range(p.positions)]
        b = list(a)
        for k in r.sample(range(p.positions), p.max_errors):
            b[k] ^= 1
        rows.append((i, a, b))
    d = spark.createDataFrame(rows, "i int, a array<smallint>, b array<smallint>").select(F.arrays_overlap(near_dedup.keys("a", p), near_dedup.keys("b", p)).alias("x"))
    assert d.where("not x").count() == 0


def test_pairs_within_the_distance_are_written_out(spark):
    """Pairs with up to max_errors different positions fulfil ``once`` under a shared key; bitmaps never differ in more than the sets do."""
    import random

    import numpy as np
    p, r = near_dedup.Params(ngram=3, percent=85, max_errors=19, chunks=10), random.Random(4)
    rows = []
    for i in range(60):
        a = [r.randrange(1 << 15) for _ in range(p.positions)]
        b = list(a)
        for k in r.sample(range(p.positions), r.choice([0, 1, 5, 12, p.max_errors])):
            b[k] ^= 1
        rows.append((i, a, b))
    d = spark.createDataFrame(rows, "i int, a array<smallint>, b array<smallint>")
    side = lambda x: d.select("i", F.inline(F.arrays_zip(near_dedup.keys(x, p).alias(f"{x}_key"), near_dedup.rests(x, p).alias(f"{x}_rest"))))
    met = side("a").join(side("b"), "i").where("a_key = b_key").where(near_dedup.once("a_", "b_"))
    assert met.select("i").distinct().count() == 60

    rng = np.random.default_rng(5)
    for n, other in ((3, 0), (40, 7), (900, 300)):
        h = rng.integers(0, 2**63, n + other, dtype=np.uint64)
        x = near_dedup.parity(np.concatenate([h[:n], h[other:]]), np.array([0, n, 2 * n]))
        assert sum(int(c[0] ^ c[1]).bit_count() if c[0] ^ c[1] >= 0 else (int(c[0] ^ c[1]) + (1 << 64)).bit_count() for c in x) <= len(set(h[:n].tolist()) ^ set(h[other:].tolist()))


def test_first_table(spark):
    """Two fingerprints within the radius fulfil ``first_table`` under exactly one shared key."""
    import random
    r, rows = random.Random(6), []
    for i in range(80):
        hi, lo = r.getrandbits(63), r.getrandbits(63)
        flips = r.sample(range(126), i % 4)
        rows.append((i, hi, lo, hi ^ sum(1 << f for f in flips if f < 63), lo ^ sum(1 << (f - 63) for f in flips if f >= 63)))
    d = spark.createDataFrame(rows, "i int, a_hi long, a_lo long, b_hi long, b_lo long")
    side = lambda x: d.select("i", f"{x}_hi", f"{x}_lo", F.inline(fingerprints.block_keys(f"{x}_hi", f"{x}_lo", 3, 7))).withColumnsRenamed({"key": f"{x}_key", "skipped": f"{x}_skipped"})
    met = side("a").join(side("b"), "i").where("a_key = b_key").where(fingerprints.first_table(7)("a_", "b_"))
    assert [x["n"] for x in met.groupBy("i").agg(F.count("*").alias("n")).collect()] == [1] * 80


def test_language_model(docs, texts):
    count = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words(t) + [None])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    for i, t in texts.items():
        w = words(t) + [None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_language_model_odd(odd, none):
    got = language_model.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert len({round(r["score"], 6) for r in got if r["doc_id"] in (1, 2)}) == 1
    assert language_model.score(none).count() == 0


def test_language_model_sums_to_one():
    import numpy as np
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(2, 900, 150))[::-1].copy()
    hashes = rng.integers(1, 2**63, 150, dtype=np.uint64)
    hashes[0] = language_model.END
    p = language_model.Params(top=64, per_class=16)
    head = language_model.Head(hashes, counts, int(counts.sum()) + 40, 180, p)
    model = language_model.Model(head, p.hidden)
    state = rng.normal(size=(1, p.hidden)).astype(np.float32)
    target = np.arange(150)
    got = model.output(np.repeat(state, 151, axis=0), np.append(target, 150))[0] + head.share
    rest = got[-1] + np.log(40 + 30 + 1)       # c + 1 over the 30 seen words outside, and one unseen word
    assert np.exp(got[:-1]).sum() + np.exp(rest) == pytest.approx(1, abs=1e-4)
    assert (head.lookup(hashes) < 150).all() and (head.lookup(hashes + np.uint64(1)) == 150).all()


def spans(t):
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return a, b, c


def test_secrets(spark, docs, tmp_path):
    tricky = [(-1, "token=token: abcdefgh"), (-2, 'x 𝄞 API_KEY" : "abc/def+=" PassWd=short secret = 123456'), (-3, "AKIA" + "A" * 15 + " AKIAAKIA" + "B" * 16 + "é"), (-4, "g" + "a" * 24 + "ff-" + "0" * 23),
              (-5, "-----BEGIN RSA PRIVATE KEY----- http://me:pw@host/"), (-6, None)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(tricky, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secret_scan.report(every, str(tmp_path / "a")).collect()}
    for r in every.collect():
        a, b, c = spans(r["text"] or "")
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
        g = got[r["doc_id"]]
        assert (g["n_assign"], g["n_access"], g["n_hex"], g["base_sha256"]) == (len(a), len(b), len(c), hashlib.sha256(base.encode()).hexdigest())
        assert set(filter(None, base.split(","))) <= set(g["spans"].split(","))
    assert "pem:0:" in got[-5]["spans"] and "login:" in got[-5]["spans"]


def test_secret_ledger_is_incremental(spark, odd, none, tmp_path):
    ledger = str(tmp_path / "b")
    first = secret_scan.scan(odd, ledger, rules=secret_scan.BASE[:1]).count()
    blobs = spark.read.parquet(f"{ledger}/scanned").count()
    assert first == 1 and blobs == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    found = secret_scan.scan(odd, ledger)
    assert found.count() == 3       # the new rules read the old blobs, the old rule doesn't
    again = spark.read.parquet(f"{ledger}/scanned")
    assert again.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where("n != 2").count() == 0
    assert not again.where(F.array_contains("rules", "assign/1") & (F.size("rules") > 1)).count()
    size = again.count()
    secret_scan.scan(odd, ledger)
    assert spark.read.parquet(f"{ledger}/scanned").count() == size
    hidden = secret_scan.redact(odd, str(tmp_path / "c"))
    assert hidden.columns == odd.columns and hidden.count() == odd.count()
    r = hidden.where("doc_id = 12").first()
    assert r["text"] == "[secret] and [secret] [secret]" and r["n_chars"] == len(r["text"])
    assert secret_scan.report(none, str(tmp_path / "d")).count() == 0


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    prints = {}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 3
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    # groups: all fingerprints within 3 bits
    value = {i: int(got[i]["fingerprint"], 16) for i in ids}
    root = {i: i for i in ids}
    for a in sorted(ids):
        for b in sorted(ids):
            if a < b and value[a] and value[b] and (value[a] ^ value[b]).bit_count() <= 3:
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {i: got[i]["near_group"] for i in ids} == root


def test_fingerprints_odd(odd, none):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[4]["fingerprint"] == by[6]["fingerprint"] == "0" * 32 and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert by[4]["n_chars"] == 0 and by[4]["near_edited"] == 1.0
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0        # labels the fit doesn't see
    got = quality.score(big, labels.where(~held)).join(labels.where(held), "doc_id")
    r = got.groupBy().agg(F.avg((F.col("keep") == ((F.col("quality") == 1) & (labels["toxic"] == 0))).cast("double")).alias("right"),
                          F.avg(F.when((F.col("quality") == 1) & (labels["toxic"] == 0), F.col("keep").cast("double"))).alias("clean_kept")).first()
    assert r["right"] > 0.97 and r["clean_kept"] > 0.99


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (None, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, labels).count() == odd.count()
    empty = labels.where("false")
    assert quality.score(odd, empty).where("keep").count() == odd.count()
    assert quality.filter_documents(odd, empty).columns == odd.columns
    assert quality.score(none, empty).count() == 0


def test_decontamination(spark, docs, texts):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    edited = []
    for k, (i, w) in enumerate(sorted(items.items())[:40]):
        w = [x.decode() for x in w]
        for j in range(3, len(w), 6):
            w[j] = "changed"
        edited.append((10_000 + k, "before it " * 30 + " ".join(w) + " after it" * 30))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(edited, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(every, bench).collect()}
    for k, (i, w) in enumerate(sorted(items.items())[:40]):
        assert got[10_000 + k, i] >= 0.5
    for i, t in texts.items():
        flat = b" " + b" ".join(words(t)) + b" "
        for j, w in items.items():
            if b" " + b" ".join(w) + b" " in flat:
                assert got[i, j] == 1.0
    for (i, j), s in got.items():     # and nothing that shares little
        w = texts.get(i)
        assert w is None or len(shingles(w, 2) & {tuple(items[j][k:k + 2]) for k in range(len(items[j]) - 1)}) > 0.3 * len(items[j])


def test_alignment():
    import numpy as np
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 8, 3, 4, 5, 9])
    assert decontaminate.smith_waterman([a, a, a], [b, a, np.array([7])])[0].tolist() == [9, 10, 0]


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "big bad wolf tonight"), (4, "big bad wolf tonight"), (None, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, bench).collect()}
    assert {(1, 4), (2, 4), (7, 1), (8, 1), (None, 4)} <= got and not any(i in (4, 5, 6) for i, _ in got)
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.matches(odd, bench.where("false")).count() == 0 and decontaminate.matches(none, bench).count() == 0


def test_mixing(docs):
    got = sorted(mixing.mix(docs, {"src0": 0.5, "src1": 0.3, "src2": 0.2}, block=4, period=10, rows_per_bucket=16).collect(), key=lambda r: r["position"])
    n = Counter(r["source"] for r in got)
    assert [r["position"] for r in got] == list(range(docs.count())) and n == Counter(r["source"] for r in docs.collect())
    slots = sorted({(r["slot"], r["source"]) for r in got})
    assert [s for s, _ in slots] == list(range(len(slots)))
    had = Counter()
    for t, (_, s) in enumerate(slots):
        if any(had[x] * 4 >= n[x] for x in ("src0", "src1", "src2")):
            break
        had[s] += 1
        assert all(abs(had[x] - w * (t + 1)) < 1 for x, w in (("src0", 0.5), ("src1", 0.3), ("src2", 0.2)))


def test_schedule_deviates_by_less_than_one_block():
    for share in ({"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {f"s{k}": k + 1 for k in range(13)}):
        plan, period, had = mixing.schedule(share), sum(share.values()), Counter()
        for t, s in enumerate(plan):
            had[s] += 1
            assert all(abs(had[x] - w * (t + 1) / period) < 1 for x, w in share.items())


def test_mixing_odd(odd, none):
    got = mixing.mix(odd, block=2).collect()
    assert sorted(r["position"] for r in got) == list(range(odd.count())) and any(r["source"] is None for r in got)
    assert sorted(r["position"] for r in mixing.mix(odd, {"s0": 1.0}, block=2).collect()) == list(range(odd.count()))
    assert mixing.mix(none).count() == 0
