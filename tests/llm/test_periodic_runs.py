"""Periodic runs against brute force over all stretches, on the small table and on odd cases."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfsense.llm import periodic_runs as pr


def brute(w):
    """All runs by trying each period on each maximal stretch."""
    out, n = {}, len(w)
    code = np.unique(np.array([b"", *w], object), return_inverse=True)[1][1:]
    for q in range(1, n // 4 + 1):
        same = np.r_[False, code[q:] == code[:-q], False].astype(int)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if j + q - i >= max(6, 4 * q):
                out.setdefault((int(i), int(j) + q - int(i)), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def edited(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = edited(doc_id, (text or "").encode().split())
    runs = brute(w)
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *longest, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pr.digests(pr.find(pr.planted(docs))).select(COLUMNS).collect()
    assert {tuple(r) for r in got} == {expected(r["doc_id"], r["text"]) for r in docs.collect()}
    assert len(got) == docs.count() and any(r["n_runs"] for r in got)


def test_random_words():
    """Few kinds of words, pasted repeats, runs inside runs."""
    r, texts = random.Random(1), []
    for _ in range(400):
        kinds = [b"a", b"b", b"c", b"d", b"e"][:r.randint(1, 5)]
        w = [r.choice(kinds) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            unit = w[r.randrange(len(w)):][:r.randint(1, 12)] if w else kinds
            w[r.randrange(len(w) + 1):0] = (unit * 12)[:r.randint(0, len(unit) * 6)]
        texts.append(w)
    assert pr.runs_of(texts) == [brute(w) for w in texts]
    assert sum(map(len, pr.runs_of(texts))) > 300


def test_splitting_keeps_every_run_and_little_else():
    rare = [b"x%d" % i for i in range(5000)]
    w = rare[:2000] + [b"one", b"two", b"three"] * 5 + rare[2000:] + [b"one", b"two"] * 2
    codes = np.unique(w, return_inverse=True)[1].astype(np.int64)
    assert pr.split(codes, np.array([0, len(w)])) == [(2000, 2015)]
    assert pr.runs_of([w]) == [[(2000, 15, 3)]]


def test_long_texts_of_one_run_are_not_quadratic():
    assert pr.runs_of([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert pr.runs_of([[b"a", b"b", b"a"] * 60_000]) == [[(0, 180_000, 3)]]


def test_odd(odd, none):
    rows = odd.collect()
    got = pr.digests(pr.find(pr.planted(odd))).select(COLUMNS).collect()
    want = [expected(r["doc_id"], r["text"]) if r["doc_id"] is not None else None for r in rows]
    assert Counter(tuple(r) for r in got if r["doc_id"] is not None) == Counter(x for x in want if x)
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 2
    full = pr.find(odd, keep=odd.columns)
    assert full.columns == [*odd.columns, "n_words", "runs", "collapsed"] and full.count() == len(rows)
    assert pr.find(none).count() == 0 and pr.digests(pr.find(pr.planted(none))).count() == 0


@pytest.mark.parametrize("text, words", [("a\x0bb\x1cc", [b"a", b"b\x1cc"]), (" x y", [" x".encode(), b"y"])])
def test_words(spark, text, words):
    assert text.encode().split() == words
    assert [x.encode() for x in spark.createDataFrame([(text,)], "t string").select(pr.words_of(pr.F.col("t"))).first()[0]] == words
