"""Cross-tokenizer alignment against brute force over tokens and documents, and odd cases."""
import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest

from shelfsense.llm import cross_tokens as ct
from shelfsense.llm import queries

A, B = ct.Tokenizers().a, ct.Tokenizers().b


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(coders, rows):
    """The contract's columns of rows (doc_id, text), with bytes compared one by one."""
    a, b = coders
    alphabet, out, holds = ct.byte_of(), [], Counter()
    for doc_id, text in rows:
        data = b" " + (text or "").encode()
        ids_a, ids_b = a.encode(data.decode(), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            out.append((doc_id, [], [], "", Counter()))
            continue
        owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
        owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = Counter((ids_a[i], ids_b[j]) for i, j in set(zip(owner_a, owner_b)))
        ends = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
        ea, eb = ends(bytes_a), ends(bytes_b)
        cuts = sorted(set(ea) & set(eb))
        part = [("", [], []) for _ in cuts]
        for side, ids, parts in ((1, ids_a, bytes_a), (2, ids_b, bytes_b)):
            for i, e in zip(ids, ends(parts)):
                part[bisect_left(cuts, e)][side].append(str(i))
        groups = ";".join(",".join(x) + "|" + ",".join(y) for _, x, y in part)
        holds.update(links.keys())
        out.append((doc_id, ids_a, ids_b, groups, links))
    best = {}
    for (i, _), n in holds.items():
        best[i] = max(n, best.get(i, 0))
    for doc_id, ids_a, ids_b, groups, links in out:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        yield (doc_id, len(ids_a), len(ids_b), groups.count("|"), sum(links.values()), sum(m for (i, j), m in links.items() if holds[i, j] == best[i]), sum(m * holds[x] for x, m in links.items()), digest)


def contract(docs, **k):
    scored = ct.score(docs, **k)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], digest(r["groups"])) for r in scored.collect())


def test_against_brute_force(spark, coders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter(brute(coders, [(r["doc_id"], r["text"]) for r in docs.collect()]))
    got = queries.op11(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert contract(docs.repartition(3), broadcast_pairs=0) == want


def test_odd(spark, odd, none, coders):
    more = [(30, "a<|endoftext|>b </s> <0x41> <unk>"), (31, "under▁score"), (32, "two  spaces   and\ttab\n\nlines "), (33, " "), (34, "éé ﬁ ﬁ Ａ １ ​ x"), (35, "日本語 текст 🙂🙂"), (36, "\x00null"), (37, " " * 300), (38, "don't WON'T it's 12345 x²")]
    docs = odd.select("doc_id", "text", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = Counter(brute(coders, [(r["doc_id"], r["text"]) for r in docs.collect()]))
    for k in ({}, {"broadcast_pairs": 0}):
        assert contract(docs, **k) == want
    assert any(x[1] == 0 and x[0] == 31 for x in want) and any(x[1] > 0 and x[0] == 30 for x in want)
    full = ct.align(odd, keep=odd.columns)
    assert full.columns == [*odd.columns, "n_a", "n_b", "n_groups", "groups", "links"] and full.count() == odd.count()
    assert contract(none) == Counter()


def test_long_white_space(coders):
    a = ct.ByteLevel(A)
    assert a.fast is not None
    for text in (" " * 1_000_000 + "a", "\n" * 200_000, "x" * 300_000, " don't 1234 ünï 日本  　 x"):
        assert a.encode(text).tolist() == coders[0].encode(text, add_special_tokens=False).ids


def test_units_are_independent(coders):
    """Tokens of units put together are those of the whole text, also next to every kind of white space."""
    r, tool = random.Random(2), ct.Aligner(ct.Tokenizers())
    parts = ["a", "don't", "été", ".", "12", "\n", "\t", " ", "  ", "\u00a0", "\u3000", "\x85", "\x1c", "日本", "🙂", "x" * 70, "'s", "\r\n", "—", "$$$"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        units = tool.cut.split(" " + text)
        assert [i for u in units for i in tool.a.encode(u).tolist()] == coders[0].encode(" " + text, add_special_tokens=False).ids
        assert [i for x in tool.b.encode([u[1:] for u in units]) for i in x] == coders[1].encode(text)


def test_same_ids_for_every_code_point(coders):
    a = ct.ByteLevel(A)
    texts = [f" a{chr(c)}b1{chr(c)}2!{chr(c)}? {chr(c)}{chr(c)} x" for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert all(a.encode(t).tolist() == e.ids for t, e in zip(texts, coders[0].encode_batch(texts, add_special_tokens=False)))


def test_bitmaps_of_both_forms():
    rng = np.random.default_rng(1)
    link = np.concatenate([np.full(70_000, 5), np.full(3, 7), rng.integers(100, 200, 5000)])
    doc = np.concatenate([rng.integers(0, ct.CONTAINER, 70_000), [9, 9, 9], rng.integers(0, 50, 5000)])
    p = ct.planes(link, doc)
    times = Counter(zip(link.tolist(), doc.tolist()))
    back = Counter()
    for x, maps in zip(p["link"].to_pylist(), p["planes"].to_pylist()):
        for k, m in enumerate(maps):
            for d in ct.members(m).tolist():
                back[x, d] += 1 << k
    assert back == times
    assert p["n_times"].to_pylist() == [sum(n for (y, _), n in times.items() if y == x) for x in p["link"].to_pylist()]
    assert p["n_docs"].to_pylist() == [sum(y == x for y, _ in times) for x in p["link"].to_pylist()]
    assert any(len(m) == ct.BITS for maps in p["planes"].to_pylist() for m in maps)
    import pyarrow as pa
    worth = np.array([2 * x + x % 2 for x in p["link"].to_pylist()])
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(worth), np.int64)), pa.array(worth), p["planes"]], ["container", "worth", "planes"])
    for parts in ([rows], [rows.slice(1), rows.slice(0, 1)], [rows.slice(1, 40), rows.slice(41), rows.slice(0, 1)]):
        sums, best = Counter(), Counter()
        for out in ct.hand_back(iter(parts)):
            for _, d, s, b in zip(*(c.to_pylist() for c in out.columns)):
                sums[d] += s
                best[d] += b
        want = Counter()
        for (x, d), n in times.items():
            want[d] += x * n
        assert sums == want and sum(best.values()) == sum(n for (x, _), n in times.items() if x % 2)
