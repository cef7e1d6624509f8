"""Line removal against brute force, by both ways to the filter, and odd cases."""
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfsense.llm import line_dedup as ld

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(UPPER)


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept) of rows (doc_id, text); no id comes last and is one document."""
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("p", [ld.Params(), ld.Params(broadcast_bytes=0), ld.Params(bits_per_line=1)])
def test_against_brute_force(spark, p):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert Counter(map(tuple, ld.dedup(docs, p).collect())) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_filter_thins_out(spark):
    docs = spark.createDataFrame([(i, f"only in document {i}\nshared by two: {i // 2}\nin all documents") for i in range(4000)], "doc_id long, text string")
    n = ld.suspects(docs, ld.Params()).count()
    assert 8000 <= n < 8100      # repeats, and few of the 4000 others


def test_odd(spark, odd, none):
    more = [(21, "  A line of TEXT \nshort\nshort\n\n"), (22, "a line of text\nshort"), (20, "\ta LINE of text\n\x0ba line of text"), (22, "another text of this id\na line of text"),
            (None, "a line of text\nonly without an id"), (None, "only without an id"), (23, "ÄÖÜ lower?\n" * 3), (24, "äöü lower?\nÄÖÜ LOWER?"), (25, "123456789\n123456789 "), (26, "123456789\n1234567890"), (27, "1234567890"),
            (28, "x" * 300_000 + "\nend"), (29, "x" * 300_000)]
    docs = odd.select("doc_id", "text", "key", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for p in (ld.Params(), ld.Params(broadcast_bytes=0)):
        assert Counter(map(tuple, ld.dedup(docs, p).collect())) == want
    assert ld.dedup(none).count() == 0


def test_bits_seen_by_two_tasks_are_seen_twice():
    h = np.array([0x0001000200030004, 0x0005000600070008, 0x0001000200030004], np.int64)
    a, b = (ld.noted(np.zeros(len(x), np.int64), x) for x in (h[:2], h[2:]))
    import pyarrow as pa
    words = ld.merged(pa.Table.from_batches([a, b]))["twice"].to_pylist()[0]
    assert words[0] == 0b11110 and not any(words[1:])
    assert ld.merged(pa.Table.from_batches([ld.noted(np.zeros(3, np.int64), h)]))["twice"].to_pylist()[0] == words
