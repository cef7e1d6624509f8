"""Page operators against brute force, on a small table and on odd cases."""
import hashlib
import html
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as E
from shelfsense.llm import page_text, url_lists, warc

SMALL = "/root/testdata/sf0.001"
BIG = "<html><body>" + "<p>line of text</p>" * 20_000 + "</body></html>"
ODD = [(1, "http://a.example/x", "<article><p>one</p></article>"), (1, "http://a.example/x", "<article><p>one</p></article>"), (2, None, None), (None, "http://A.example:80/x/y?q#f", ""),
       (3, "http://a.example/x/1", BIG), (4, "http://a.example/x/2", BIG), (5, "nonsense", "<p>a < b &amp; c<br>d &lt;e"), (6, "http://a.example/x/3\r\nX: y", "é" * 600), (7, "http://b.example", "é" * 600)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    pages = pages.union(pages.limit(7).selectExpr("page_id + 100000", "url", "html"))
    rows = {r["page_id"]: r for r in pages.collect()}
    same = defaultdict(list)
    for i, r in rows.items():
        same[r["html"]].append(i)
    got = warc.read(warc.write(pages, str(tmp_path / "w")), payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        p = rows[r["page_id"]]
        data, last = p["html"].encode(), max(same[p["html"]])
        revisit = len(data) >= 1000 and last != r["page_id"]
        assert (r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) == (
            p["url"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None, None if revisit else data)


def test_warc_odd(odd, tmp_path):
    got = warc.read(warc.write(odd, str(tmp_path / "w"))).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted(
        [(1, 29, "response", None)] * 2 + [(2, 0, "response", None), (0, 0, "response", None), (3, len(BIG), "revisit", 4), (4, len(BIG), "response", None),
                                          (5, 27, "response", None), (6, 1200, "revisit", 7), (7, 1200, "response", None)])
    assert warc.read(warc.write(odd.where("false"), str(tmp_path / "none"))).count() == 0


def test_warc_damage():
    import io
    good = warc.record(5, "http://x/", b"payload", warc.sha1(b"payload"), None, "2024-01-01T00:00:00Z")
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = member.compress(good) + member.flush()
    assert [warc.parse(m)["payload"] for m in warc.members(io.BytesIO(member * 3))] == [b"payload"] * 3
    for bad in (good.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"), good[:-1]):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(member[:-9])))


def test_page_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in page_text.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(x for x in parts if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_page_text_odd(odd):
    got = page_text.extract(odd).collect()
    assert len(got) == len(ODD)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "one" and by[2] == "" and by[5] == "a < b & c d <e" and by[None] == "" and by[7] == "é" * 600
    assert page_text.extract(odd.where("false")).count() == 0


def test_shared_lines_are_deleted(spark):
    page = "<div>Site title</div><div>{}</div><div>All rights reserved</div>"
    rows = [(k, f"http://h.example/a/{k}", page.format(f"Story number {k}")) for k in range(5)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: (r["text"], r["n_deleted"]) for r in got} == {k: (f"Story number {k}", 2) for k in range(5)}


def test_structure():
    page = ("<body><header>Head</header><nav>Menu</nav><article><h1>T</h1><p class=lead>One<p>Two <b>bold</b>&nbsp;x</p><aside>Side</aside><form><input>Send</form>"
            "<div class='comments'><p>Nice!</p></div><!-- <p>no</p> --><script>if (a < b) '</p>'</script><p>Three</article><div id=\"cookie-notice\">Ok?</div><footer>Foot")
    assert page_text.main_text(page_text.lines(page), set())[0] == "T\nOne\nTwo bold x\nThree"


def test_common_subsequence():
    import random
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        got = page_text.common(a, b)
        assert len(got) == length[-1][-1]
        rest = iter(b)
        assert all(any(a[k] == y for y in rest) for k in sorted(got))     # really a subsequence of b


def test_url_lists(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    res = con.execute(E.oracle_sql()["op7_url_lists"])
    names = [d[0] for d in res.description]
    got = E.queries()["op7_url_lists"](spark, SMALL)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, res.fetchall()))


def test_url_lists_as_of(spark, odd):
    entries = spark.createDataFrame([("l", "a.example", "add", "2024-01-02"), ("l", "a.example", "remove", "2024-01-04"), ("l", "a.example", "add", "2024-01-04"), ("m", "a.example/x", "add", "2024-01-03"), ("l", None, "add", "2024-01-01")],
                                    "list string, key string, action string, dated string").selectExpr("list", "key", "action", "date(dated) dated")
    captures = spark.createDataFrame([(k, u, f"2024-01-0{k}") for k in range(1, 6) for u in ("http://www.a.example/x/y", "http://a.example/z", "http://ba.example/")] * 2 + [(9, None, "2024-01-03"), (8, "http://a.example/x", None)],
                                     "page_id long, url string, day string").selectExpr("page_id", "url", "date(day) fetched_on")
    got = {(r["page_id"], r["url"]): r["lists"] for r in url_lists.evaluate(captures, entries).collect()}
    assert [got[k, "http://a.example/z"] for k in range(1, 6)] == ["", "l", "l", "", ""]
    assert [got[k, "http://www.a.example/x/y"] for k in range(1, 6)] == ["", "l", "l", "", ""]
    assert {got[k, "http://ba.example/"] for k in range(1, 6)} == {""} and got[9, None] == got[8, "http://a.example/x"] == ""
    assert url_lists.evaluate(captures, entries).count() == 32
    assert url_lists.evaluate(url_lists.captures_of(odd), url_lists.entries_of(odd)).count() == len(ODD)
    assert url_lists.evaluate(captures.where("false"), entries.where("false")).count() == 0
