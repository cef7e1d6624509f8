"""Lexicon matching against every pair, and folders of CSV files of several kinds."""
import random


from shelfsense.operators import safety
from shelfsense.sources import io


def test_lexicon_match_equals_every_pair(spark):
    r = random.Random(3)
    piece = lambda n: "".join(r.choice("abcd éß𝄞") for _ in range(n))
    texts = [(i, piece(r.randint(0, 60)).upper() if i % 3 else piece(r.randint(0, 60))) for i in range(60)]
    texts += [(100, None), (101, ""), (3, texts[3][1]), (3, "another text of this id abc"), (None, "abcd abcd"), (102, "x" * 50_000 + "needle" + "y" * 50_000)]
    terms = [(piece(r.randint(0, 5)), k) for k in range(80)] + [(None, 1), ("", 2), ("Needle", 3), ("needles", 4), ("ABC", 5), ("abc", 6)]
    got = safety.lexicon_match(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(terms, "term string, sev int"), "id", "t", "term")
    assert got.columns == ["id", "term", "sev"]
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    want = [(i, w.lower(), s) for i, t in texts for w, s in terms if w is not None and w.lower() in (t or "").lower()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and len(want) > 300


def test_no_terms_and_no_texts(spark):
    texts, terms = spark.createDataFrame([(1, "abc")], "id int, t string"), spark.createDataFrame([("abc",)], "term string")
    assert safety.lexicon_match(texts, terms.where("false"), "id", "t", "term").count() == 0
    assert safety.lexicon_match(texts.where("false"), terms, "id", "t", "term").count() == 0


def test_folder_of_many_files_of_few_kinds(spark, tmp_path):
    for k in range(12):
        head = ["Product ID,Name", "product_id,name", "﻿Product-ID,Price"][k % 3]
        body = f"{k},only {k}\n7,shared\n" if k % 3 < 2 else f"{k},{k}.5\n"
        (tmp_path / f"f{k:02d}.csv").write_text(f"{head}\n{body}", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "twice.csv").write_text("a,A,a\n1,2,3\n")
    files = io.list_csv_files(spark, str(tmp_path))
    got = io.read_folder(spark, files)
    rows = {(r["product_id"], r["name"], r["price"], r["a"], r["a_2"], r["a_3"]): r["source_file"].rsplit("/", 1)[1] for r in got.collect()}
    want = {(str(k), f"only {k}", None, None, None, None): f"f{k:02d}.csv" for k in range(12) if k % 3 < 2}
    want |= {(str(k), None, f"{k}.5", None, None, None): f"f{k:02d}.csv" for k in range(2, 12, 3)}
    want |= {("7", "shared", None, None, None, None): "f00.csv", (None, None, None, "1", "2", "3"): "twice.csv"}
    assert rows == want and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3      # one reader for each kind of header
    assert io.read_folder(spark, [f for f in files if f.endswith("empty.csv")]).count() == 0
