"""Each stage of the pipeline on what the one before kept."""
import corpus_pipeline
from shelfsense.llm import decontaminate, quality, secret_scan

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen.append((name, before, docs))
    assert [n for n, _, _ in seen] == ["quality", "near_dedup", "decontaminate", "secrets", "mixing"]
    for name, before, after in seen[:-1]:
        assert after.columns == columns
    kept = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, _, d in seen}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = {r["doc_id"] for r in quality.score(seen[0][1], labels).where("keep").collect()}
    assert kept["quality"] == judged
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate.matches(seen[2][1], bench).collect()}
    assert kept["decontaminate"] == kept["near_dedup"] - bad
    assert kept["secrets"] == kept["decontaminate"] == kept["mixing"]
    assert secret_scan.report(seen[3][2], str(tmp_path / "ledger")).where("n_assign + n_access + n_hex > 0").count() == 0
    assert sorted(r["position"] for r in seen[4][2].collect()) == list(range(len(kept["mixing"])))
