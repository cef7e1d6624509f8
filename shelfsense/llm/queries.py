"""Queries of the subpackage, bound to the driver's tables: QUERIES and ORACLES as in plans.registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import (cross_tokens, decontaminate, fingerprints, language_model, line_dedup, mixing, near_dedup, page_text, periodic_runs, quality, secret_scan, url_lists,
               warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, similarity 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, near_dedup.Params(ngram=3, percent=85, max_errors=19, chunks=10))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by a ledger of blobs that begins empty."""
    return secret_scan.report(table(spark, sf_dir, "documents"), scratch(spark, "ledger"))


@query("op7_url_lists", url_lists.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries in force on the day each page was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.evaluate(url_lists.captures_of(pages), url_lists.entries_of(pages))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and of an edit of each."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_warc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    manifest = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch(spark, "warc"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_page_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op10_language_model")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents, learnt from six sevenths of them."""
    return language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, copied or edited, and the items."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of all documents in which sources appear by the square root of their sizes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, of which one in ten is edited to hold one."""
    return periodic_runs.digests(periodic_runs.find(periodic_runs.planted(table(spark, sf_dir, "documents"))))


@query("op12_line_dedup", line_dedup.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier document holds."""
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op11_cross_tokens")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, their groups and links, and the corpus-wide counts of linked ids."""
    found = cross_tokens.score(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
