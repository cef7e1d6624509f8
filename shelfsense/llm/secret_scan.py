"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its content; equal
contents are one blob.  A ledger folder holds which rule versions have read a
blob and what they found.  A scan looks up the pairs of blob and rule version
that the ledger lacks, reads only those blobs with only those rules, adds the
outcome to the ledger, and joins the ledger's findings back to all paths.

The ledger has two tables: ``findings`` (blob, rule, start, end) and ``scanned``
(blob, rules).  ``findings`` is written first; a scan that dies in between is
done anew by the next one, and findings that are there twice count once.

Spans are in code points, end exclusive, leftmost and non-overlapping for each
rule.  Positions come from cutting the text at the matches: the pieces and the
matches alternate, so a span begins at the sum of the lengths before it.

Null content counts as empty.  Repeated rows each get their result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .groups import free_name


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str          # Java regular expression
    group: int = 0        # the part of a match that must have ...
    at_least: int = 1     # ... so many characters; shorter matches are dropped

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


#: The kinds that must be found.  A run of one character class is
#: taken whole, so for ``access`` and ``hex`` a length in the pattern finds the
#: same matches as dropping the short ones; ``assign`` must drop them after
#: matching, since a short match covers text where another could begin.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Further kinds.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE + MORE


def content(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, start, end) of what ``rules`` find in ``blobs`` (blob, content, rules: names of those to apply)."""
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.at_least).alias("at_least"),
                     F.when(F.array_contains("rules", r.name) & F.col("content").rlike(r.pattern),
                            F.arrays_zip(F.split("content", r.pattern, -1).alias("piece"), F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0)).alias("match"),
                                         F.regexp_extract_all("content", F.lit(r.pattern), F.lit(r.group)).alias("part"))).alias("cuts")) for r in rules]
    found = blobs.select("blob", F.explode(F.array(*each)).alias("x")).where("x.cuts is not null")
    found = found.select("blob", "x.rule", "x.at_least", F.posexplode("x.cuts").alias("i", "cut"))
    found = found.select("blob", "rule", "at_least", "i", F.length("cut.piece").alias("piece"), F.length("cut.match").alias("match"), F.length("cut.part").alias("part"))
    w = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("piece") + F.coalesce("match", F.lit(0))).over(w))
    return found.where("match is not null and part >= at_least").select("blob", "rule", (F.col("end") - F.col("match")).alias("start"), "end")


def read(spark: SparkSession, ledger: str, table: str, schema: str) -> DataFrame:
    """A table of the ledger; empty before the first scan."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{table}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in schema.split(", "))])
    return spark.read.schema(schema).parquet(f"{ledger}/{table}")


def scan(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring ``ledger`` up to date with the texts of ``versions``; (blob, rule, start, end) of all its findings by ``rules``."""
    spark = versions.sparkSession
    names = [r.name for r in rules]
    seen = read(spark, ledger, "scanned", "blob string, rules array<string>")
    seen = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    blobs = versions.select(F.sha2(content(text), 256).alias("blob"), content(text).alias("content")).groupBy("blob").agg(F.any_value("content").alias("content"))
    blobs = (blobs.join(seen, "blob", "left")
                  .withColumn("rules", F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("seen", F.array().cast("array<string>"))))
                  .where(F.size("rules") > 0))
    spans(blobs.select("blob", "content", "rules"), rules).write.mode("append").parquet(f"{ledger}/findings")
    todo = versions.select(F.sha2(content(text), 256).alias("blob")).distinct().join(seen, "blob", "left")
    todo = todo.select("blob", F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    cut_lineage(todo).write.mode("append").parquet(f"{ledger}/scanned")
    return read(spark, ledger, "findings", "blob string, rule string, start long, end long").where(F.col("rule").isin(names)).distinct()


def of_paths(versions: DataFrame, findings: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``found``: array of (start, kind number, end), by start and then kind as listed; empty if none."""
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    by_blob = cut_lineage(findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", number[F.col("rule")].alias("kind"), "end"))).alias("found")))
    key = free_name("blob", versions)
    return (versions.withColumn(key, F.sha2(content(text), 256)).join(by_blob.withColumnRenamed("blob", key), key, "left").drop(key)
                    .withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))


def listing(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: str) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    found = of_paths(docs, scan(docs, ledger)).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
                        F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"))


def redact(docs: DataFrame, ledger: str, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by ``mark`` and ``n_chars`` (if there) as it then is; overlapping spans are replaced as one."""
    columns = docs.columns
    aside = free_name("found_before", docs)      # a column found of the caller
    found = of_paths(docs.withColumnRenamed("found", aside) if "found" in columns else docs, scan(docs, ledger))
    # from the front: what is kept so far, and the end of the last span
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.when(x["start"] >= s["end"], F.struct(
        F.concat(s["kept"], F.substring("text", (s["end"] + 1).cast("int"), (x["start"] - s["end"]).cast("int")), F.lit(mark)).alias("kept"), x["end"].alias("end"),
    )).otherwise(F.struct(s["kept"].alias("kept"), F.greatest(s["end"], x["end"]).alias("end")))
    done = F.aggregate("found", start, step, lambda s: F.concat(s["kept"], F.substring(F.col("text"), (s["end"] + 1).cast("int"), F.length("text"))))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("found") > 0, F.length(done).cast(kind)).otherwise(F.col("n_chars")))
    out = found.withColumn("text", F.when(F.size("found") > 0, done).otherwise(F.col("text"))).drop("found")
    return out.withColumnRenamed(aside, "found").select(*columns) if "found" in columns else out.select(*columns)
