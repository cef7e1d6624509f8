"""Sources and sinks.

Readers never infer schemas from data on a cluster-wide pass beyond the
header; types are applied with ``try_cast``.  Writers produce Parquet
partitioned by the natural period columns.  Scratch output goes under the
cluster's shared checkpoint folder, never a machine-local temp folder.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------------ A01
def read_csv_tolerant(spark: SparkSession, path: str, encodings: Sequence[str] = ("utf-8", "latin-1", "cp1252"),
                      max_rows: int | None = None, schema: str | None = None) -> DataFrame:
    """CSV with header; malformed lines dropped; first encoding without U+FFFD
    replacement characters wins (one cheap existence probe per encoding)."""
    df = None
    for enc in encodings:
        r = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("encoding", enc)
        if schema:
            r = r.schema(schema)
        df = r.csv(path)
        cols = [F.col(c).cast("string") for c in df.columns]
        bad = df.where(F.exists(F.array(*cols), lambda v: F.instr(v, F.lit("�")) > 0)).limit(1).count() \
            if cols else 0
        if bad == 0:
            break
    if max_rows is not None:
        df = df.limit(max_rows)
    return df


# ------------------------------------------------------------------ A02
def first_lines(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, str]]:
    """(file, first line) of every file that has one, read by one job; a byte order mark is left out."""
    lines = spark.read.text(list(files)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.where("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("line"))
    return sorted((r["file"], r["line"].lstrip("\ufeff")) for r in first.collect())      # one short row per file, as many as the caller names


def column_names(header: Sequence[str]) -> tuple[str, ...]:
    """Normalised names of a header line; a name that comes again gets a number."""
    names: list[str] = []
    for name in map(tx.normalise_header, header):
        k, own = 2, name or "column"
        while own in names:
            own, k = f"{name or 'column'}_{k}", k + 1
        names.append(own)
    return tuple(names)


def read_folder(spark: SparkSession, files: Sequence[str], file_col: str = "source_file") -> DataFrame:
    """Every CSV file: headers normalised, rows tagged with the file name, union by
    name (missing columns NULL), exact duplicates (ignoring the file tag) dropped, the first file's tag kept.

    Files whose normalised headers are the same are read by one reader, whatever their number, so the plan grows with
    the kinds of headers, not with the files.  Malformed lines are dropped; empty files give nothing."""
    kinds: dict[tuple[str, ...], list[str]] = {}
    for file, line in first_lines(spark, files):
        names = next(csv.reader([line]), [])
        kinds.setdefault(column_names(names), []).append(file)
    out = None
    for names, group in sorted(kinds.items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = (spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(group)
                     .select(*[F.col(f"`{n}`") for n in names], F.col("_metadata.file_path").alias(file_col)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], f"{file_col} string")
    data = [c for c in out.columns if c != file_col]
    return out.groupBy(*data).agg(F.min(file_col).alias(file_col))


def list_csv_files(spark: SparkSession, folder: str) -> list[str]:
    """File listing through the Hadoop file system (metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(conf)
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        s = it.next().getPath().toString()
        if s.endswith(".csv"):
            out.append(s)
    return sorted(out)


# ------------------------------------------------------------------ A03
SALES_DEFAULT_MAP = {"sale_id": "sale_id", "product_id": "product_id", "units_sold": "units_sold",
                     "sale_date": "sale_date", "revenue": "revenue"}


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 8,
              properties: Mapping[str, str] | None = None) -> DataFrame:
    """Tenant database pull: parallel range-partitioned JDBC read when a numeric key is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", partitions))
    return r.load()


def apply_column_map(df: DataFrame, column_map: Mapping[str, str], defaults: Mapping[str, object] | None = None,
                     limit: int | None = None) -> DataFrame:
    """Rename source columns to targets with a per-tenant map over defaults; missing
    targets get their default (or NULL).  ``limit`` is the optional per-sync row cap."""
    sel = []
    for target, source in column_map.items():
        if source in df.columns:
            sel.append(F.col(source).alias(target))
        else:
            sel.append(F.lit((defaults or {}).get(target)).alias(target))
    out = df.select(*sel)
    for t, v in (defaults or {}).items():
        if t not in column_map:
            out = out.withColumn(t, F.lit(v))
    return out.limit(limit) if limit else out


# ------------------------------------------------------------------ A04
REQUIRED = {"sales": {"product_id", "units_sold"}, "products": {"product_id", "product_name"}}


def detect_kind(columns: Sequence[str]) -> str:
    cols = {tx.normalise_header(c) for c in columns}
    for kind, req in REQUIRED.items():
        if req <= cols:
            return kind
    return "unknown"


# ------------------------------------------------------------------ A05
def append_sales(target: DataFrame, batch: DataFrame, as_of_year: int, as_of_month: int,
                 id_col: str | None = "sale_id", value_cols: Sequence[str] | None = None) -> DataFrame:
    """Idempotent sales load: coerce, default year/month, drop unparseable rows, and
    keep only rows whose key is not in the target.  Key = source sale id, else
    (hash of the row, occurrence number) so genuine equal sales both survive."""
    b = (batch.withColumn("units_sold", F.col("units_sold").cast("string").try_cast("double"))
              .withColumn("year", F.coalesce(F.col("year").cast("int") if "year" in batch.columns else F.lit(None).cast("int"),
                                             F.year("sale_date"), F.lit(as_of_year)))
              .withColumn("month", F.coalesce(F.col("month").cast("int") if "month" in batch.columns else F.lit(None).cast("int"),
                                              F.month("sale_date"), F.lit(as_of_month)))
              .where(F.col("units_sold").isNotNull() & F.col("product_id").isNotNull()))
    if id_col and id_col in batch.columns:
        keys = [id_col]
    else:
        cols = list(value_cols or [c for c in b.columns if c not in ("year", "month")])

        def keyed(df):
            h = F.xxhash64(*[F.col(c) for c in cols])
            w = Window.partitionBy(h).orderBy(*cols)
            return df.withColumn("_row_hash", h).withColumn("_occ", F.row_number().over(w))
        b, target = keyed(b), keyed(target)
        keys = ["_row_hash", "_occ"]
    return b.join(target.select(*keys), keys, "left_anti").drop("_row_hash", "_occ")


def write_sales(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("year", "month").parquet(path)


# ------------------------------------------------------------------ A06
def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update given columns (an update's NULL keeps the old value), insert new keys.
    One full outer join on the key; the result is written to a new path and swapped."""
    k = list(keys)
    cols = [c for c in target.columns if c not in k]
    u = updates.select(*k, *[F.col(c).alias(f"_u_{c}") for c in cols if c in updates.columns])
    j = target.join(u, k, "full")
    return j.select(*k, *[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in updates.columns else F.col(c)
                          for c in cols])


# ------------------------------------------------------------------ A07
INSERT_DEFAULTS = {"brand": "Unknown", "price": 25.0, "units_sold": 50.0, "current_stock": 100.0, "reorder_level": 30.0}


def insert_new(existing: DataFrame, candidates: DataFrame, key: str = "product_id", name: str = "product_name",
               defaults: Mapping[str, object] = INSERT_DEFAULTS, preview: int = 10) -> tuple[DataFrame, DataFrame]:
    """Insert only keys not present; blanks get defaults; missing ids are generated
    from the name (md5).  Returns (inserted rows, first ``preview`` of them)."""
    c = candidates.withColumn(key, F.coalesce(F.col(key).cast("string"),
                                              tx.hash_id(tx.normalise_text(F.col(name)), "PRD")))
    for col_name, v in defaults.items():
        if col_name in c.columns:
            c = c.withColumn(col_name, F.coalesce(F.col(col_name), F.lit(v)))
        else:
            c = c.withColumn(col_name, F.lit(v))
    new = c.join(existing.select(F.col(key).cast("string").alias(key)), key, "left_anti")
    return new, new.orderBy(key).limit(preview)


# ------------------------------------------------------------------ A08
def seed_missing_inventory(products: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("product_id",),
                           reorder: float = 50.0, lead: float = 14.0) -> DataFrame:
    """Inventory rows for products without one; stock = md5(id) mod 451 + 50 (deterministic)."""
    k = list(keys)
    miss = products.select(*k).distinct().join(inventory.select(*k), k, "left_anti")
    return miss.select(*k, (tx.md5_mod(F.col(k[0]), 451) + 50).cast("double").alias("current_stock"),
                       F.lit(reorder).alias("reorder_level"), F.lit(lead).alias("lead_time_days"))


# ------------------------------------------------------------------ A09
def load_chemicals(raw: DataFrame, name: str = "chemical_name", order: Sequence[str] = ()) -> DataFrame:
    """First row per name; severity by keyword (mercury/lead 10, formaldehyde 9,
    phthalate/coal tar 8, paraben 7, else 5); risk high >= 8, medium >= 5, else low."""
    w = Window.partitionBy(F.lower(F.trim(F.col(name)))).orderBy(*order) if order else \
        Window.partitionBy(F.lower(F.trim(F.col(name)))).orderBy(F.col(name))
    first = raw.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    n = F.lower(F.col(name))
    sev = (F.when(F.instr(n, "mercury") > 0, 10).when(F.instr(n, "lead") > 0, 10)
            .when(F.instr(n, "formaldehyde") > 0, 9).when(F.instr(n, "phthalate") > 0, 8)
            .when(F.instr(n, "coal tar") > 0, 8).when(F.instr(n, "paraben") > 0, 7).otherwise(5))
    return (first.withColumn("severity_score", sev)
                 .withColumn("risk_level", F.when(F.col("severity_score") >= 8, "high")
                             .when(F.col("severity_score") >= 5, "medium").otherwise("low")))


# ------------------------------------------------------------------ A10
def sink_tables(tables: Mapping[str, DataFrame], base: str, drop: Sequence[str] = ("_source", "_row_hash"),
                fmt: str = "parquet") -> list[str]:
    """Write each non-empty table (bookkeeping columns dropped); returns written names."""
    written = []
    for name, df in tables.items():
        df = df.drop(*[c for c in drop if c in df.columns])
        if df.limit(1).count() == 0:
            continue
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(f"{base}/{name}")
        else:
            w.parquet(f"{base}/{name}")
        written.append(name)
    return written


# ------------------------------------------------------------------ A11
def report_kv(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flatten report rows into (keys..., field, value) with values as strings."""
    fields = [c for c in df.columns if c not in keys]
    cast = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in fields])
    return cast.unpivot(list(keys), fields, "field", "value")


# ------------------------------------------------------------------ A12
PRODUCT_DOC_SCHEMA = ("product_id long, product_name string, brand string, "
                      "pricing struct<price:double,cost_price:double>, tags array<string>")


def write_product_docs(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_product_docs(spark: SparkSession, path: str, schema: str = PRODUCT_DOC_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------ A14
def tenant_reset(df: DataFrame, tenant_value, tenant: str = "dealer_id") -> DataFrame:
    return df.where(F.col(tenant).isNull() | (F.col(tenant) != F.lit(tenant_value)))
