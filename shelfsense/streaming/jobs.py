"""Structured Streaming jobs.

The reference polls a tenant database and re-appends everything on every
sync.  Here each job is an incremental stream with a checkpoint (exactly-once
bookkeeping): file sources are picked up once, duplicates within the
watermark are dropped by key, aggregates are keyed by event-time windows,
and micro-batches that need set logic (upserts, stock refresh) go through
``foreachBatch`` into the batch operators.  ``trigger(availableNow=True)``
processes everything present and stops, which is how each job is checked
against its batch twin.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rules
from ..session import cut_lineage
from ..sources import io


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def run_available_now(writer) -> list:
    """Process what is there, then stop; the progress of the batches."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return list(q.recentProgress)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps as long as its checkpoint; with an epoch it names a batch for good."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


# ------------------------------------------------------------------ K01
def stream_sales_ingest(events: DataFrame, sink: str, checkpoint: str, key: Sequence[str] = ("sale_id",),
                        event_time: str = "sale_ts", watermark: str = "30 days") -> None:
    """Dedup by sale key within the watermark, append to the sales table partitioned by period."""
    s = (events.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(key))
               .withColumn("year", F.year(event_time)).withColumn("month", F.month(event_time)))
    run_available_now(s.writeStream.format("parquet").option("checkpointLocation", checkpoint)
                       .partitionBy("year", "month").option("path", sink).outputMode("append"))


# ------------------------------------------------------------------ versioned tables
def versions(spark: SparkSession, target_path: str) -> list[tuple[int, str]]:
    """(number, folder name) of the complete versions of a table; a version counts once its write has committed."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(target_path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()]
    found = [(int(m.group(1)), n) for n in names if (m := re.fullmatch(r"v(\d{6,})(-.*)?", n))]
    return sorted(x for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target_path}/{x[1]}/_SUCCESS")))


def current_version(spark: SparkSession, target_path: str, below: int | None = None) -> str:
    """Folder of the newest complete version (below ``below``)."""
    done = [name for n, name in versions(spark, target_path) if below is None or n < below]
    if not done:
        raise FileNotFoundError(f"no complete version in {target_path}")
    return f"{target_path}/{done[-1]}"


def commit_version(spark: SparkSession, target_path: str, batch: str, make: Callable[[DataFrame | None], DataFrame]) -> None:
    """Write ``make(newest version or None)`` as the next version, once for each ``batch``.

    Versions are numbered after the highest there is, whatever stream wrote it, and carry the batch's name (query
    id and epoch): a batch that is retried after its version has committed changes nothing, and a new
    checkpoint on an old table goes on from that table.  One stream at a time may write to a table."""
    done = versions(spark, target_path)
    if any(name.endswith(f"-{batch}") for _, name in done):
        return
    base = spark.read.parquet(f"{target_path}/{done[-1][1]}") if done else None
    number = done[-1][0] + 1 if done else 0
    make(base).write.mode("overwrite").parquet(f"{target_path}/v{number:06d}-{batch}")


def newest_rows(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``; equal ones are told apart by a hash of the row, not by where it lies."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


# ------------------------------------------------------------------ K02
def stream_upsert_products(updates: DataFrame, target_path: str, keys: Sequence[str], checkpoint: str,
                           order: str = "updated_at") -> list:
    """Each micro-batch is merged into the current product table (A06) as its next version.

    Of several updates of a key the one with the greatest ``order`` counts.  The table keeps that column
    (added where it has none); an update older than what the table holds is passed over, in whatever batch it comes."""
    spark = updates.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        last = newest_rows(batch, keys, order)

        def merged(table: DataFrame | None) -> DataFrame:
            if table is None:
                return last
            if order not in table.columns:
                table = table.withColumn(order, F.lit(None).cast(batch.schema[order].dataType))
            held = table.select(*keys, F.col(order).alias("_held"))
            new = last.join(held, list(keys), "left").where(F.col("_held").isNull() | (F.col(order) >= F.col("_held"))).drop("_held")
            return io.upsert(table, new, keys)
        commit_version(spark, target_path, f"{query_id(spark, checkpoint)}-{epoch}", merged)
    return run_available_now(updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge))


# ------------------------------------------------------------------ K03
def stream_weekly_demand(events: DataFrame, sink: str, checkpoint: str, key: str = "product_id",
                         event_time: str = "sale_ts", value: str = "units", watermark: str = "14 days") -> list:
    """Tumbling 7-day windows starting Monday (epoch + 4 days), units per product.

    A week is written once, when the watermark has passed its end; its state goes then, and rows that come later are
    dropped.  Each batch writes a folder of its own, named by query id and epoch, so a retried batch replaces what
    it wrote.  Rows without a key only move the watermark: a source that falls silent closes its
    weeks by such a row."""
    spark = events.sparkSession
    w = (events.withWatermark(event_time, watermark)
               .groupBy(key, F.window(event_time, "7 days", "7 days", "4 days").alias("w"))
               .agg(F.sum(value).alias("units"))
               .select(key, F.date_add(F.to_date(F.col("w.start")), 6).alias("week_end"), "units"))

    def write(batch: DataFrame, epoch: int) -> None:
        out = f"{sink}/run={query_id(spark, checkpoint)}/epoch={epoch}"
        batch.where(F.col(key).isNotNull()).write.mode("overwrite").parquet(out)
    return run_available_now(w.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                              .foreachBatch(write))


# ------------------------------------------------------------------ K04
def stream_alert_dedup(alerts: DataFrame, sink: str, checkpoint: str,
                       keys: Sequence[str] = ("dealer_id", "product_id", "title"),
                       event_time: str = "created_at", watermark: str = "7 days") -> None:
    d = alerts.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))
    run_available_now(d.writeStream.format("parquet").option("checkpointLocation", checkpoint)
                       .option("path", sink).outputMode("append"))


# ------------------------------------------------------------------ K05
def stream_stock_refresh(changes: DataFrame, series: DataFrame, target_path: str, checkpoint: str,
                         keys: Sequence[str] = ("dealer_id", "product_id"), event_time: str = "changed_at",
                         value: str = "current_stock") -> list:
    """Stock changes -> G01 of the touched products, upserted into a versioned status table.

    The state holds one row per product, its latest change by event time (of equal times the greater stock), so changes
    that come late, twice or in any order end in the same stock.  A batch emits the products it touched,
    which are joined to the demand series, judged, and merged as the table's next version."""
    spark, k = changes.sparkSession, list(keys)
    latest = changes.groupBy(*k).agg(F.max(F.struct(event_time, value)).alias("_m")).select(*k, f"_m.{event_time}", f"_m.{value}")

    def merge(batch: DataFrame, epoch: int) -> None:
        batch = cut_lineage(batch)      # read whole, and once, also by a retried batch whose version is there: its state commits
        out = rules.stock_status(batch.join(series, k)).select(*k, event_time, value, "days_until_stockout", "stock_status", "stockout_risk")
        commit_version(spark, target_path, f"{query_id(spark, checkpoint)}-{epoch}",
                       lambda table: out if table is None else table.join(out.select(*k), k, "left_anti").unionByName(out))
    return run_available_now(latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge))


# ------------------------------------------------------------------ K06
def stream_sentiment(reviews: DataFrame, sink: str, checkpoint: str, text: str = "review_body") -> None:
    from ..operators import text_analytics as ta
    s = ta.sentiment_boost(reviews, text)
    run_available_now(s.writeStream.format("parquet").option("checkpointLocation", checkpoint)
                       .option("path", sink).outputMode("append"))
