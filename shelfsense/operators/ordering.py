"""Distributed global ordering helpers.

A global ``row_number() OVER (ORDER BY ...)`` without PARTITION BY runs in a
single task.  :func:`global_index` gives the same 0-based position with a
distributed sort instead.  The sorted rows are materialised once, by a
reliable checkpoint in the shared folder, and both the position inside a
partition and the per-partition row counts are read from that one copy.  They
must not come from two evaluations of the sort: column pruning gives the two
different row widths, adaptive coalescing then numbers their partitions
differently, and the offsets no longer fit the rows.  The offsets are one row
per partition, so their size follows the partition count, not the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_index(df: DataFrame, order: Sequence[Column | str], out: str = "idx") -> DataFrame:
    """Add ``out`` = 0-based position of the row in the total order ``order``.

    ``order`` must be a total order (add a unique tie-breaker) for the result
    to be deterministic.
    """
    in_order = cut_lineage(df.orderBy(*order))
    tagged = (in_order.withColumn("_pid", F.spark_partition_id())
                      .withColumn("_mid", F.monotonically_increasing_id()))
    # position inside the partition = mid - (pid << 33)
    tagged = tagged.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    return (tagged.join(F.broadcast(off), "_pid", "left")
                  .withColumn(out, F.col("_off") + F.col("_pos"))
                  .drop("_pid", "_mid", "_pos", "_off"))


def dense_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """0-based dense rank of the distinct non-NULL values of ``col`` (sorted)."""
    vals = df.select(col).where(F.col(col).isNotNull()).distinct()
    return global_index(vals, [F.col(col)], out)
