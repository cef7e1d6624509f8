"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are cut into blocks of ``block`` rows.  Time is a
sequence of slots, one block each.  Block j (from 0) of a source of weight w may
not run before its release floor(j / w) and must run by its deadline
ceil((j + 1) / w); in each slot the released block with the earliest deadline
runs.  The weights of the sources that still have blocks add up to 1, so no
deadline is missed, and at every time the number of blocks a source has had
differs by less than one from its weight times the time.

Weights are exact: the decimal values given, as whole numbers of any length, are
never rounded to shares of a period, so the deviation doesn't grow with the
number of slots.  When a source runs out, the next phase goes on with the other
sources, their weights scaled up.  Each slot depends on those before it, so one
task works them out, a step for every ``block`` rows; it holds one row per source
and ``period`` slots, never documents, and hands the slots on as it goes.  The
driver holds one row per source.

Rows are ordered within a source by a hash of the id; positions come from row
counts of hash buckets, so a source with a third of all rows is no single task.

Defined results: a null source is a source of its own; sources without target
weight get 0 and come last, in order of their names, one after the other; a last
block may be short; without target weights every source weighs as the square
root of its rows.  Every row gets one place; repeated rows get different ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import count, islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: stands for a null source
NO_SOURCE = "\0null"


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the proportions of their decimal values."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = lcm(*[x.denominator for x in exact.values()])
    return {s: int(x * unit) for s, x in exact.items()}


def turns(share: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end: earliest deadline first among the released blocks."""
    total = sum(share.values())
    waiting, ready, done = [], [], {s: 0 for s in share}
    for s in share:
        heapq.heappush(waiting, (0, s))
    for t in count():
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            # equal deadlines: the later the next release may be, the less a delay does; the heavier goes first
            heapq.heappush(ready, (-(-(done[s] + 1) * total // share[s]), -share[s], s))
        _, _, s = heapq.heappop(ready)
        yield s
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // share[s], s))


def schedule(share: dict[str, int], slots: int | None = None) -> list[str]:
    """The source of each slot until the shares are used up (or of the first ``slots``)."""
    return list(islice(turns(share), sum(share.values()) if slots is None else slots))


def order(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot until all blocks are placed."""
    left, done = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    while weighted := {s: weights[s] for s in left if weights.get(s, 0) > 0}:
        for s in turns(whole(weighted)):
            yield s, done[s]
            done[s] += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
    for s in sorted(left):
        yield from ((s, k) for k in range(left[s]))


def slots(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float], period: int) -> DataFrame:
    """source, source_block, slot of all blocks, worked out by a task and handed on ``period`` slots at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            todo, at = order(blocks, weights), 0
            while some := list(islice(todo, max(1, period))):
                source, block = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(range(at, at + len(some)), pa.int64())], names=["source", "source_block", "slot"])
                at += len(some)

    return spark.range(1, numPartitions=1).mapInArrow(run, "source string, source_block long, slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 64, period: int = 1000, rows_per_bucket: int = 4096) -> DataFrame:
    """doc_id, source, source_block, slot, position (0, 1, ... in the order of the mix) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"))
    total = rows.count()
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(5))).withColumn("bucket", F.pmod(F.col("order"), F.lit(max(1, total // rows_per_bucket))))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = cut_lineage(rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")))
    of = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    weights = {s: n ** 0.5 for s, n in of.items()} if weights is None else {NO_SOURCE if s is None else s: w for s, w in weights.items()}
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source", "bucket", "before")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "row")
    placed = (rows.join(offsets, ["source", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
                  .select("doc_id", "source", "rank", F.floor(F.col("rank") / block).alias("source_block")))

    blocks = slots(spark, {s: -(-n // block) for s, n in of.items()}, weights, period)
    of_block = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    blocks = blocks.join(of_block, "source").withColumn("rows", F.least(F.lit(block), F.col("n") - F.col("source_block") * block))
    # first position of each slot: all slots are full but for the last block of each source
    short = [(s, -(-n // block) - 1, block - 1 - (n - 1) % block) for s, n in of.items() if n % block]
    blocks = cut_lineage(blocks.select("source", "source_block", "slot", "rows"))
    gaps = (blocks.where(F.col("rows") < block).select(F.col("slot").alias("gap_slot"), (F.lit(block) - F.col("rows")).alias("gap"))) if short else None
    if gaps is not None:
        gaps = gaps.collect()      # one row per source at most
        steps = F.array(*[F.struct(F.lit(r["gap_slot"]).alias("slot"), F.lit(r["gap"]).alias("gap")) for r in gaps])
        missing = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + F.when(x["slot"] < F.col("slot"), x["gap"]).otherwise(0))
    else:
        missing = F.lit(0)
    blocks = blocks.select("source", "source_block", "slot", (F.col("slot") * block - missing).alias("begin"))
    return placed.join(blocks, ["source", "source_block"]).select(
        "doc_id", F.nullif("source", F.lit(NO_SOURCE)).alias("source"), "source_block", "slot", (F.col("begin") + F.col("rank") % block).alias("position"))
