"""Connected components of a similarity graph whose candidate pairs come from shared keys.

Nodes are 64-bit numbers that look random (hashes); :func:`components` relies
on that for few rounds.  A bucket is the set of nodes under one key; any two
nodes of a bucket may be linked, and a check says whether they are.

Writing out all pairs of a bucket costs the square of its size, which is
pointless for a large group of near copies: one link from each of them to a
common node connects them.  :func:`linked` therefore first compares each node
with a few nodes of each of its buckets, joins what is linked into components, and
then compares only pairs that lie in different components.
Two nodes that share a key and end in different components have been compared,
so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: pairs of 64-bit numbers that a join may broadcast: about 4 MB
BROADCAST_ROWS = 1 << 18
#: rows of one or two 64-bit numbers that are worth a task of their own: about 1 MB
TASK_ROWS = 1 << 16

Check = Callable[[DataFrame], DataFrame]


def free_name(name: str, df: DataFrame) -> str:
    """``name``, or with as many _ before it as it takes that no column of ``df`` has it (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def none(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): one root for each connected component.

    Each round sends a node to the smallest node next to it, and from there once
    more, and replaces the ends of all links by what they were sent to, until no
    link joins two different nodes.
    """
    spark = links.sparkSession
    links = cut_lineage(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    root = None
    while n := links.count():
        links = packed(links, n)
        ends = links.union(links.select("b", "a"))
        to = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        step = to.join(sized(to.select(F.col("node").alias("to"), F.col("to").alias("next")), 2 * n), "to").select("node", F.col("next").alias("to"))
        step = cut_lineage(packed(step, 2 * n))
        if root is None:
            root = step.withColumnRenamed("to", "root")
        else:
            root = (root.join(sized(step.withColumnRenamed("node", "root"), 2 * n), "root", "left")
                        .select("node", F.coalesce("to", "root").alias("root")))
        links = (links.join(sized(step.select(F.col("node").alias("a"), F.col("to").alias("x")), 2 * n), "a")
                      .join(sized(step.select(F.col("node").alias("b"), F.col("to").alias("y")), 2 * n), "b")
                      .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        links = cut_lineage(packed(links, n))
    return none(spark) if root is None else cut_lineage(root)


def packed(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (at most ``rows`` rows) in as many partitions as that is worth: a round of few links needn't write files for every shuffle partition."""
    return pairs.coalesce(max(1, -(-rows // TASK_ROWS)))


def sized(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (one or two 64-bit numbers, at most ``rows`` rows) marked for a broadcast if that is within the bound, else for a shuffled join."""
    return F.broadcast(pairs) if rows <= BROADCAST_ROWS else pairs


def linked(buckets: DataFrame, facts: DataFrame, close: Callable[[str, str], Column], check: Check | None = None,
           once: Callable[[str, str], Column] | None = None, stars: int = 4, many: int = 32) -> DataFrame:
    """(node, root) of every node that is linked with another one.

    ``buckets`` (key, node, ...; a pair of key and node once) is read twice; ``facts`` (node, ...) holds what
    ``close`` compares: given two prefixes it returns the condition, on columns
    named prefix + fact, that any linked pair fulfils; ``check`` takes distinct
    pairs (a, b) that do and returns those that are linked (None: all are).
    A pair may share many keys; ``once``, on further columns of ``buckets`` and
    on the facts, is a condition that holds under at least one of them and may
    fail under the others, so that the last step writes the pair out less often.

    First each node is compared with ``stars`` nodes of each of its buckets, the
    same ones for as many buckets as possible (those of the smallest hashes).
    In the last step, the nodes of a bucket meet by joins that have ``close`` as a
    condition, so pairs that aren't close are never written out.  Nodes of one
    component aren't compared there: a component with ``many`` nodes or more in a
    bucket meets the bucket's other nodes as a side of its own.
    """
    names = [c for c in facts.columns if c != "node"]

    def known(d: DataFrame, node: str, prefix: str) -> DataFrame:
        return d.join(facts.select(F.col("node").alias(node), *[F.col(c).alias(prefix + c) for c in names]), node)

    marks = [c for c in buckets.columns if c not in ("key", "node")]
    # most keys are one node's own: a count, the smallest thing to shuffle for each key, finds the others
    crowded = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = cut_lineage(buckets.join(crowded, "key").select("key", "node", *marks))

    star = [F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(stars)]
    stars_of = shared.groupBy("key").agg(F.array_distinct(F.array(*star)).alias("stars"))
    found = shared.select("key", "node").join(stars_of, "key").select("node", F.explode("stars").alias("star")).where("node != star")
    found = found.select(F.least("star", "node").alias("a"), F.greatest("star", "node").alias("b")).distinct()
    tested = cut_lineage(known(known(found, "a", "a_"), "b", "b_").where(close("a_", "b_")).select("a", "b"))
    tested = packed(tested, tested.count())
    links = tested if check is None else cut_lineage(check(tested).select("a", "b"))
    root = components(links)

    here = shared.join(sized(root, root.count()), "node", "left").select("key", "node", *marks, F.coalesce("root", "node").alias("root"))
    mixed = here.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key")
    here = cut_lineage(here.join(mixed, "key"))
    large = cut_lineage(here.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= many).select("key", "root"))
    few = here.join(large, ["key", "root"], "left_anti")
    lot = here.join(large, ["key", "root"])
    side = lambda d, x: known(d.select("key", F.col("node").alias(x), F.col("root").alias(f"{x}_root"), *[F.col(c).alias(f"{x}_{c}") for c in marks]), x, f"{x}_")
    near = close("a_", "b_") if once is None else once("a_", "b_") & close("a_", "b_")
    pairs = side(few, "a").join(side(few, "b").withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & (F.col("a_root") < F.col("b_root")) & near).select("a", "b")
    if not large.isEmpty():
        across = side(few, "a").join(side(lot, "b").withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & near).select("a", "b")
        two = large.select("key", F.col("root").alias("a_root")).join(large.select("key", F.col("root").alias("b_root")), "key").where("a_root < b_root")
        both = two.join(side(lot, "a"), ["key", "a_root"])
        both = both.join(side(lot, "b").withColumnRenamed("key", "key_b").withColumnRenamed("b_root", "root_b"),
                         (F.col("key") == F.col("key_b")) & (F.col("b_root") == F.col("root_b")) & near).select("a", "b")
        pairs = pairs.union(across).union(both)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"))
    pairs = packed(pairs, pairs.count())
    return components(links.union(pairs if check is None else cut_lineage(check(pairs).select("a", "b"))))
