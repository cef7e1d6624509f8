"""MinHash near-duplicate groups by a multi-index Hamming join.

Each text becomes a set of word n-grams and the set a signature of
``positions`` values of 16 bits, one from the smallest hash of each of as many
hash functions.  Two sets of Jaccard similarity s disagree in a position with
probability 1 - s at most, so a pair at the similarity threshold exceeds
``max_errors`` disagreements with a probability of about 1e-6 at the defaults
(48 positions, similarity 0.8) and 1e-5 for 0.85 with 19 errors in 10 chunks.

The join finds *all* pairs with at most ``max_errors`` disagreements: the
positions are split into ``chunks``; by the pigeonhole principle some chunk has
at most ``max_errors // chunks`` of them (1 at the defaults), and for every
chunk all ways of leaving out that many of its positions are written out as
keys.  Pairs under a common key are checked by set sizes, by the lowest four bits
of each position, packed into 64-bit lanes (values that differ there differ, so no
pair within ``max_errors`` is lost), and by a bitmap of each set: of 512 classes
of hashes, those that hold an odd number of the set.  Two bitmaps differ in no more
bits than the sets differ in elements, so this check loses no linked pair either.
What passes is checked by its full sets.

Nulls, empty texts and texts of white space have an empty set: they are linked
with nothing.  Rows with equal sets form one class, whatever their number; a
class is one node of the graph.  A repeated doc_id keeps all its rows.  A null
doc_id gets the group of its class, or null if no row of the group has an id,
and is never the kept row.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W
from .groups import free_name, linked, packed, sized


#: bits of a position that are compared inside the joins, and positions in one 64-bit lane
BITS, PER_LANE = 4, 16
BITMAP = tuple(f"p{k}" for k in range(8))


@dataclass(frozen=True)
class Params:
    ngram: int = 5
    percent: int = 80          # linked if 100 * |A & B| >= percent * |A | B|
    positions: int = 48
    max_errors: int = 23
    chunks: int = 12


def sets(column: pa.Array, ngram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct n-gram hashes, where each text's begin) for blocks of texts."""
    for block in W.blocks(column):
        yield block.first, *W.distinct_sorted(*W.ngrams(block, ngram, whole_if_short=True))


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, equal for equal sets."""
    n = np.diff(at).astype(np.uint64)
    a = W.per_text(np.add, W.mix(h ^ W.SALT[100]), at, 0)
    b = W.per_text(np.bitwise_xor, W.mix(h ^ W.SALT[101]), at, 0)
    return W.int64(W.mix(a * W.ODD[100] + b * W.ODD[101] + n))


def sign(h: np.ndarray, at: np.ndarray, positions: int) -> np.ndarray:
    """Signatures (texts x positions, int16); zeros for empty sets."""
    out = np.zeros((len(at) - 1, positions), np.int16)
    for k in range(positions):
        low = W.per_text(np.minimum, (h ^ W.SALT[k]) * W.ODD[k], at, 0)
        out[:, k] = ((low >> np.uint64(13)) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
    return out


def lanes(p: Params) -> list[str]:
    return [f"s{k}" for k in range(ceil(p.positions / PER_LANE))]


def pack(sig: np.ndarray) -> list[np.ndarray]:
    """The lowest bits of all positions: one int64 for each ``PER_LANE`` of them."""
    low = (sig & ((1 << BITS) - 1)).astype(np.uint64)
    at = np.arange(PER_LANE, dtype=np.uint64) * np.uint64(BITS)
    parts = [low[:, k:k + PER_LANE] for k in range(0, sig.shape[1], PER_LANE)]
    return [W.int64(np.bitwise_or.reduce(x << at[:x.shape[1]], axis=1)) for x in parts]


def parity(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Bitmap of the classes of hashes that hold an odd number of each set, in int64 columns."""
    n, width = len(at) - 1, 64 * len(BITMAP)
    cell = np.repeat(np.arange(n), np.diff(at)) * width + ((h >> np.uint64(24)) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * width) & 1).astype(np.uint8)
    return list(np.packbits(odd.reshape(n, width), axis=1).view(np.int64).T)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), sig, its packed lanes and the bitmap of every row."""
    packed = [*lanes(p), *BITMAP]
    schema = "doc_id long, n_shingles long, node long, sig array<smallint>, " + ", ".join(f"{x} long" for x in packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, h, at in sets(batch.column(1), p.ngram):
                n = np.diff(at)
                sig = sign(h, at, p.positions)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(set_ids(h, at), mask=n == 0),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.positions), pa.array(sig.ravel())),
                    *[pa.array(np.ascontiguousarray(x)) for x in (*pack(sig), *parity(h, at))]],
                    names=["doc_id", "n_shingles", "node", "sig", *packed])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def choices(p: Params) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(chunk, its begin, its end, positions left out) of every key of a signature."""
    edges = [round(k * p.positions / p.chunks) for k in range(p.chunks + 1)]
    return [(c, s, e, out) for c, (s, e) in enumerate(zip(edges, edges[1:])) for out in combinations(range(s, e), min(p.max_errors // p.chunks, e - s))]


def keys(sig: str, p: Params) -> F.Column:
    """Array of the keys of a signature: each chunk without each choice of allowed errors."""
    return F.array(*[F.xxhash64(F.lit(c), F.lit(sum(1 << (i - s) for i in out)), *[F.col(sig)[i] for i in range(s, e) if i not in out])
                     for c, s, e, out in choices(p)])


def rests(sig: str, p: Params) -> F.Column:
    """For each key the value of its one left-out position, null for the first of a chunk.

    A pair that agrees on a whole chunk shares all of the chunk's keys and is
    needed under one only (:func:`once`).
    """
    return F.array(*[F.col(sig)[out[0]] if len(out) == 1 and out[0] > s else F.lit(None).cast("smallint") for _, s, _, out in choices(p)])


def once(a: str, b: str) -> F.Column:
    """True under one of the keys of a chunk that a pair shares."""
    return F.col(a + "rest").isNull() | (F.col(a + "rest") != F.col(b + "rest"))


def close(p: Params):
    """Condition on set sizes, bitmaps and packed signatures that linked sets fulfil."""
    ones = sum(1 << (BITS * k) for k in range(PER_LANE))

    def errors(a: str, b: str, lane: str) -> F.Column:
        x = F.col(a + lane).bitwiseXOR(F.col(b + lane))
        shift = 1
        while shift < BITS:      # the lowest bit of each position gets any bit that differs
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    def condition(a: str, b: str) -> F.Column:
        sizes = F.expr(f"100 * least({a}n, {b}n) >= {p.percent} * greatest({a}n, {b}n)")
        apart = sum((F.bit_count(F.col(a + x).bitwiseXOR(F.col(b + x))) for x in BITMAP), F.lit(0))
        few = apart * (100 + p.percent) <= (F.col(a + "n") + F.col(b + "n")) * (100 - p.percent)
        return sizes & few & (sum((errors(a, b, x) for x in lanes(p)), F.lit(0)) <= p.max_errors)

    return condition


def same_sets(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of nodes that are linked by their full sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("doc").alias(f"doc_{x}"))
    near = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "doc_a", "doc_b"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    rows = near.count()
    near = packed(near, rows)
    asked = near.select(F.col("doc_a").alias("doc")).union(near.select(F.col("doc_b").alias("doc"))).distinct()
    text = text.join(sized(asked, 2 * rows), "doc", "left_semi")
    both = (near.join(text.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a")
                .join(text.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
                .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            good = []
            for i in range(0, len(a), 256):
                rows = min(256, len(a) - i)
                mixed = pa.concat_arrays([batch.column(2).slice(i, rows), batch.column(3).slice(i, rows)])
                every = [(x, ids[k], x[at[k]:at[k + 1]]) for _, x, at in sets(mixed, p.ngram) for ids in [set_ids(x, at)] for k in range(len(at) - 1)]
                for k in range(rows):
                    (_, id_a, x), (_, id_b, y) = every[k], every[rows + k]
                    # a repeated doc_id brings other texts of that id along; they aren't the node's
                    if id_a == a[i + k] and id_b == b[i + k]:
                        common = len(x) + len(y) - len(np.union1d(x, y))
                        if 100 * common >= p.percent * (len(x) + len(y) - common):
                            good.append(i + k)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    assert p.positions >= p.chunks > 0 and ceil(p.positions / p.chunks) > p.max_errors // p.chunks
    rows = cut_lineage(signatures(docs, p))
    nodes = cut_lineage(rows.where("node is not null and doc_id is not null").groupBy("node")
                            .agg(F.min("doc_id").alias("doc"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"),
                                 *[F.any_value(x).alias(x) for x in (*lanes(p), *BITMAP)]))
    buckets = nodes.select("node", F.inline(F.arrays_zip(keys("sig", p).alias("key"), rests("sig", p).alias("rest"))))
    root = linked(buckets, nodes.select("node", "n", *lanes(p), *BITMAP), close(p), lambda pairs: same_sets(pairs, nodes, docs, p), once)
    of_node = nodes.select("node", "doc").join(root, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    smallest = of_node.groupBy("root").agg(F.min("doc").alias("component_id"))
    group = cut_lineage(of_node.join(smallest, "root").select("node", "component_id"))
    out = rows.select("doc_id", "n_shingles", "node").join(group, "node", "left")
    return (out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
               .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def representatives(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest doc_id, all columns unchanged.

    Rows with a null doc_id count as documents with ids of their own, larger than
    all others, equal for equal texts.  Of repeated rows one stays.
    """
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    key, place = free_name("_id", docs), free_name("_same", docs)
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own))
    kept = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), p).where("kept").select(F.col("doc_id").alias(key)).distinct()
    same = Window.partitionBy(key, F.xxhash64("text")).orderBy(key)
    return rows.join(kept, key).withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).select(*docs.columns)
