"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. The seeds of an item are all its n-grams, frequent ones too: an edit may
   leave no other intact.  Tasks test the n-grams of whole texts against a bit
   table of fixed size, whatever the size of the benchmark.
2. Passages around seeds (as long as the longest item on either side, and
   merged where they overlap) are joined to the items of their seeds by the
   seeds' hashes, which also removes what the table let through by chance.
3. Items with too few words in the passage to reach the score in any order, as
   those that only share a frequent phrase, need no alignment.
4. Each passage is aligned with each other item by Smith and Waterman's local
   alignment over words (equal +2, different -1, gap -1).  The score is the
   alignment's divided by that of the item with itself: 1 for a full copy, about
   0.7 for one with a fifth of the words changed.

A copy whose edits leave no n-gram of the item intact (every third word changed)
has no seed and isn't found.

A short item (fewer words than an n-gram) has one seed, all its words, and is
found where the n-gram length allows: items of 1 to n-1 words are looked up as
word runs of their own length.  Null or empty items and documents match nothing.
A null doc_id or item_id is reported as null; repeated rows are reported once.
Equal items are each reported.  Texts and items are told apart by their hashes, so
rows that share an id are judged by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W

#: bits of the table of n-grams
TABLE_BITS = 25


@dataclass(frozen=True)
class Params:
    ngram: int = 3
    contaminated: float = 0.5


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of 2**TABLE_BITS bits with those of the column ``hash`` set, made by tasks in parts and put together."""
    bytes_, parts = 1 << (TABLE_BITS - 3), 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - TABLE_BITS))
            place, value = (bit >> np.uint64(3)).astype(np.int64), np.left_shift(1, (bit & np.uint64(7)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value)], names=["place", "value"])

    table = np.zeros(bytes_, np.uint8)
    rows = (hashes.select("hash").mapInArrow(run, "place long, value long").groupBy("place").agg(F.bit_or("value").alias("value"))
                  .groupBy((F.col("place") % parts).alias("part")).agg(F.collect_list(F.struct("place", "value")).alias("all")))
    for row in rows.toLocalIterator():     # at most one row for each byte of the table
        if row["all"]:
            place, value = np.array(row["all"], np.int64).reshape(-1, 2).T
            table[place] = value
    return table


def marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - TABLE_BITS)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def grams(block: W.Block, n: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word (in the text) of all n-grams, and of all runs of each of ``lengths`` words (of short items)."""
    hs, texts, firsts = [], [], []
    for k in [n, *lengths]:
        h, at = W.ngrams(block, k)
        text = np.repeat(np.arange(len(block)), np.diff(at))
        hs.append(h)
        texts.append(text)
        firsts.append(np.arange(len(h)) - at[text])
    return np.concatenate(hs), np.concatenate(texts), np.concatenate(firsts)


def item_rows(benchmark: DataFrame, p: Params) -> DataFrame:
    """item_id, item (a number for each text; an item_id may have several), words (hashes), seeds (hash of each distinct n-gram) of items with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column(1)):
                short = np.diff(b.at) < p.ngram
                h, at = W.ngrams(b, p.ngram)
                words, seeds = [], []
                for i in range(len(b)):
                    w = b.words[b.at[i]:b.at[i + 1]]
                    words.append(W.int64(w))
                    own = h[at[i]:at[i + 1]]
                    if short[i] and len(w):
                        own, _ = W.ngrams(W.Block(0, w, np.array([0, len(w)]), b.start, b.end, b.data, b.text_at, b.total), len(w))
                    seeds.append(W.int64(np.unique(own)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, len(b)), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["item_id", "words", "seeds"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, words array<long>, seeds array<long>")
    return rows.where(F.size("words") > 0).withColumn("item", F.xxhash64("words"))


def text_key():
    return F.xxhash64(F.col("text").cast("string")).alias("text_key")


def hits(docs: DataFrame, table, n: int, lengths: list[int], width: int) -> DataFrame:
    """Passages around the marked n-grams of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in W.blocks(batch.column(1)):
                h, text, first = grams(b, n, lengths)
                here = marked(table.value, h)
                if here.any():
                    yield passages(batch.column(0).slice(b.first, len(b)), batch.column(2).slice(b.first, len(b)), b, h[here], text[here], first[here], width)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key()).mapInArrow(run, "doc_id long, text_key long, begin long, passage array<long>, seeds array<long>")


def passages(ids, keys, b, h, text, first, width) -> pa.RecordBatch:
    """Passages of the block: doc_id, key of the text, word number of the first word, words, and the seeds in them."""
    order = np.lexsort((first, text))
    h, text, first = h[order], text[order], first[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (first[1:] - first[:-1] > 2 * width)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(h))
    count = np.diff(b.at)
    out_words, out_seeds, out_from = [], [], []
    for s, e in zip(start.tolist(), stop.tolist()):
        t = text[s]
        lo, hi = max(0, first[s] - width), min(count[t], first[e - 1] + width)
        out_from.append(lo)
        out_words.append(W.int64(b.words[b.at[t] + lo:b.at[t] + hi]))
        out_seeds.append(W.int64(np.unique(h[s:e])))
    at = pa.array(text[start])
    return pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(np.array(out_from, np.int64)), pa.array(out_words, pa.list_(pa.int64())), pa.array(out_seeds, pa.list_(pa.int64()))],
                                      names=["doc_id", "text_key", "begin", "passage", "seeds"])


def smith_waterman(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair (equal +2, different -1, gap -1), and where in ``b`` it ends; all pairs side by side."""
    m = max(len(x) for x in b)
    text = np.zeros((len(b), m), np.int64)
    there = np.zeros((len(b), m), bool)
    for i, x in enumerate(b):
        text[i, :len(x)] = x
        there[i, :len(x)] = True
    column = np.arange(1, m + 1, dtype=np.int32)
    row = np.zeros((len(b), m + 1), np.int32)
    best, end = np.zeros(len(b), np.int32), np.zeros(len(b), np.int64)
    for k in range(max(len(x) for x in a)):
        live = np.array([k < len(x) for x in a])
        word = np.array([x[k] if k < len(x) else 0 for x in a])
        step = np.where((text == word[:, None]) & there, 2, -1)
        up = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] - 1), 0)
        # gaps in the item: the best of all places to the left, one point for each step
        now = np.maximum.accumulate(up + column, axis=1) - column
        row = np.zeros_like(row)
        row[:, 1:] = np.where(there & live[:, None], now, 0)
        top = row.max(axis=1)
        better = top > best
        best[better] = top[better]
        end[better] = row.argmax(axis=1)[better]
    return best, end


def possible(batch: pa.RecordBatch, least: float) -> tuple[pa.RecordBatch, list[list[np.ndarray]]]:
    """The pairs whose passage has at least ``least`` of the item's words, and their words and passages."""
    lists = [[np.asarray(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("words", "passage")]
    keep = [k for k, (w, x) in enumerate(zip(*lists)) if np.isin(w, x).sum() >= least * len(w)]
    return batch.take(pa.array(keep, pa.int64())), [[x[k] for k in keep] for x in lists]


def align(pairs: DataFrame, least: float) -> DataFrame:
    """doc_id, text_key, item, score, begin, end (words of the text up to where the alignment ends) of each pair (doc_id, text_key, item, begin, passage, words).

    Pairs that can't score ``least`` are left out: equal words give 2 each, so the
    share of the item's words that occur in the passage bounds the score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, lists = possible(batch, least)
            order = np.argsort([len(x) for x in lists[1]], kind="stable")
            score, end = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            i = 0
            while i < len(order):     # pairs of like length together, a bounded number of cells at once
                j = i + 1
                while j < len(order) and (j + 1 - i) * len(lists[1][order[j]]) <= 200_000:
                    j += 1
                some = order[i:j]
                best, where = smith_waterman([lists[0][k] for k in some], [lists[1][k] for k in some])
                score[some], end[some] = best / np.array([2 * len(lists[0][k]) for k in some]), where
                i = j
            begin = batch.column("begin").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("item"), pa.array(score), pa.array(begin), pa.array(begin + end)], names=["doc_id", "text_key", "item", "score", "begin", "end"])

    return pairs.select("doc_id", "text_key", "item", "begin", "passage", "words").mapInArrow(run, "doc_id long, text_key long, item long, score double, begin long, end long")


def scored(docs: DataFrame, items: DataFrame, p: Params) -> DataFrame:
    """doc_id, text_key, item, score, ... of every passage and item of ``items`` with an alignment of at least ``contaminated``."""
    sc = docs.sparkSession.sparkContext
    items = cut_lineage(items.select("item", "words", "seeds").dropDuplicates(["item"]))
    size = items.agg(F.max(F.size("words")).alias("n"), F.collect_set(F.when(F.size("words") < p.ngram, F.size("words"))).alias("short")).first()
    width, lengths = int(1.25 * (size["n"] or 0)) + 4, sorted(size["short"])
    seeds = items.select("item", F.explode("seeds").alias("hash"))
    found = cut_lineage(hits(docs, sc.broadcast(bit_table(seeds)), p.ngram, lengths, width).withColumn("id", F.monotonically_increasing_id()))
    pairs = cut_lineage(found.select("id", F.explode("seeds").alias("hash")).join(seeds, "hash").select("id", "item").distinct())
    pairs = pairs.join(found.select("id", "doc_id", "text_key", "begin", "passage"), "id").join(items.select("item", "words"), "item")
    return align(pairs, p.contaminated).where(F.col("score") >= p.contaminated)


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, score, n_passages of every document and item with an alignment of at least ``contaminated``."""
    items = cut_lineage(item_rows(benchmark, p))
    found = scored(docs, items, p).join(items.select("item", "item_id").distinct(), "item")
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_passages"))


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item, whatever their doc_id."""
    bad = cut_lineage(scored(docs, item_rows(benchmark, p), p).select("text_key").distinct())
    return docs.join(bad, F.xxhash64(docs["text"].cast("string")) == bad["text_key"], "left_anti")
