"""Exact removal of lines that several documents share, with two Bloom filters in front.

A line's key is the line without white space at its ends, A-Z in lower case.  Keys of
at least ``Params.shortest`` code points that at least two documents hold lose all
their lines except in the document with the smallest id.

1. Each task notes the keys it reads in two filters: bits seen once, and bits seen
   again.  Both are cut into pieces of :data:`PIECE` bits; all four bits of a key lie
   in one piece.  A task sends on only the positions of bits that it has set, and the
   pieces are merged by key: a bit that two tasks have seen once is seen twice
   (:func:`twice_seen`).  The number of pieces follows the number of lines.
2. Lines whose bits have all been seen twice are suspected repeats (:func:`suspects`);
   every true repeat is one.  The filter is broadcast if its size, which is
   known beforehand, is within ``Params.broadcast_bytes``; beyond it, lines meet its
   pieces by a join on the piece, as hashes.
3. Only suspects are shuffled, as SHA-256 digests of their keys: equal digests are
   taken as equal keys.  A key's first and last document confirm it, or not
   (:func:`repeated`, aggregated before the shuffle).
4. What is to be dropped goes back to its documents.  Keys with over a thousandth of
   all suspects, a thousand at most, are broadcast, so no key fills a task.

Defined results: a null or empty text is one empty line.  Rows without an id count as
one document, which comes after all others.  Rows that repeat an id count as one
document: lines they share aren't repeats.  Very long texts are split in their
own row.  Columns that aren't named are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PIECE = 1 << 16
#: lines whose bits a task holds before it sends them on
HELD = 1 << 19
#: a key with more than this share of the suspects is broadcast
HOT_SHARE = 1000
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Params:
    shortest: int = 10                  # code points of a key that counts
    bits_per_line: int = 16
    broadcast_bytes: int = 64 << 20     # size of filter that every executor may hold


def key_of(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(SPACES)), upper, upper.lower())


def lines_of(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, text_hash, line_no, key) of all lines whose key counts."""
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "text_hash", "line_no", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= p.shortest)


def n_pieces(docs: DataFrame, p: Params) -> int:
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)).cast("long") + 1)).first()[0] or 0
    return max(1, -(-lines * p.bits_per_line // PIECE))


def hashed(key: str, pieces: int) -> list[Column]:
    """A key's hash, whose four parts are its positions in a piece, and the piece."""
    h = F.xxhash64(key)
    return [F.pmod(F.xxhash64(h), F.lit(pieces)).alias("piece"), h.alias("h")]


def noted(pieces: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Bits that these keys set: for each piece the positions seen at least once, and those seen again."""
    at = np.ascontiguousarray(h).view(np.uint16).reshape(-1, 4).astype(np.int64)
    bit, count = np.unique((pieces[:, None] * PIECE + at).ravel(), return_counts=True)
    piece, first = np.unique(bit // PIECE, return_index=True)
    ends = np.r_[first, len(bit)]
    again = np.r_[0, np.cumsum(count > 1)][ends]
    low = (bit % PIECE).astype(np.uint16)
    packed = lambda values, at: pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(values)])
    return pa.RecordBatch.from_arrays([pa.array(piece), packed(low, ends), packed(low[count > 1], again)], ["piece", "once", "again"])


def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= HELD:
            yield noted(*map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield noted(*map(np.concatenate, zip(*held)))


def merged(part: pa.Table) -> pa.Table:
    """One piece of the second filter, as 64-bit words: bits seen again in a task, or once in several."""
    positions = lambda c: np.frombuffer(b"".join(part[c].to_pylist()), np.uint16)
    seen = np.bincount(positions("once"), minlength=PIECE) > 1
    seen[positions("again")] = True
    words = np.packbits(seen, bitorder="little").view(np.int64)
    return pa.table({"piece": part["piece"][:1], "twice": pa.array([words], pa.list_(pa.int64()))})


def twice_seen(docs: DataFrame, pieces: int, p: Params) -> DataFrame:
    """(piece, twice): the filter of keys that may have been seen twice, stored."""
    parts = lines_of(docs, p).select(hashed("key", pieces)).mapInArrow(note, "piece long, once binary, again binary")
    return cut_lineage(parts.groupBy("piece").applyInArrow(merged, "piece long, twice array<long>"))


def suspects(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, text_hash, line_no, digest) of all lines whose key may be a repeat."""
    pieces = n_pieces(docs, p)
    filters = twice_seen(docs, pieces, p)
    if pieces * PIECE // 8 <= p.broadcast_bytes:
        filters = F.broadcast(filters)
    lines = lines_of(docs, p).select("doc_id", "text_hash", "line_no", F.unhex(F.sha2(F.col("key").cast("binary"), 256)).alias("digest"), *hashed("key", pieces))
    at = [F.shiftrightunsigned("h", 16 * k).bitwiseAND(F.lit(PIECE - 1)).cast("int") for k in range(4)]
    met = lines.join(filters, "piece")
    for x in at:
        met = met.where(F.getbit(F.get("twice", F.shiftright(x, 6)), x.bitwiseAND(F.lit(63))) == 1)
    return met.select("doc_id", "text_hash", "line_no", "digest")


def repeated(found: DataFrame) -> DataFrame:
    """(digest, first, n): keys that several documents hold, and the first of these."""
    doc = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    d = found.groupBy("digest").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.count(F.lit(1)).alias("n"))
    return d.where(~F.col("lo.doc_id").eqNullSafe(F.col("hi.doc_id"))).select("digest", F.col("lo.doc_id").alias("first"), "n")


def drops(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, drop): the numbers of the lines that each document loses."""
    found = cut_lineage(found)
    keys = cut_lineage(repeated(found))
    hot = F.col("n") * HOT_SHARE > found.count()
    many, rest = F.broadcast(keys.where(hot)), keys.where(~hot)
    met = found.join(many, "digest").unionByName(found.join(many, "digest", "left_anti").join(rest, "digest"))
    return met.where(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("drop"))


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_lines, n_dropped, kept) from (doc_id, text, drop); of a line listed by several equal rows once."""
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = text or ""
            if drop:
                gone, lines = set(drop), text.split("\n")
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
            else:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = drops(suspects(docs, p)).select(F.col("doc_id").alias("of"), "text_hash", "drop")
    d = docs.withColumn("hash", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("text_hash")), "left")
    return d.select("doc_id", "text", "drop").mapInArrow(strip, "doc_id long, n_lines long, n_dropped long, kept string")


ORACLE = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents
), keyed AS (
  SELECT doc_id, no, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, shared.first IS NOT NULL AND shared.first <> doc_id AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
