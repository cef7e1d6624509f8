"""Periodic runs of words, found by recursive frequency splitting and a scan over lags.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q``
apart are identical), of at least ``max(SHORTEST, TIMES * q)`` words, that no
neighbouring word extends.  So every word of a run occurs at least ``TIMES`` times in
it.  A text begins as one segment.  Words that occur fewer times than that within their
segment can't be in a run; they split it, and the parts are looked at again with
their own counts until no segment changes (:func:`split`, for all texts of a block at
once).  What survives, usually nothing, is scanned lag by lag (:func:`scan`).

For lag ``q`` only every ``q``-th word is read: a run matches itself shifted by ``q`` on
at least ``3q`` positions, so three multiples of ``q`` in sequence match.  Reading all
lags so costs ``n log n`` words.  Where they do, the stretch is followed to both
ends.  A stretch inside a known run whose period divides ``q`` is that run again and is
passed over.

Texts are worked on in their own rows: nothing is shuffled.  Words are compared by a
dictionary of the block's words, so there are no hash collisions.  Splitting costs one
sort of what changed in each round; memory is that of a block of texts of
:data:`BLOCK_BYTES`, or of one longer text.

Defined results: a null or empty text, or one without words, has no words and no runs;
its collapsed text is empty.  Repeated rows each get their result; columns that are
carried along aren't read, whatever their names but for those added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = 4
SHORTEST = 6
BLOCK_BYTES = 4 << 20
#: white space between words: 0x20 and 0x09 to 0x0D
SPACES = " \t\n\x0b\f\r"

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def split(words: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Stable segments (begin, end) of ``words``, numbers from 0 in texts that begin at ``at``: each word occurs ``TIMES`` times in its segment."""
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    place = np.flatnonzero(size[text] >= SHORTEST)
    segment = text[place]
    kinds = int(words.max()) + 1 if len(words) else 1
    stable: list[tuple[int, int]] = []
    while len(place):
        _, kind, count = np.unique(segment * kinds + words[place], return_inverse=True, return_counts=True)
        keep = count[kind] >= TIMES
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        whole = np.logical_and.reduceat(keep, first)
        last = np.r_[first[1:], len(place)]
        stable += zip(place[first[whole]].tolist(), (place[last[whole] - 1] + 1).tolist())
        keep &= np.repeat(~whole, last - first)
        place, segment = place[keep], segment[keep]
        if not len(place):
            break
        new = np.r_[True, (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])]
        segment = np.cumsum(new) - 1
        long_enough = np.bincount(segment)[segment] >= SHORTEST
        place, segment = place[long_enough], segment[long_enough]
        if len(segment):
            segment = np.cumsum(np.r_[True, segment[1:] != segment[:-1]]) - 1
    return sorted(stable)


def follow(w: np.ndarray, q: int, t: int) -> tuple[int, int]:
    """The longest stretch (begin, end) around ``t`` in which words ``q`` apart are identical; ``w[t] == w[t + q]``."""
    lo, hi, step = t, t + 1, 64
    while lo > 0:
        a = max(0, lo - step)
        other = np.flatnonzero(w[a:lo] != w[a + q:lo + q])
        if len(other):
            lo = a + int(other[-1]) + 1
            break
        lo, step = a, 2 * step
    step = 64
    while hi < len(w) - q:
        b = min(len(w) - q, hi + step)
        other = np.flatnonzero(w[hi:b] != w[hi + q:b + q])
        if len(other):
            hi += int(other[0])
            break
        hi, step = b, 2 * step
    return lo, hi + q


def scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a segment, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    wide: list[tuple[int, int, int]] = []       # known runs of at least 4q words
    for q in range(1, len(w) // TIMES + 1):
        step = w[::q]
        same = step[1:] == step[:-1]
        near = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not len(near):
            continue
        wide = [x for x in wide if x[1] - x[0] >= TIMES * q]
        done = 0
        for t in (near * q).tolist():
            if t < done:
                continue
            known = max((hi for lo, hi, p in wide if q % p == 0 and lo <= t and t + q <= hi), default=0)
            if known:
                done = known - q + 1
                continue
            lo, hi = follow(w, q, t)
            done = hi - q
            if hi - lo >= max(SHORTEST, TIMES * q) and (lo, hi) not in found:
                found[lo, hi] = q
                wide.append((lo, hi, q))
    return sorted((lo, hi - lo, q) for (lo, hi), q in found.items())


def runs_of(texts: Sequence[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words."""
    at = np.cumsum([0, *map(len, texts)])
    flat = pa.array([w for t in texts for w in t], pa.binary())
    words = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for lo, hi in split(words, at):
        k = int(np.searchsorted(at, lo, "right")) - 1
        out[k] += [(lo - int(at[k]) + start, length, q) for start, length, q in scan(words[lo:hi])]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run repeats (all after its first period), joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            gone[start + q] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows (first, end) of a binary column in blocks of about :data:`BLOCK_BYTES`."""
    first, held = 0, 0
    for k, n in enumerate(x or 0 for x in pc.binary_length(column).to_pylist()):
        if held and held + n > BLOCK_BYTES:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(column):
        yield first, len(column)


def find(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, and n_words, runs (by start, then period) and the collapsed text."""
    part = docs.select(*keep, F.col(text).cast("string").cast("binary").alias("_text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(ADDED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for first, end in slices(column):
                texts = [(x or b"").split() for x in column.slice(first, end - first).to_pylist()]
                runs = runs_of(texts)
                added = [pa.array([len(t) for t in texts], pa.int64()), pa.array([[dict(zip(RUN.names, r)) for r in x] for x in runs], pa.list_(RUN)),
                         pa.array([collapse(t, x) for t, x in zip(texts, runs)], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns[:-1]), *added], [*keep, "n_words", "runs", "collapsed"])

    return part.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten, chosen by the checksum h of its id, the words from the a-th on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h")).withColumn("g", F.expr("h div 10"))
    chosen = F.expr("h % 10 = 0 and text is not null")
    d = d.withColumn("words", F.when(chosen, words_of(F.col("text")))).withColumn("n", F.size("words"))
    d = d.withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    edited = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    d = found.withColumn("best", longest)
    length = -F.col("best.less")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
                    F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
