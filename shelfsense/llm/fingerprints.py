"""SimHash fingerprints of 128 bits, with DataFrame functions only.

The terms of a text are its pairs of neighbouring words (lower-cased, split at
ASCII white space; the last word also stands alone, so a one-word text has a
term).  Each occurrence of a term votes with a weight of 1 to 3, more for
longer and so rarer words, on every bit of a 128-bit hash of the term; a bit of
the fingerprint is set when over half of the weight votes for it.

The votes are added up without a shuffle of the terms: two 32-bit counters share
one 64-bit sum, 64 sums give all bits, and a text's terms are summed in the task
that holds the text.  A text can't overflow a counter, since 3 * 2**30 terms
exceed the size of a string.

:func:`near_groups` finds all fingerprints within ``radius`` bits: the bits are
cut into blocks, and one table is made for each choice of blocks that a pair
within the radius may agree on in full (:func:`block_keys`); candidates share an
entry of a table and are checked by their distance.

Defined results: null text counts as empty; a text without words has the
fingerprint 0 and is near nothing; equal texts have equal fingerprints; every
input row gets a row, repeated ones too; a null doc_id sorts after all others.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_index
from ..session import cut_lineage
from .groups import linked

BITS = 128
_PAIR = 0x0000000100000001
#: stands for a null doc_id in join keys
NO_ID = -(1 << 63)
_SPACE = " \t\n\u000b\f\r"


def terms(text: Column) -> Column:
    """Array of (word, next word or null); empty if the text has no words."""
    trimmed = F.btrim(F.lower(text), F.lit(_SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return F.when(trimmed != "", F.arrays_zip(words.alias("w"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("v")))


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hi, lo: the fingerprint of ``text`` for each value of ``keys``; none for texts without words."""
    t = texts.select(*keys, F.explode(terms(F.col("text"))).alias("t")).select(*keys, F.col("t").getField("w").alias("w"), F.col("t").getField("v").alias("v"))
    t = t.select(*keys, F.xxhash64("w", "v").alias("h0"), F.xxhash64(F.lit(1), "w", "v").alias("h1"),
                 F.least(F.lit(3), F.lit(1) + F.floor(F.length("w") / 5)).cast("long").alias("weight"))
    sums = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_PAIR)) * F.col("weight")).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(32)]
    votes = t.groupBy(*keys).agg(F.sum("weight").alias("weight"), *sums)

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}_{i}", 32)
            for votes_for, at in ((low, i), (high, i + 32)):
                out = out.bitwiseOR(F.when(votes_for * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
        return out

    return votes.select(*keys, bits("h0").alias("hi"), bits("h1").alias("lo"))


def as_text(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi0: str, lo0: str, hi1: str, lo1: str) -> Column:
    return F.bit_count(F.col(hi0).bitwiseXOR(F.col(hi1))) + F.bit_count(F.col(lo0).bitwiseXOR(F.col(lo1)))


def likeness(bits_apart: Column) -> Column:
    """0 to 1: the cosine of the term vectors that so many different bits stand for, 0 from half of the bits on."""
    return F.when(bits_apart == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(bits_apart * F.lit(3.141592653589793 / BITS))))


def block_keys(hi: str, lo: str, radius: int, blocks: int) -> Column:
    """Array of (key, skipped), one for each table; two fingerprints within ``radius`` share a key at least.

    The bits are cut into ``blocks`` of about equal width.  ``radius`` different
    bits touch as many blocks at most, so a pair agrees on all others; a table
    holds one choice of ``blocks`` - ``radius`` blocks.  ``skipped`` has a bit for
    each block that the table leaves out before its last one (:func:`first_table`).
    """
    free = blocks - radius
    assert free >= 1

    def skipped(some: tuple[int, ...]) -> int:
        return sum(1 << i for i in range(some[-1]) if i not in some)

    return F.array(*[F.struct(F.xxhash64(F.lit(n), *[x for i in some for x in block_bits(hi, lo, i, blocks)]).alias("key"), F.lit(skipped(some)).alias("skipped"))
                     for n, some in enumerate(combinations(range(blocks), free))])


def block_bits(hi: str, lo: str, block: int, blocks: int) -> list[Column]:
    """The bits of a block; those of two words are two columns."""
    s, e = round(block * BITS / blocks), round((block + 1) * BITS / blocks)
    out = []
    for word, first in ((hi, 0), (lo, 64)):
        low, high = max(s, first) - first, min(e, first + 64) - first
        if low < high:
            out.append(F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1)))
    return out


def first_table(blocks: int):
    """Condition that holds under the first of the tables in which a pair meets: the blocks it skips differ."""
    def condition(a: str, b: str) -> Column:
        out = F.lit(True)
        for i in range(blocks - 1):
            same = [x == y for x, y in zip(block_bits(a + "hi", a + "lo", i, blocks), block_bits(b + "hi", b + "lo", i, blocks))]
            out = out & ((F.col(a + "skipped").bitwiseAND(F.lit(1 << i)) == 0) | ~reduce(and_, same))
        return out
    return condition


def near_groups(prints: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """(hi, lo, root): fingerprints (hi, lo, distinct) that steps of at most ``radius`` bits connect share a root."""
    nodes = cut_lineage(prints.select(F.xxhash64("hi", "lo").alias("node"), "hi", "lo"))
    buckets = nodes.select("node", F.inline(block_keys("hi", "lo", radius, blocks)))
    root = linked(buckets, nodes, lambda a, b: distance(a + "hi", a + "lo", b + "hi", b + "lo") <= radius, once=first_table(blocks))
    return nodes.join(root, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root"))


def edited_fingerprints(docs: DataFrame, radius: int = 6) -> DataFrame:
    """Fingerprints of all texts of ``docs`` (doc_id, text) and of an edit of each.

    The edit of a text of n code points replaces its last floor(n / 3) by the
    first as many (or all) of the next document's, in descending doc_id, the
    first following the last.  Rows with equal doc_id count as one document if
    their texts are equal, and follow each other by a hash of the text if not.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    small = cut_lineage(docs.select("id", "digest", F.length("text").alias("n")))
    order = cut_lineage(global_index(small.distinct(), [F.col("id").desc(), F.col("digest")], "at"))
    after = order.select(F.when(F.col("at") > 0, F.col("at") - 1).alias("at"), F.col("id").alias("next_id"), F.col("digest").alias("next_digest"))
    first = after.where("at is null").select("next_id", "next_digest").withColumn("at", F.lit(order.count() - 1).cast("long"))
    after = after.where("at is not null").unionByName(first)
    pairs = cut_lineage(order.join(after, "at").select("id", "digest", "n", "next_id", "next_digest", F.floor(F.col("n") / 3).alias("cut")))

    head = (docs.join(pairs.select(F.col("next_id").alias("id"), F.col("next_digest").alias("digest"), "cut", F.col("id").alias("of_id"), F.col("digest").alias("of_digest")), ["id", "digest"])
                .select(F.col("of_id").alias("id"), F.col("of_digest").alias("digest"), F.col("cut"), F.left("text", F.col("cut")).alias("head"))
                .groupBy("id", "digest").agg(F.any_value("cut").alias("cut"), F.any_value("head").alias("head")))
    edited = F.concat(F.left("text", F.length("text") - F.col("cut")), F.col("head"))
    both = docs.join(head, ["id", "digest"]).select("id", "digest", "text", edited.alias("edited"))
    both = both.select("id", "digest", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x"))
    both = both.select("id", "digest", "edited_sha256", "x.which", "x.text")
    # the empty text has no terms, so its row is made apart
    wordless = both.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", "digest", "edited_sha256", "which", F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo")).distinct()
    prints = fingerprints(both, ["id", "digest", "edited_sha256", "which"]).unionByName(wordless)
    prints = cut_lineage(prints)

    own = prints.where("which = 0").select("id", "digest", "edited_sha256", "hi", "lo")
    made = prints.where("which = 1").select("id", "digest", F.col("hi").alias("hi_e"), F.col("lo").alias("lo_e"))
    following = own.select(F.col("id").alias("next_id"), F.col("digest").alias("next_digest"), F.col("hi").alias("hi_n"), F.col("lo").alias("lo_n"))
    group = near_groups(own.where("hi != 0 or lo != 0").select("hi", "lo").distinct(), radius)
    smallest = own.join(group, ["hi", "lo"]).where(F.col("id") != NO_ID).groupBy("root").agg(F.min("id").alias("near_group"))
    group = cut_lineage(group.join(smallest, "root").select("hi", "lo", "near_group"))
    result = (pairs.join(own, ["id", "digest"]).join(made, ["id", "digest"]).join(following, ["next_id", "next_digest"])
                   .join(group, ["hi", "lo"], "left")
                   .select("id", "digest", "edited_sha256", as_text("hi", "lo").alias("fingerprint"), as_text("hi_e", "lo_e").alias("edited_fingerprint"),
                           likeness(distance("hi", "lo", "hi_e", "lo_e")).alias("near_edited"), likeness(distance("hi", "lo", "hi_n", "lo_n")).alias("near_next"),
                           F.coalesce("near_group", F.nullif("id", F.lit(NO_ID))).alias("near_group")))
    return small.join(result, ["id", "digest"]).select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_group")
