"""Alignment of two tokenizers over a corpus, with an inverted index of token pairs.

:func:`align` cuts each text into the tokens of tokenizer A (byte-level BPE, a JSON
file) and of B (a sentencepiece model).  Offsets at which tokens of both end cut the
tokens into groups; a link is a pair of one A and one B token whose byte ranges
overlap.  Both cover the text without gaps, so the links are the stretches between
neighbouring ends of either.

A text is read in units: stretches that begin with white space before which there is
none.  A splits there by its pattern, and B has no piece with a space after
another character (both checked; if not, a text is one unit).  So the tokens of a
text are those of its units, and so are groups and links; units are aligned in
batches and remembered for a while.

:func:`score` finds in how many documents each id pair is linked, and returns that
to the documents:

1. A task numbers its documents and inverts their links (:func:`invert`).  For each pair it writes
   bitmaps of the documents, as sorted 16-bit numbers, or as plain bits where
   these are shorter: plane k holds those documents in which the pair's number of links has
   bit k.  Bitmaps belong to containers of :data:`CONTAINER` documents of one task.
2. The planes of a bitmap OR-ed hold the documents of the pair; their number,
   and that of the links, is added up over containers, which are disjoint.
3. The pairs' counts meet the bitmaps: by a broadcast if there are at most
   ``broadcast_pairs`` pairs (counted), else by a join on the pair.  Each posting
   gives its document the count, once for each link that its planes tell
   (:func:`hand_back`), summed by container and then by document.

The alignment is computed once and written, without the links, as a table in the
shared folder that the session names; the groups may be kept as their SHA-256.  The best count of each A id is a table of at
most as many rows as A has ids.

A's merges are made in the order of ids (checked; if not, the slower library is
used), so a faster library gives the same ids; its pattern can't take very long white
space, and such a text goes to the slower one.

Defined results: null and empty texts, and texts that the joined bytes of A's or B's
tokens don't give back, have no tokens: zeros, and empty groups.  Every row is a
document of its own, also where rows or ids repeat or are null.  Texts are
never cut.  Columns of the caller other than ``keep`` aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..session import cut_lineage, ensure_checkpoint_dir

CONTAINER = 1 << 16
#: links that a task holds before it inverts them, and links of remembered units
HELD = 1 << 21
#: texts that are cut into tokens at a time, in bytes
BLOCK_BYTES = 1 << 20
#: units that are remembered, about
KNOWN = 1 << 18
#: characters of units that are aligned at a time
CHUNK = 1 << 16
#: how a unit begins that may follow another one; the other one ends in something else than white space
JOINS = re.compile(r" +\S")
#: bytes of a bitmap of plain bits
BITS = CONTAINER // 8
#: pairs (about 40 bytes each) that every executor may hold
BROADCAST_PAIRS = 1 << 20


@dataclass(frozen=True)
class Tokenizers:
    """Files of the tokenizers, readable on every machine."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"


def byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others, in order, for characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A: ids and bytes of space + text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocabulary = byte_of(), spec["model"]["vocab"]
        special = {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.token = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for word, i in vocabulary.items():
            self.token[i] = word.encode() if i in special else bytes(alphabet[c] for c in word)
        for i, word in special.items():
            self.token[i] = word.encode()
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.fast = None
        plain = spec["pre_tokenizer"] == spec["pre_tokenizer"] | {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
        if plain and spec["normalizer"] is None and all(vocabulary[m] == 256 + k for k, m in enumerate(merges)):
            import tiktoken
            # fixed value: the pattern of byte-level pre-tokenization
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.fast = tiktoken.Encoding("a", pat_str=pattern, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(self.token) if i not in special})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text).astype(np.int64)
            except ValueError:      # its pattern engine gave up
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """B: ids and bytes of text, to which it adds a space."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token = [self.bytes_of(i) for i in range(self.model.get_piece_size())]

    def bytes_of(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass
class Side:
    token: list[bytes]
    size: np.ndarray
    words: list[list[bytes]]     # decimal ids followed by each separator

    @classmethod
    def of(cls, token: list[bytes], *separators: bytes) -> "Side":
        return cls(token, np.array([len(t) for t in token], np.int64), [b"%d%s" % (i, s) for s in separators for i in range(len(token))])


class Aligner:
    """Both tokenizers, and the alignments of units seen before: unit k has ``counts[k]`` (n_a, n_b, n_groups), ``groups[k]``
    and the links ``links[at[k]:at[k + 1]]``; a unit whose bytes aren't given back has the number -1."""

    def __init__(self, files: Tokenizers):
        self.a, self.b = ByteLevel(files.a), Pieces(files.b)
        self.side_a, self.side_b = Side.of(self.a.token, b",", b"|"), Side.of(self.b.token, b",", b";")
        self.split = self.a.fast is not None and not any(re.search("[^▁]▁", self.b.model.id_to_piece(i)) for i in range(len(self.b.token)))
        self.cut = re.compile(r"(?<=\S)(?= +\S)" if self.split else r"(?!)")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts, self.at, self.links = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and where each text's begin; none where a text is empty or a unit of it is -1."""
        if len(self.known) > KNOWN or len(self.links) > HELD:
            self.forget()
        units = [self.cut.split(" " + t) if t else [] for t in texts]
        missing = list({u for t in units for u in t}.difference(self.known))
        joins = [bool(JOINS.match(u)) and not u[-1].isspace() for u in missing]
        for u, ok in zip(missing, joins):
            if not ok:
                self.learn([u])
        missing = [u for u, ok in zip(missing, joins) if ok]
        first = 0
        while first < len(missing):
            end, size = first, 0
            while end < len(missing) and size < CHUNK:
                size += len(missing[end])
                end += 1
            self.learn(missing[first:end])
            first = end
        known = self.known
        found = [[known[u] for u in t] for t in units]
        found = [[] if -1 in t else t for t in found]
        return np.array([k for t in found for k in t], np.int64), np.cumsum([0, *map(len, found)])

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """A's and B's ids of those units, one after the other, whose bytes both give back, and which these are."""
        token_a, token_b = self.side_a.token, self.side_b.token
        back = lambda a, b, data: b"".join([token_a[i] for i in a.tolist()]) == data and b"".join([token_b[i] for i in b]) == data
        if self.split:
            whole = "".join(units)      # put together, they are units of one text
            a, b = self.a.encode(whole), self.b.encode([whole[1:]])[0]
            if back(a, b, whole.encode()):
                return a, np.array(b, np.int64), [True] * len(units)
        each = list(zip([self.a.encode(u) for u in units], self.b.encode([u[1:] for u in units])))
        right = [back(x, y, u.encode()) for u, (x, y) in zip(units, each)]
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in parts)])
        return join(x for (x, _), ok in zip(each, right) if ok), join(y for (_, y), ok in zip(each, right) if ok), right

    def learn(self, units: list[str]) -> None:
        """Align one unit, or units that may follow each other: all at once, as their ends are ends of tokens of both."""
        a, b, right = self.tokens(units)
        good = [u for u, ok in zip(units, right) if ok]
        self.known.update((u, -1) for u, ok in zip(units, right) if not ok)
        if not good:
            return
        at_a, at_b, closes_a, closes_b = aligned(a, b, self.side_a.size, self.side_b.size)
        words = written(a, b, closes_a, closes_b, self.side_a.words, self.side_b.words)
        ends = np.cumsum([len(u.encode()) for u in good])
        end_a = np.searchsorted(np.cumsum(self.side_a.size[a]), ends) + 1
        end_b = np.searchsorted(np.cumsum(self.side_b.size[b]), ends) + 1
        totals = np.stack([end_a, end_b, np.cumsum(closes_a)[end_a - 1]], 1)
        edge = np.r_[0, end_a + end_b].tolist()
        self.known.update(zip(good, range(len(self.groups), len(self.groups) + len(good))))
        self.groups += [b"".join(words[x:y]) for x, y in zip(edge, edge[1:])]
        self.counts = np.concatenate([self.counts, np.diff(totals, axis=0, prepend=0)])
        self.at = np.concatenate([self.at, len(self.links) + np.searchsorted(at_a, end_a)])     # links of a unit: those of its A tokens
        self.links = np.concatenate([self.links, (a[at_a] << 32) + b[at_b]])

    def gather(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of these units in their order, and how many each has."""
        n = self.at[units + 1] - self.at[units]
        first = np.cumsum(n) - n
        return self.links[np.repeat(self.at[units] - first, n) + np.arange(n.sum())], n


@lru_cache(maxsize=1)
def loaded(files: Tokenizers) -> Aligner:
    return Aligner(files)


def aligned(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of each link, in text order, and which token of ``a`` and of ``b`` ends a group."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    ends = np.union1d(end_a, end_b)
    closes_a = np.isin(end_a, end_b, assume_unique=True)
    closes_b = np.isin(end_b, end_a, assume_unique=True)
    return np.searchsorted(end_a, ends), np.searchsorted(end_b, ends), closes_a, closes_b


def written(a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, words_a: list[bytes], words_b: list[bytes]) -> list[bytes]:
    """The groups as parts of ``a1,a2|b1;a3|b2,b3;``: one for each token, A's of a group before B's."""
    group_a, group_b = np.r_[0, np.cumsum(closes_a)[:-1]], np.r_[0, np.cumsum(closes_b)[:-1]]
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + len(words_a) // 2 * closes_a
    code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = -1 - (b + len(words_b) // 2 * closes_b)
    return [words_a[c] if c >= 0 else words_b[-1 - c] for c in code.tolist()]


ALIGNED = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.int64()))])


def aligner(files: Tokenizers, digest: bool):
    """Batches (..., text) to batches (..., n_a, n_b, n_groups, groups, links)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = loaded(files)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            first, size = 0, np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.binary())])
            while first < len(column):
                end = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + BLOCK_BYTES, "right")))
                units, at = tool.of([x or "" for x in column.slice(first, end - first).to_pylist()])
                per_text = lambda values: np.diff(np.r_[0, np.cumsum(values)][at])
                links, n = tool.gather(units)
                parts = [tool.groups[k] for k in units.tolist()]
                groups = [b"".join(parts[x:y])[:-1] for x, y in zip(at.tolist(), at.tolist()[1:])]
                if digest:
                    groups = [hashlib.sha256(x).hexdigest().encode() if x else b"" for x in groups]
                added = [*(pa.array(per_text(tool.counts[units, k])) for k in range(3)), pa.array(groups, pa.binary()).cast(pa.string()),
                         pa.ListArray.from_arrays(np.r_[0, np.cumsum(per_text(n))].astype(np.int32), pa.array(links))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns[:-1]), *added], [*batch.schema.names[:-1], *ALIGNED.names])
                first = end
    return run


def align(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", files: Tokenizers = Tokenizers()) -> DataFrame:
    """The columns ``keep``, n_a, n_b, n_groups, the groups (as ``a1,a2|b1;a3|b2,b3``) and the links, each as ``a * 2**32 + b``, in text order."""
    schema = T.StructType([*docs.select(*keep).schema.fields, *from_arrow_schema(ALIGNED).fields])
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(aligner(files, False), schema)


def planes(link: np.ndarray, doc: np.ndarray) -> dict[str, pa.Array]:
    """Bitmaps of the documents (16-bit numbers) of each link: pair, number of documents and of links, a bitmap for each bit of multiplicity."""
    key = (link >> 32 << 20 | link & 0xFFFFFFFF) << 16 | doc     # ids of A below 2**27, of B below 2**20
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[new, len(key)])
    key = key[new]
    link, doc = key >> 36 << 32 | key >> 16 & 0xFFFFF, (key & 0xFFFF).astype(np.uint16)
    first = np.flatnonzero(np.r_[True, link[1:] != link[:-1]])
    pair = np.cumsum(np.r_[True, link[1:] != link[:-1]]) - 1
    n_planes = int(times.max()).bit_length()
    # bitmaps in the order of pairs, then planes; those without documents are left out at the end of a pair
    bits = [(times >> k) & 1 > 0 for k in range(n_planes)]
    in_pair = np.stack([np.bincount(pair[b], minlength=len(first)) for b in bits], 1)
    used = n_planes - np.argmax(in_pair[:, ::-1] > 0, 1)
    data = np.concatenate([doc[b] for b in bits])
    data = data[np.lexsort((np.concatenate([np.full(int(b.sum()), k) for k, b in enumerate(bits)]), np.concatenate([pair[b] for b in bits])))]
    size = in_pair[np.arange(n_planes) < used[:, None]]
    maps = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * np.r_[0, np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
    if (size * 2 >= BITS).any():
        at = np.r_[0, np.cumsum(size)]
        maps = pa.array([np.packbits(np.bincount(data[at[k]:at[k + 1]], minlength=CONTAINER).astype(bool), bitorder="little").tobytes() if n * 2 >= BITS else data[at[k]:at[k + 1]].tobytes() for k, n in enumerate(size.tolist())], pa.binary())
    return {"link": pa.array(link[first]), "n_docs": pa.array(np.diff(np.r_[first, len(link)])), "n_times": pa.array(np.add.reduceat(times, first)),
            "planes": pa.ListArray.from_arrays(np.r_[0, np.cumsum(used)].astype(np.int32), maps)}


def members(bitmap: bytes) -> np.ndarray:
    """The numbers in a bitmap of either form."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")) if len(bitmap) == BITS else np.frombuffer(bitmap, np.uint16).astype(np.int64)


POSTINGS = "container long, link long, n_docs long, n_times long, planes array<binary>"


def inverter(schema: T.StructType, keep: Sequence[str]):
    """Batches (``keep``, n_a, n_b, n_groups, groups, links) to rows of two kinds: documents (container, doc, n_links and
    all but the links) and postings (container, link, n_docs, n_times, planes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        base, seen = TaskContext.get().partitionId() << 32, 0
        links: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held = 0

        def batch_of(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

        def postings() -> pa.RecordBatch:
            nonlocal links, docs, held
            columns = planes(np.concatenate(links), np.concatenate(docs))
            links, docs, held = [], [], 0
            n = len(columns["link"])
            return batch_of(columns | {"container": pa.array(np.full(n, base + (seen - 1) // CONTAINER))}, n)

        for batch in batches:
            row = 0
            while row < batch.num_rows:
                n = min(batch.num_rows - row, CONTAINER - seen % CONTAINER)
                part = batch.slice(row, n)
                column = part.column(part.num_columns - 1)
                size = np.diff(column.offsets.to_numpy())
                number = np.arange(seen, seen + n) % CONTAINER
                container = base + seen // CONTAINER
                links.append(column.flatten().to_numpy())
                docs.append(np.repeat(number.astype(np.uint16), size))
                held, seen, row = held + len(links[-1]), seen + n, row + n
                yield batch_of({"container": pa.array(np.full(n, container)), "doc": pa.array(number), "n_links": pa.array(size)} | dict(zip(part.schema.names[:-1], part.columns)), n)
                if held and (held >= HELD or seen % CONTAINER == 0):
                    yield postings()
        if held:
            yield postings()

    return run


def invert(docs: DataFrame, keep: Sequence[str], text: str, files: Tokenizers, digest: bool) -> DataFrame:
    """Alignment and inverted index in one pass: the links of a document stay in the task."""
    kept = [*docs.select(*keep).schema.fields, *from_arrow_schema(ALIGNED).fields[:-1]]
    schema = T.StructType([*T._parse_datatype_string(POSTINGS).fields, T.StructField("doc", T.IntegerType()), T.StructField("n_links", T.LongType()), *kept])
    first, then = aligner(files, digest), inverter(schema, keep)
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(lambda batches: then(first(batches)), schema)


def pairs(postings: DataFrame) -> DataFrame:
    """(link, a, n_docs, n_times) of every pair that is linked anywhere."""
    return postings.groupBy("link").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_times").alias("n_times")).withColumn("a", F.shiftright("link", 32).cast("int"))


def rated(counts: DataFrame) -> DataFrame:
    """(link, worth): the number of documents times two, plus one if no other pair of the A id has more."""
    best = counts.groupBy("a").agg(F.max("n_docs").alias("best"))
    return counts.join(F.broadcast(best), "a").select("link", (F.col("n_docs") * 2 + (F.col("n_docs") == F.col("best")).cast("long")).alias("worth"))


def hand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(container, doc, count_sum, n_best), of a container perhaps in parts, from (container, worth, planes)."""
    at, sums, best = None, np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)

    def rows() -> pa.RecordBatch:
        doc = np.flatnonzero(sums)
        out = pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), at)), pa.array(doc.astype(np.int32)), pa.array(sums[doc]), pa.array(best[doc])], ["container", "doc", "count_sum", "n_best"])
        sums[:] = 0
        best[:] = 0
        return out

    for batch in batches:
        container, worth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        maps, edge = batch.column(2).flatten(), batch.column(2).offsets.to_numpy().astype(np.int64)
        offsets = np.frombuffer(maps.buffers()[1], np.int32, len(maps) + 1, 4 * maps.offset).astype(np.int64)
        data = maps.buffers()[2]
        plane = np.arange(len(maps)) - np.repeat(edge[:-1] - edge[0], np.diff(edge))
        row = np.repeat(np.arange(len(worth)), np.diff(edge))
        length = np.diff(offsets)
        if len(maps) and (length == BITS).any():
            lists = [members(x) for x in maps.to_pylist()]
            number, size = np.concatenate(lists), np.array([len(x) for x in lists])
        else:
            number = np.frombuffer(data, np.uint16, (offsets[-1] - offsets[0]) // 2, offsets[0]).astype(np.int64) if len(maps) and offsets[-1] > offsets[0] else np.zeros(0, np.int64)
            size = length // 2
        times, of = np.repeat(np.int64(1) << plane, size), np.repeat(row, size)
        for c in (np.unique(container) if len(container) and container[0] != container[-1] else container[:1]).tolist():
            if c != at:
                if at is not None:
                    yield rows()
                at = c
            here = slice(None) if len(container) == 0 or (container[0] == container[-1] == c and (container == c).all()) else container[of] == c
            w, t, d = worth[of[here]], times[here], number[here]
            np.add.at(sums, d, t * (w >> 1))
            np.add.at(best, d, t * (w & 1))
    if at is not None:
        yield rows()


def score(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", files: Tokenizers = Tokenizers(), digest: bool = False,
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The columns ``keep`` of ``docs``, n_a, n_b, n_groups, groups (with ``digest`` the SHA-256 of what isn't empty), n_links, n_best and count_sum."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    keep = [*keep, "n_a", "n_b", "n_groups", "groups"]
    table = invert(docs, keep[:-4], text, files, digest)
    table.write.parquet(folder)
    table = spark.read.schema(table.schema).parquet(folder)
    docs = table.where("doc is not null").select("container", "doc", "n_links", *keep)
    postings = table.where("link is not null")
    counts = cut_lineage(pairs(postings.select("link", "n_docs", "n_times")))
    few = counts.count() <= broadcast_pairs
    worth = rated(counts)
    met = postings.select("container", "link", "planes").join(F.broadcast(worth) if few else worth, "link").select("container", "worth", "planes")
    if not few:
        met = met.repartition("container")
    # a task that reads a few containers one after the other sends one row for each of their documents
    met = met.sortWithinPartitions("container") if not few else met
    back = met.mapInArrow(hand_back, "container long, doc int, count_sum long, n_best long").groupBy("container", "doc").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    return docs.join(back, ["container", "doc"], "left").select(*keep, "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
