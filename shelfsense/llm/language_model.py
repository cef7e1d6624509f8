"""Gated recurrent language model over words: log-probability of whole texts.

The probability of a word after a history h is
``P(class | h) * P(word | class, h)`` (a class-factored softmax).  The classes
follow the words' counts in the training texts:

* the ``top`` most frequent words are dealt to classes of ``per_class`` words,
  each with a softmax of its own over the state;
* the other words of the head table (at most ``head`` words, all seen twice or
  more) form bands, each
  twice as wide as the one before; inside a band a word has its share of counts;
* all remaining words, unseen ones too, form the last class, inside which a word
  of count c has (c + 1) / (N_rest + V_rest + 1).

So every word has a probability and all sum to 1.  The state is that of a gated
recurrent unit (GRU) in numpy; it is carried from window to window through a
whole text, however long, and begins anew with each text.  Training is truncated
back-propagation through time, with Adam, over every training text once: in each
of the two rounds (an eighth of the texts, then the others) each task goes on
from the common weights with its own texts, and the weights are averaged, by
tokens, in two grouping steps.  The first weights give the unigram model.

Counts cover all training texts.  Only the head table is sent to the tasks; its
size is bounded by ``head``.  Words outside it meet their counts in a join.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text ends with an end
token.  A null or empty text is the end token alone.  A null id is a training
text.  Every row gets a row, repeated ones too.  With no training text at all the
counts are 0 and every word is in the last class.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W

END = np.uint64(0xE4D0F7E27)
FIXED_LOGS = 1.0 / np.log(10.0)


@dataclass(frozen=True)
class Params:
    head: int = 1 << 18       # words whose counts every task holds
    top: int = 1024           # words with an output of their own
    per_class: int = 32
    hidden: int = 16
    window: int = 16          # steps of back-propagation
    lanes: int = 256          # texts trained side by side
    score_lanes: int = 1024
    rate: float = 0.005
    texts_at_once: int = 1 << 22   # words arranged into lanes together


class Head:
    """The head table: id of a word from its hash, by count; and the classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, p: Params):
        order = np.lexsort((hashes, -counts, hashes != END))      # the end token is word 0
        self.counts = counts[order].astype(np.int64)
        n = len(order)
        by_hash = np.argsort(hashes[order])
        self.sorted, self.ids = hashes[order][by_hash], by_hash.astype(np.int32)
        self.first = np.searchsorted(self.sorted, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46))
        self.deepest = int(np.diff(self.first).max(initial=0))
        self.top = min(p.top, n)
        self.word_classes = -(-self.top // p.per_class)
        word = np.arange(n)
        band = np.maximum(0, np.floor(np.log2(np.maximum(word, 1) / p.top)).astype(int))
        self.bands = int(band[self.top:].max(initial=-1)) + 1
        self.classes = self.word_classes + self.bands + 1
        #: of each head word, then of the rest: class, row of the input table, log of the share in the class (0 in word classes)
        self.cls = np.append(np.where(word < self.top, word // p.per_class, self.word_classes + band), self.classes - 1).astype(np.int32)
        self.row = np.append(np.where(word < self.top, word, self.top + band), self.top + self.bands).astype(np.int32)
        mass = np.bincount(self.cls[:n], self.counts, self.classes)
        rest, rest_words = total - int(self.counts.sum()), max(0, distinct - n)
        self.log_count = np.log10(self.counts + 1.0)
        share = np.where(word < self.top, 0.0, np.log(np.maximum(self.counts, 1) / np.maximum(mass[self.cls[:n]], 1)))
        self.share = np.append(share, -np.log(rest + rest_words + 1.0))
        mass[-1] += rest + rest_words + 1
        self.class_bias = np.log(np.maximum(mass, 0.5) / max(mass.sum(), 1)).astype(np.float32)
        self.word_bias = np.log(np.maximum(self.counts[:self.top], 0.5)).astype(np.float32)
        self.width = p.per_class

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed words; len(counts) for words outside the table."""
        out = np.full(len(h), len(self.counts), np.int32)
        at = self.first[(h >> np.uint64(46)).astype(np.int64)]
        left = np.arange(len(h))
        for _ in range(self.deepest):
            inside = at < len(self.sorted)
            left, at = left[inside], at[inside]
            key = self.sorted[at]
            hit = key == h[left]
            out[left[hit]] = self.ids[at[hit]]
            more = key < h[left]
            left, at = left[more], at[more] + 1
        return out


@dataclass
class Model:
    """Weights in one flat vector, with named views into it."""

    head: Head
    hidden: int
    flat: np.ndarray = field(default=None)

    def __post_init__(self):
        h, k = self.hidden, self.head
        shapes = {"x": (k.top + k.bands + 1, 3 * h), "u": (h, 3 * h), "c": (h, k.classes), "cb": (k.classes,), "w": (k.word_classes * k.width, h), "wb": (k.word_classes * k.width,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        fresh = self.flat is None
        if fresh:
            self.flat = np.zeros(size, np.float32)
        self.grad = np.zeros(size, np.float32)
        at = 0
        for name, s in shapes.items():
            n = int(np.prod(s))
            setattr(self, name, self.flat[at:at + n].reshape(s))
            setattr(self, "d" + name, self.grad[at:at + n].reshape(s))
            at += n
        if fresh:
            rng = np.random.default_rng(7)
            self.x[:] = rng.normal(0, 0.3, self.x.shape)
            self.x[:, :h] += 1.0       # keep the state at first
            self.u[:] = rng.normal(0, 0.5 / np.sqrt(h), self.u.shape)
            self.cb[:] = k.class_bias
            self.wb[:] = -1e4          # places of the last word class that no word has
            self.wb[:k.top] = k.word_bias

    def forward(self, rows: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (steps, lanes, hidden) after reading ``rows`` (steps, lanes); ``fresh`` marks steps that begin a text."""
        h, out = self.hidden, np.empty((*rows.shape, self.hidden), np.float32)
        x = self.x[rows]
        live = (~fresh).astype(np.float32)[:, :, None]
        for t in range(len(rows)):
            state = state * live[t]
            a = state @ self.u
            gates = np.tanh((x[t, :, :2 * h] + a[:, :2 * h]) * np.float32(0.5))
            gates += np.float32(1)
            gates *= np.float32(0.5)
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h:] + r * a[:, 2 * h:])
            if keep is not None:
                keep.append((state, z, r, new, a[:, 2 * h:], live[t]))
            state = new + z * (state - new)
            out[t] = state
        return out, state

    def output(self, states: np.ndarray, target: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of ``target`` word ids without the shares in a class; gradient of its negative for the states."""
        k = self.head
        cls, n = k.cls[target], np.arange(len(target))
        logits = states @ self.c + self.cb
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(axis=1)
        got = logits[n, cls] - np.log(total)
        back = None
        if learn:
            e /= total[:, None]
            e[n, cls] -= 1
            self.dc += states.T @ e
            self.dcb += e.sum(axis=0)
            back = e @ self.c.T
        words = np.flatnonzero(target < k.top)
        words = words[np.argsort(cls[words], kind="stable")]
        edges = np.searchsorted(cls[words], np.arange(k.word_classes + 1))
        for g in np.flatnonzero(np.diff(edges)):
            rows, part = words[edges[g]:edges[g + 1]], slice(g * k.width, (g + 1) * k.width)
            s = states[rows]
            logits = s @ self.w[part].T + self.wb[part]
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            total = e.sum(axis=1)
            place, m = target[rows] - g * k.width, np.arange(len(rows))
            got[rows] += logits[m, place] - np.log(total)
            if learn:
                e /= total[:, None]
                e[m, place] -= 1
                self.dw[part] += e.T @ s
                self.dwb[part] += e.sum(axis=0)
                back[rows] += e @ self.w[part]
        return got, back

    def backward(self, rows: np.ndarray, kept: list, back: np.ndarray) -> None:
        """Add the gradients of the recurrent part; ``back``: gradients for the states."""
        h = self.hidden
        dx = np.empty((*rows.shape, 3 * h), np.float32)
        carry = np.zeros_like(back[0])
        for t in range(len(rows) - 1, -1, -1):
            state, z, r, new, a, live = kept[t]
            d = back[t] + carry
            d_new = d * (1 - z) * (1 - new * new)
            dx[t, :, :h] = d * (state - new) * z * (1 - z)
            dx[t, :, h:2 * h] = d_new * a * r * (1 - r)
            dx[t, :, 2 * h:] = d_new
            da = dx[t].copy()
            da[:, 2 * h:] *= r
            self.du += state.T @ da
            carry = (d * z + da @ self.u.T) * live
        ids = rows.ravel()
        order = np.argsort(ids, kind="stable")
        ids, flat = ids[order], dx.reshape(-1, 3 * h)[order]
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        self.dx[ids[at]] += np.add.reduceat(flat, at, axis=0)


class Adam:
    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = np.zeros_like(model.flat), np.zeros_like(model.flat)

    def step(self, tokens: int) -> None:
        g = self.model.grad
        g /= max(tokens, 1)
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        self.v += np.float32(0.01) * (g * g - self.v)
        rate = self.rate * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        self.model.flat -= np.float32(rate) * self.m / (np.sqrt(self.v) + np.float32(1e-8))
        g[:] = 0


def arrange(length: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal texts to lanes of about equal length: the texts in lane order, and where each lane begins in them.

    The longest lane comes first, so the lanes still running are always the first ones.
    """
    heap = [(0, k) for k in range(min(lanes, len(length)))]
    held: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-length, kind="stable").tolist():
        size, k = heap[0]
        held[k].append(i)
        heapq.heapreplace(heap, (size + int(length[i]), k))
    held.sort(key=lambda x: -int(length[x].sum()))
    return np.concatenate([np.asarray(x, np.int64) for x in held]), np.cumsum([0] + [len(x) for x in held])


def windows(target: np.ndarray, at: np.ndarray, lanes: int, steps: int):
    """Windows over all lanes: places of the targets in ``target`` (steps, lanes), which of them are real, which begin a text, and whether lanes ended.

    ``target``: word ids of the texts, one after the other; text i is target[at[i]:at[i + 1]].
    """
    length = np.diff(at)
    order, lane_at = arrange(length, lanes)
    place = np.concatenate([np.arange(at[i], at[i + 1]) for i in order]) if len(order) else np.zeros(0, np.int64)
    fresh = np.zeros(len(place), bool)
    fresh[np.concatenate([[0], np.cumsum(length[order])[:-1]])] = True
    begin = np.concatenate([[0], np.cumsum(length[order])])[lane_at]
    size = np.diff(begin)
    for t in range(0, int(size.max(initial=0)), steps):
        n = int(np.searchsorted(-size, -t, "left"))     # lanes longer than t
        step = t + np.arange(min(steps, int(size[0]) - t))[:, None]
        real = step < size[None, :n]
        where = np.where(real, begin[None, :n] + step, 0)
        yield n, place[where], real, fresh[where] & real


def word_ids(block: W.Block, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of a block with an end token after each text; where each text begins; the words outside the head table with their text."""
    found = head.lookup(block.words)
    ends = block.at[1:]
    ids = np.insert(found, ends, 0)
    at = block.at + np.arange(len(block.at))
    return ids, at, np.flatnonzero(found == len(head.counts))


def inputs(model: Model, target: np.ndarray, place: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Rows of the input table: the word before, the end token at the beginning of a text."""
    return model.head.row[np.where(fresh, 0, target[np.maximum(place - 1, 0)])]


def learn(model: Model, adam: Adam, target: np.ndarray, at: np.ndarray, p: Params) -> None:
    state = None
    for n, place, real, fresh in windows(target, at, p.lanes, p.window):
        state = np.zeros((n, model.hidden), np.float32) if state is None else state[:n]
        rows, kept = inputs(model, target, place, fresh), []
        states, state = model.forward(rows, fresh, state, kept)
        flat = np.flatnonzero(real)
        _, d = model.output(states.reshape(-1, model.hidden)[flat], target[place.ravel()[flat]], learn=True)
        back = np.zeros((rows.size, model.hidden), np.float32)
        back[flat] = d
        model.backward(rows, kept, back.reshape(states.shape))
        adam.step(len(flat))


def log_probabilities(model: Model, target: np.ndarray, at: np.ndarray, p: Params) -> np.ndarray:
    """Natural log-probability of every token, but for the counts of words outside the head table."""
    out, state = np.zeros(len(target)), None
    for n, place, real, fresh in windows(target, at, p.score_lanes, p.window):
        state = np.zeros((n, model.hidden), np.float32) if state is None else state[:n]
        states, state = model.forward(inputs(model, target, place, fresh), fresh, state)
        flat = np.flatnonzero(real)
        here = place.ravel()[flat]
        out[here] = model.output(states.reshape(-1, model.hidden)[flat], target[here])[0]
    return out + model.head.share[target]


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int):
    """Blocks of texts together, up to about ``size`` words at once: (batch, blocks)."""
    for batch in batches:
        held, n = [], 0
        for block in W.blocks(batch.column(column)):
            held.append(replace(block, start=None, end=None, data=None, text_at=None, total=None))
            n += len(block.words)
            if n >= size:
                yield batch, held
                held, n = [], 0
        if held:
            yield batch, held


def joined(blocks: list[W.Block], head: Head) -> tuple[np.ndarray, np.ndarray, list[tuple[W.Block, np.ndarray]]]:
    parts = [word_ids(b, head) for b in blocks]
    size = np.cumsum([0] + [len(ids) for ids, _, _ in parts])
    at = np.concatenate([[0]] + [a[1:] + s for (_, a, _), s in zip(parts, size)])
    return np.concatenate([ids for ids, _, _ in parts]), at, [(b, rest) for b, (_, _, rest) in zip(blocks, parts)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all words and end tokens of ``texts`` (text); word: the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [b.words for b in W.blocks(batch.column(0))] + [np.full(batch.num_rows, END)]
            word, n = np.unique(np.concatenate(every), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.int64(word)), pa.array(n)], names=["word", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_table(counts: DataFrame, p: Params) -> tuple[Head, int, int]:
    """The head table, all tokens and all distinct words.  At most ``p.head`` words come to the driver: those above a count that a histogram gives."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024.0) * 64)).cast("long")
    bins = sorted(((r["bin"], r["words"], r["low"], r["n"]) for r in counts.groupBy(step.alias("bin")).agg(
        F.count(F.lit(1)).alias("words"), F.min("n").alias("low"), F.sum("n").alias("n")).collect()), reverse=True)
    room, least = p.head - 1, None
    for _, n, low, _ in bins:
        room -= n
        if room < 0 or low < 2:     # words seen once stay in the last class: they tell how likely unseen words are
            break
        least = low
    end = int(END.astype(np.int64))
    chosen = counts.where((F.col("word") == end) | (F.col("n") >= least if least is not None else F.lit(False))).toPandas()
    if not (chosen["word"] == end).any():
        chosen = pd.concat([chosen, pd.DataFrame({"word": [end], "n": [0]})])
    total, distinct = sum(b[3] for b in bins), sum(b[1] for b in bins)
    return Head(chosen["word"].to_numpy(np.int64).view(np.uint64), chosen["n"].to_numpy(np.int64), total, distinct, p), total, distinct


def average(weights: DataFrame, size: int) -> np.ndarray | None:
    """Mean of the tasks' weights (part, task, tokens, values), by tokens; parts are averaged apart, and tasks in two steps."""

    def run(key, table):
        total, tokens = 0.0, 0
        for values, n in zip(table.column("values").to_pylist(), table.column("tokens").to_pylist()):
            total, tokens = total + np.frombuffer(values, np.float64) * n, tokens + n
        return pa.table({"part": [key[0].as_py()], "task": [0], "tokens": [tokens], "values": [(total / tokens).tobytes()]},
                        schema=pa.schema([("part", pa.int32()), ("task", pa.int32()), ("tokens", pa.int64()), ("values", pa.binary())]))

    schema = "part int, task int, tokens long, values binary"
    first = weights.groupBy("part", "task").applyInArrow(run, schema)
    rows = first.groupBy("part").applyInArrow(run, schema).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["values"], np.float64) for r in sorted(rows, key=lambda r: r["part"])])[:size].astype(np.float32)


def train(texts: DataFrame, head: Head, p: Params) -> Model:
    """A model that has read every row of ``texts`` (text) once."""
    sc = texts.sparkSession.sparkContext
    model, parts, group = Model(head, p.hidden), 16, 32
    share = F.pmod(F.xxhash64("text"), F.lit(8))
    for here in (share == 0, share != 0):
        sent = sc.broadcast((head, model.flat))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, flat = sent.value
            own, tokens, first = Model(table, p.hidden, flat.copy()), 0, None
            adam = Adam(own, p.rate)
            for batch, blocks in gathered(batches, 0, p.texts_at_once):
                first = batch.column(1)[0].as_py() if first is None else first
                target, at, _ = joined(blocks, table)
                learn(own, adam, target, at, p)
                tokens += len(target)
            if tokens:
                for k, values in enumerate(np.array_split(own.flat.astype(np.float64), parts)):
                    yield pa.RecordBatch.from_pydict({"part": [k], "task": [first % group], "tokens": [tokens], "values": [values.tobytes()]},
                                                     schema=pa.schema([("part", pa.int32()), ("task", pa.int32()), ("tokens", pa.int64()), ("values", pa.binary())]))

        rows = texts.where(here).select(F.col("text").cast("string"), F.spark_partition_id().alias("task"))
        mean = average(rows.mapInArrow(run, "part int, task int, tokens long, values binary"), len(model.flat))
        if mean is not None:
            model = Model(head, p.hidden, mean)
    return model


def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text); the columns are listed in the last lines."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    learnt = docs.where("not held_out").select("text")
    counts = cut_lineage(count_words(learnt))
    head, total, distinct = head_table(counts, p)
    sent = sc.broadcast((head, train(learnt, head, p).flat))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, flat = sent.value
        model = Model(table, p.hidden, flat)
        known = np.append((table.counts > 0).astype(np.int64), 0)
        log_count = np.append(table.log_count, 0.0)
        for batch, blocks in gathered(batches, 3, p.texts_at_once):
            target, at, rests = joined(blocks, table)
            got = log_probabilities(model, target, at, p) * FIXED_LOGS
            rest = [np.searchsorted(r, b.at) for b, r in rests]
            rest_at = np.concatenate([[0]] + [x[1:] + s for x, s in zip(rest, np.cumsum([0] + [len(r) for _, r in rests]))])
            rest_words = np.concatenate([b.words[r] for b, r in rests])
            first, n = blocks[0].first, len(at) - 1
            row, doc, held = (batch.column(i).slice(first, n) for i in range(3))
            yield pa.RecordBatch.from_arrays([
                row, doc, held, pa.array(np.diff(at)), pa.array(np.add.reduceat(known[target], at[:-1])), pa.array(np.add.reduceat(log_count[target], at[:-1])),
                pa.array(np.add.reduceat(got, at[:-1])), pa.LargeListArray.from_arrays(pa.array(rest_at), pa.array(W.int64(rest_words))).cast(pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, model double, rest array<long>")
    rows = cut_lineage(rows)
    rest = (rows.select("row", F.explode("rest").alias("word")).join(counts, "word", "left").groupBy("row")
                .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("log_count"), F.count("n").alias("n_rest")))
    each = float(np.log10(total + distinct + 1.0))
    return rows.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_count", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("model") + F.coalesce("log_count", F.lit(0.0))).alias("score"))
