"""Quality and toxicity of documents by co-training two views.

The text view sees the text: shares of bytes, repetition, and words.  The
metadata view sees the other columns: language, source and length.  Each is a
logistic regression.  Over some rounds each view labels the unlabelled documents
of a pool, and those it is surest of become training rows of the *other* view.
At last both are calibrated on labelled rows kept out of the training, a
logistic combination weighs them, and all documents are scored.

Two targets are learnt so: ``quality`` (0 is junk) and ``toxic``.  A document is
rejected if it is more likely junk than not, or more likely toxic than not.

Fitting uses a bounded sample: about ``labelled`` labelled rows and ``pool``
unlabelled ones, drawn by a hash of the id.  The words with a weight are chosen from
counts made in tasks; the driver gets those words only.  Scoring reads every whole text.

Defined results: null text counts as empty, null metadata as a value of its own,
a null id is unlabelled; labels that are null are ignored; a document labelled
twice keeps one label (the smaller quality, the larger toxicity).  Without labels
of both kinds for a target, its probability is the share of the labels (quality
1, toxic 0 if there are none).  Empty documents are rejected as junk only if the
model says so.  Every row gets a row.
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

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
STYLE = 128 + 8
META = 256
TARGETS = ("bad", "toxic")


@dataclass(frozen=True)
class Params:
    labelled: int = 10_000    # rows a fit may use, about
    pool: int = 6_000         # unlabelled documents that the views label for each other, about
    rounds: int = 3
    grow: float = 0.1         # share of the pool that each view hands over in a round
    words: int = 400          # words with a weight in the text view
    steps: int = 400
    limit: float = 0.5        # rejected from this probability on


def text_features(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, style (texts x STYLE), word buckets, where each text's begin) for blocks of texts.

    The buckets are those of the words and of their first bytes, distinct in a
    text; with ``wanted`` only the buckets marked there.
    """
    for b in W.blocks(column, separators=W.NOT_ALNUM):
        n, size = len(b), np.diff(b.text_at)
        text = np.repeat(np.arange(n), size)
        seen = np.bincount(text * 128 + np.minimum(b.data, 127), minlength=n * 128).reshape(n, 128)
        style = np.zeros((n, STYLE), np.float32)
        style[:, :128] = np.log1p(1000 * seen / np.maximum(size, 1)[:, None])
        count = np.diff(b.at)
        each = np.maximum(count, 1)
        distinct, at = W.distinct_sorted(b.words, b.at)
        pairs, pairs_at = W.ngrams(b, 2)
        pairs_distinct = np.diff(W.distinct_sorted(pairs, pairs_at)[1])
        again = np.zeros(len(b.words) + 1, np.int64)
        again[1:-1] = b.words[1:] == b.words[:-1]
        first = b.at[:-1][count > 0]
        again[first] = 0
        again = np.concatenate([[0], np.cumsum(again)])
        style[:, 128] = np.log1p(count)
        style[:, 129] = np.diff(at) / each
        style[:, 130] = pairs_distinct / np.maximum(np.diff(pairs_at), 1)
        style[:, 131] = (again[b.at[1:]] - again[b.at[:-1]]) / each
        style[:, 132] = size / each / 10
        style[:, 133] = (np.diff(pairs_at) - pairs_distinct) / each > 0.25
        style[:, 134] = style[:, 131] > 0.1
        style[:, 135] = count < 5
        bucket = np.stack([b.words, *(W.prefixes(b, k) for k in PREFIXES)], axis=1) >> np.uint64(46)
        bucket, owner = bucket.astype(np.int64).ravel(), np.repeat(np.arange(n), count * (1 + len(PREFIXES)))
        if wanted is not None:
            here = wanted[bucket]
            bucket, owner = bucket[here], owner[here]
        both = np.unique(owner * BUCKETS + bucket)
        yield b.first, style, both % BUCKETS, np.searchsorted(both // BUCKETS, np.arange(n + 1))


def meta_features(batch: pa.RecordBatch) -> np.ndarray:
    """Places (texts x 4) of the metadata in META indicator columns: language, source, both, and size of the length."""
    def hashed(column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode(null_encoding="encode")
        return np.array([hash_of(v) for v in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]

    lang, source = hashed(batch.column("lang")), hashed(batch.column("source"))
    n = batch.column("n_chars").fill_null(-1).to_numpy(zero_copy_only=False)
    log = np.where(n < 0, 31, np.minimum(np.log2(np.maximum(n, 0) + 1.0) * 1.5, 30)).astype(np.int64)
    return np.stack([(lang % np.uint64(32)).astype(np.int64), 32 + (source % np.uint64(96)).astype(np.int64),
                     128 + (W.mix(lang + source * W.ODD[0]) % np.uint64(96)).astype(np.int64), 224 + log], axis=1)


def hash_of(value: str | None) -> int:
    h = 1469598103934665603
    for c in ("\0" if value is None else value).encode():
        h = (h ^ c) * 1099511628211 & (1 << 64) - 1
    return h


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, l2: float = 1e-3) -> np.ndarray:
    """Weights and bias (last) of a logistic regression, by Adam on all rows at once."""
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    total = max(float(weight.sum()), 1e-9)
    for t in range(1, steps + 1):
        r = (sigmoid(x @ w[:-1] + w[-1]) - y) * weight / total
        g = np.append(x.T @ r + l2 * w[:-1], r.sum()).astype(np.float32)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def balance(y: np.ndarray) -> np.ndarray:
    """Row weights; the rarer label counts up to four times."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    return np.where(y > 0.5, min(4.0, max(1.0, 0.5 / share)), min(4.0, max(1.0, 0.5 / (1 - share)))).astype(np.float32)


class Sample:
    """The collected sample: matrices of both views."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.style = flat("style").astype(np.float32).reshape(n, STYLE)
        self.meta = np.zeros((n, META), np.float32)
        self.meta[np.arange(n)[:, None], flat("meta").reshape(n, 4)] = 1
        self.bucket = flat("words").astype(np.int64)
        self.row = np.repeat(np.arange(n), table.column("words").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        label = lambda c: table.column(c).cast(pa.float32()).to_numpy()  # noqa: E731  nan for null
        self.bad, self.toxic = 1 - label("quality"), label("toxic")
        self.turn = table.column("turn").to_numpy()


def training_rows(seen: dict[str, int], target: str) -> bool:
    """Whether a fifth of the labelled rows can be left out of training for the calibration: both parts hold both labels."""
    return all(seen[f"{target}_{y}_{part}"] for y in (0, 1) for part in ("train", "rest"))


def choose_words(counts: DataFrame, target: str, seen: dict[str, int], most: int) -> np.ndarray:
    """Buckets that tell the labels apart best, by the likelihood ratio of their counts; at most ``most``."""
    parts = ("train",) if training_rows(seen, target) else ("train", "rest")
    n = [sum(seen[f"{target}_{y}_{part}"] for part in parts) for y in (0, 1)]
    if not all(n):
        return np.zeros(0, np.int64)
    share = n[1] / sum(n)
    pos, neg = F.col(f"{target}_1").cast("double"), F.col(f"{target}_0").cast("double")
    part = lambda k, of: F.when(k > 0, k * F.log(k / (of * (pos + neg)))).otherwise(0.0)
    ratio = 2 * (part(pos, share) + part(neg, 1 - share))
    best = counts.where(pos + neg >= 5).select("bucket", ratio.alias("ratio")).where("ratio > 25").orderBy(F.desc("ratio"), "bucket").limit(most)
    return np.array([r["bucket"] for r in best.collect()], np.int64)


class Target:
    """A fitted target: weights of both views and their combination."""

    def __init__(self, s: Sample, y: np.ndarray, words: np.ndarray, p: Params):
        known = np.flatnonzero(~np.isnan(y))
        self.constant = None
        if len(np.unique(y[known])) < 2:
            self.constant = float(y[known].mean()) if len(known) else 0.0
            return
        keep_out = s.turn[known] % 5 == 0
        train, calibrate = known[~keep_out], known[keep_out]
        if len(np.unique(y[train])) < 2 or len(np.unique(y[calibrate])) < 2:
            train = calibrate = known
        pool = np.flatnonzero(np.isnan(y))
        self.words = words
        self.mean, self.scale = s.style[train].mean(axis=0), s.style[train].std(axis=0) + 0.05
        column = np.full(BUCKETS, -1)
        column[self.words] = np.arange(len(self.words))
        text = np.zeros((len(y), STYLE + len(self.words)), np.float32)
        text[:, :STYLE] = np.clip((s.style - self.mean) / self.scale, -6, 6)
        hit = column[s.bucket]
        text[s.row[hit >= 0], STYLE + hit[hit >= 0]] = 1
        views = [text, s.meta]
        rows, labels = [train, train], [y[train], y[train]]
        weight = balance(y[train])
        weights = [weight, weight]
        left = pool
        for k in range(p.rounds + 1):
            fitted = [fit(x[r], t, w, p.steps) for x, r, t, w in zip(views, rows, labels, weights)]
            if k == p.rounds or not len(left):
                break
            some = max(1, int(p.grow * len(left)))
            taken = []
            for mine, other in ((0, 1), (1, 0)):
                prob = sigmoid(views[mine][left] @ fitted[mine][:-1] + fitted[mine][-1])
                sure = np.argsort(-np.abs(prob - 0.5), kind="stable")[:some]
                sure = sure[np.abs(prob[sure] - 0.5) > 0.4]      # both ends, and only if confident
                rows[other] = np.concatenate([rows[other], left[sure]])
                labels[other] = np.concatenate([labels[other], (prob[sure] > 0.5).astype(np.float32)])
                weights[other] = np.concatenate([weights[other], np.full(len(sure), 0.5, np.float32)])
                taken.append(sure)
            left = np.delete(left, np.unique(np.concatenate(taken)))
        self.text, self.meta = fitted
        both = np.stack([x[calibrate] @ w[:-1] + w[-1] for x, w in zip(views, fitted)], axis=1)
        self.both = fit(both.astype(np.float32), y[calibrate], np.ones(len(calibrate), np.float32), 2 * p.steps, l2=1e-4)
        table = np.zeros(BUCKETS, np.float32)
        table[self.words] = self.text[STYLE:-1]
        self.table = table

    def probability(self, style: np.ndarray, buckets: np.ndarray, at: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(style), self.constant)
        text = np.clip((style - self.mean) / self.scale, -6, 6) @ self.text[:STYLE] + self.text[-1]
        text += W.per_text(np.add, self.table[buckets], at, 0)
        other = self.meta[:-1][meta].sum(axis=1) + self.meta[-1]
        return sigmoid(self.both[0] * text + self.both[1] * other + self.both[2])


def fit_targets(docs: DataFrame, labels: DataFrame, p: Params) -> dict[str, Target]:
    """Fit on the sample; ``docs`` (doc_id, text, lang, source, n_chars), ``labels`` (doc_id, quality, toxic)."""
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    n_labels, n_docs = labels.count(), docs.count()
    turn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    some = lambda n, of: int(min(1.0, n / max(of, 1)) * (1 << 30))
    drawn = labels.where(turn < some(p.labelled, n_labels))
    with_label = docs.join(F.broadcast(drawn), "doc_id")     # about p.labelled rows
    turn = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30))
    rest = docs.where(turn < some(p.pool, n_docs)).join(labels.select("doc_id"), "doc_id", "left_anti")
    rows = with_label.unionByName(rest, allowMissingColumns=True).withColumn("turn", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1000)))

    rows = cut_lineage(rows.select("text", "lang", "source", "n_chars", "quality", "toxic", "turn", (1 - F.col("quality")).alias("bad")))
    left_out = F.col("turn") % 5 == 0
    seen = rows.agg(*[F.count_if((F.col(target) == y) & (left_out if part == "rest" else ~left_out)).alias(f"{target}_{y}_{part}")
                      for target in TARGETS for y in (0, 1) for part in ("train", "rest")]).first().asDict()
    every = {target: not training_rows(seen, target) for target in TARGETS}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many training texts of each label each word bucket is."""
        total = np.zeros((len(TARGETS), 2, BUCKETS), np.int32)
        for batch in batches:
            trains = batch.column("turn").to_numpy() % 5 != 0
            for first, style, buckets, at in text_features(batch.column("text")):
                text = np.repeat(np.arange(first, first + len(style)), np.diff(at))
                for k, target in enumerate(TARGETS):
                    label = batch.column(target).fill_null(-1).to_numpy()
                    for y in (0, 1):
                        total[k, y] += np.bincount(buckets[((label == y) & (trains | every[target]))[text]], minlength=BUCKETS).astype(np.int32)
        found = np.flatnonzero(total.any(axis=(0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(total[k, y, found].astype(np.int64)) for k in range(len(TARGETS)) for y in (0, 1))], ["bucket", *names])

    names = [f"{target}_{y}" for target in TARGETS for y in (0, 1)]
    counts = rows.select("text", "turn", *TARGETS).mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in names))
    counts = cut_lineage(counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]))
    words = {target: choose_words(counts, target, seen, p.words) for target in TARGETS}
    wanted = np.zeros(BUCKETS, bool)
    wanted[np.concatenate(list(words.values()))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = meta_features(batch)
            for first, style, buckets, at in text_features(batch.column("text"), wanted):
                n = len(style)
                lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, n) for c in ("quality", "toxic", "turn")] + [
                    lists(style, STYLE), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(buckets.astype(np.int32))), lists(meta[first:first + n].astype(np.int32), 4)],
                    names=["quality", "toxic", "turn", "style", "words", "meta"])

    table = rows.select("text", "lang", "source", "n_chars", "quality", "toxic", "turn").mapInArrow(
        run, "quality int, toxic int, turn long, style array<float>, words array<int>, meta array<int>").toArrow()
    sample = Sample(table)
    return {"bad": Target(sample, sample.bad, words["bad"], p), "toxic": Target(sample, sample.toxic, words["toxic"], p)}


def wanted_buckets(targets: dict[str, Target]) -> np.ndarray:
    out = np.zeros(BUCKETS, bool)
    for t in targets.values():
        if t.constant is None:
            out |= t.table != 0
    return out


def tidy(docs: DataFrame) -> DataFrame:
    """The columns the views read; those that are missing are null."""
    have = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in have.items()])


def score(docs: DataFrame, labels: DataFrame, p: Params = Params(), fitted_on: DataFrame | None = None) -> DataFrame:
    """doc_id, score (probability of good and not toxic), junk, toxic (probabilities), keep for every row of ``docs``."""
    targets = fit_targets(tidy(docs if fitted_on is None else fitted_on), labels, p)
    sent = docs.sparkSession.sparkContext.broadcast(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = wanted_buckets(sent.value)
        for batch in batches:
            meta = meta_features(batch)
            for first, style, buckets, at in text_features(batch.column("text"), wanted):
                n = len(style)
                junk, toxic = (sent.value[k].probability(style, buckets, at, meta[first:first + n]).astype(np.float64) for k in ("bad", "toxic"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array((1 - junk) * (1 - toxic)), pa.array(junk), pa.array(toxic),
                                                  pa.array((junk < p.limit) & (toxic < p.limit))], names=["doc_id", "score", "junk", "toxic", "keep"])

    return tidy(docs).mapInArrow(run, "doc_id long, score double, junk double, toxic double, keep boolean")


def filter_documents(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged, without a shuffle of the texts."""
    targets = fit_targets(tidy(docs), labels, p)
    sent = docs.sparkSession.sparkContext.broadcast(targets)
    @F.pandas_udf("boolean")
    def keep(text, lang, source, n_chars):
        import pandas as pd
        batch = pa.RecordBatch.from_arrays([pa.array(x, t, from_pandas=True) for x, t in ((text, pa.string()), (lang, pa.string()), (source, pa.string()), (n_chars, pa.int64()))], names=["text", "lang", "source", "n_chars"])
        meta, out = meta_features(batch), np.ones(batch.num_rows, bool)
        for first, style, buckets, at in text_features(batch.column("text"), wanted_buckets(sent.value)):
            rows = slice(first, first + len(style))
            for target in sent.value.values():
                out[rows] &= target.probability(style, buckets, at, meta[rows]) < p.limit
        return pd.Series(out)

    have = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.where(keep(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t) for c, t in have.items()]))
