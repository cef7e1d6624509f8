"""TF-IDF, cosine similarity, recommendations and ranking metrics.

Vectors are long tables ``(doc_id, term, weight)``; nothing is a dense
matrix and nothing is collected.

Similarity search (J03) is *exact*.  Vectors are packed into blocks of some
thousand items (:func:`vector_blocks`), stored once, and each pair of blocks is one
row of a Cartesian product, worked on inside a task as one sparse matrix product
(:func:`block_product`): terms that many items of both blocks have go through a dense
product, the others through the list of their meetings.  So items never meet as
rows: what leaves a task is the pairs above the threshold or, with ``top_n``, the
best of each item among all the blocks that the task saw.  Blocks are read, not
shuffled.  The work grows with the square of the items, as the matrix does; memory
is bounded by a block, and disk by the vectors.  No cap on the vocabulary, on
partners or on candidates is applied.

Given pairs (:func:`dot_products`) are scored against the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import md5_mod
from ..session import stored

#: items of a block of vectors; a pair of blocks is one matrix product of a task, held beside the pair's copies on their way to Python
BLOCK = 1024
#: terms of all items of a block, on average
BLOCK_TERMS = 1 << 20
#: a term met by at least this share of a pair of blocks goes through the dense product
DENSE = 1 / 800
#: meetings of terms, or cells of a dense side, that are held at once
HELD = 1 << 19
#: steps of the hash that draws sample rows
DRAWS = 1_000_000
TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"


def tokens(text: Column, stopwords: Sequence[str] | None = L.STOPWORDS) -> Column:
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), 1)
    if stopwords:
        toks = F.filter(toks, lambda t: ~t.isin(*stopwords))
    return toks


def ngrams(toks: Column, n_max: int = 2) -> Column:
    # zip_with over two shifted slices: the lambda only sees its own arguments, so the
    # token expression is evaluated once per row even if the optimizer inlines it
    out = toks
    if n_max >= 2:
        m = F.greatest(F.size(toks) - 1, F.lit(0))
        bi = F.zip_with(F.slice(toks, 1, m), F.slice(toks, 2, m), lambda a, b: F.concat_ws(" ", a, b))
        out = F.concat(toks, bi)
    return out


# ------------------------------------------------------------------ J01
def tfidf(df: DataFrame, id_col: str, text: str, ngram_max: int = 2, min_df: int = 2,
          max_df: float | None = None, max_features: int | None = None, sublinear: bool = True,
          stopwords: Sequence[str] | None = L.STOPWORDS) -> tuple[DataFrame, DataFrame]:
    """sklearn-compatible TF-IDF as long tables.

    Returns ``(weights, vocab)``: weights = (doc_id, term, tf, df, weight) L2-normalised
    per document; vocab = (term, df, idf).
    idf = ln((1 + n) / (1 + df)) + 1; tf = 1 + ln(count) when sublinear.
    The vocabulary is all terms of at least ``min_df`` documents or, if asked for, the
    ``max_features`` most frequent of them (ties by term).  Term counts are stored once, in
    columns and by document, so that ids and terms are compressed.
    """
    tf = stored(term_counts(df, id_col, text, ngram_max, stopwords))   # two readers
    n_docs = df.agg(F.count(F.lit(1)).alias("_n"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("freq"))
    stats = stats.crossJoin(F.broadcast(n_docs)).where(F.col("df") >= min_df)
    if max_df is not None:
        stats = stats.where(F.col("df") <= F.col("_n") * max_df)
    if max_features is not None:
        stats = stats.orderBy(F.desc("freq"), F.col("term")).limit(max_features)
    vocab = stats.select("term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return weighted(tf, vocab, sublinear), vocab


def term_counts(df: DataFrame, id_col: str, text: str, ngram_max: int, stopwords: Sequence[str] | None) -> DataFrame:
    """(doc_id, term, tf).  Tokens are materialised first: a lambda referencing the token
    expression would re-run the tokenizer once per element.  Texts are shuffled, not their terms, which are many
    times as long: rows of one document then meet where their terms are made."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")).repartition("doc_id")
    docs = (docs.select("doc_id", tokens(F.col("_text"), stopwords).alias("_tok"))
                .select("doc_id", ngrams(F.col("_tok"), ngram_max).alias("_t")))
    return (docs.select("doc_id", F.explode_outer("_t").alias("term")).where(F.col("term").isNotNull())
                .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))


def weighted(tf: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """Term counts as unit vectors (doc_id, term, tf, df, weight) over ``vocab``."""
    tfw = F.log(F.col("tf")) + 1 if sublinear else F.col("tf").cast("double")
    w = tf.join(vocab.select("term", "df", "idf"), "term").withColumn("_raw", tfw * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", "tf", "df", (F.col("_raw") / norm).alias("weight"))


# ------------------------------------------------------------------ J02
def weighted_corpus(df: DataFrame, brand: str = "brand", category: str = "category", name: str = "product_name",
                    ingredients: str | None = "ingredients", skin: str | None = None,
                    brand_times: int = 5, category_times: int = 3, ingredients_chars: int | None = None,
                    skin_chars: int | None = None, out: str = "corpus") -> DataFrame:
    """brand x5 + category x3 + name + ingredients + skin, lower-cased.
    Character limits on the free-text parts are optional parameters (whole texts by default)."""
    def rep(c, n):
        return F.array_join(F.array_repeat(F.coalesce(F.col(c).cast("string"), F.lit("")), n), " ")

    def cut(c, n):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.substring(v, 1, n) if n else v
    parts = [rep(brand, brand_times), rep(category, category_times), F.coalesce(F.col(name), F.lit(""))]
    if ingredients:
        parts.append(cut(ingredients, ingredients_chars))
    if skin:
        parts.append(cut(skin, skin_chars))
    nonempty = F.filter(F.array(*parts), lambda s: s != "")
    return df.withColumn(out, F.lower(F.array_join(nonempty, " ")))


# ------------------------------------------------------------------ J03
def term_seed(weights: DataFrame) -> int:
    """A seed under which no two terms have one 64-bit hash, so that hashes stand for terms exactly."""
    terms, seed = weights.select("term").distinct(), 0
    while terms.groupBy(F.xxhash64("term", F.lit(seed))).count().where("count > 1").limit(1).count():
        seed += 1
    return seed


def block_count(weights: DataFrame) -> int:
    n = weights.agg(F.approx_count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("terms")).first()
    return max(1, -(-n["docs"] // BLOCK), -(-n["terms"] // BLOCK_TERMS))


def block_of(doc: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int")


def vector_blocks(weights: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(block, ids, terms, ends, rows, w): the vectors of a hashed share of the items as one sparse matrix, stored once.

    ``terms`` are the hashes of the block's terms in order, ``ends`` where the entries of each end, ``rows`` and ``w``
    the places in ``ids`` and the weights of the entries.  ``labels`` (doc_id and other columns, one row per
    item) are kept as lists beside ``ids``.  ``weights`` are read several times, so let them be :func:`stored`."""
    blocks = block_count(weights)
    w = weights.where(F.col("doc_id").isNotNull() & F.col("term").isNotNull())
    w = w.select("doc_id", F.xxhash64("term", F.lit(term_seed(weights))).alias("t"), "weight", block_of(F.col("doc_id"), blocks).alias("block"))
    more = [] if labels is None else [c for c in labels.columns if c != "doc_id"]
    labels = weights.select("doc_id").limit(0) if labels is None else labels
    labels = labels.where("doc_id is not null").select(F.col("doc_id").alias("item"), *more, block_of(F.col("doc_id"), blocks).alias("of"))
    types = {f.name: f.dataType.simpleString() for f in [*labels.schema, *w.schema]}
    # arrays as Spark declares them below: of elements that may be null
    labels = labels.select("item", *[F.col(c).cast(types[c]) for c in more], "of")
    names = ["block", "ids", *more, "terms", "ends", "rows", "w"]
    schema = ", ".join(["block int", f"ids array<{types['doc_id']}>", *[f"`{c}` array<{types[c]}>" for c in more], *[f"{c} binary" for c in names[-4:]]])

    def nested(v: pa.Array) -> pa.Array:
        if pa.types.is_list(v.type):
            v = v.cast(pa.list_(pa.field("element", v.type.value_type)))
        return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

    def pack(key: tuple, table: pa.Table, labelled: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: [] for c in names})
        docs = pc.dictionary_encode(table.column("doc_id").combine_chunks())
        row, t = docs.indices.to_numpy().astype(np.int64), table.column("t").to_numpy()
        by = np.lexsort((row, t))
        row, t, x = row[by], t[by], table.column("weight").to_numpy()[by]
        own = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (t[1:] != t[:-1])])   # a term twice in an item counts as one
        row, t, x = row[own], t[own], np.add.reduceat(x, own)
        at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        label = pc.index_in(docs.dictionary, labelled.column("item").combine_chunks())
        lists = [docs.dictionary, *[labelled.column(c).combine_chunks().take(label) for c in more]]
        parts = [t[at], np.r_[at[1:], len(t)].astype(np.int32), row.astype(np.int32), x]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *[nested(v) for v in lists],
                                     *[pa.array([v.tobytes()], pa.binary()) for v in parts]], names=names)

    # a block to a file: readers take a file's rows many at a time
    return stored(w.groupBy("block").cogroup(labels.groupBy("of")).applyInArrow(pack, schema), maxRecordsPerFile=1)


class Block:
    """A row of :func:`vector_blocks` inside a task; ``prefix`` is that of its columns.

    It holds its batch, so nothing in it may refer back to it: a cycle would keep every batch of a task until
    Python happens to look for cycles."""

    def __init__(self, batch: pa.RecordBatch, r: int, prefix: str):
        self.batch, self.r, self.prefix = batch, r, prefix
        read = lambda c, kind: np.frombuffer(self.column(c).as_buffer(), kind)
        self.number, self.ids = self.label("block"), self.column("ids").values
        self.terms, self.ends, self.rows, self.w = read("terms", np.int64), read("ends", np.int32), read("rows", np.int32), read("w", np.float64)
        self.starts = np.r_[0, self.ends[:-1]]

    def column(self, c: str) -> pa.Scalar:
        return self.batch.column(self.prefix + c)[self.r]

    def label(self, c: str):
        return self.column(c).as_py()

    def numbers(self, c: str) -> np.ndarray:
        return self.column(c).values.flatten().to_numpy().reshape(len(self.ids), -1)

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the given terms, and which of these terms each has."""
        n = self.ends[terms] - self.starts[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return self.starts[terms][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def block_product(x: Block, y: Block) -> np.ndarray:
    """All dot products of the vectors of two blocks."""
    at = np.minimum(np.searchsorted(y.terms, x.terms), len(y.terms) - 1)
    tx = np.flatnonzero(y.terms[at] == x.terms)
    ty = at[tx]
    nx, ny = (x.ends[tx] - x.starts[tx]).astype(np.int64), (y.ends[ty] - y.starts[ty]).astype(np.int64)
    m, n = len(x.ids), len(y.ids)
    out = np.zeros((m, n))
    dense = nx * ny >= DENSE * m * n
    step = max(1, HELD // max(m, n))
    heavy = np.flatnonzero(dense)
    for k in range(0, len(heavy), step):
        sides = []
        for b, t in ((x, tx), (y, ty)):
            e, which = b.entries(t[heavy[k:k + step]])
            side = np.zeros((len(b.ids), len(heavy[k:k + step])))
            side[b.rows[e], which] = b.w[e]
            sides.append(side)
        out += sides[0] @ sides[1].T
    tx, ty, ny, met = tx[~dense], ty[~dense], ny[~dense], np.cumsum((nx * ny)[~dense])
    flat = out.reshape(-1)
    lo = 0
    while lo < len(tx):
        hi = max(lo + 1, int(np.searchsorted(met, (met[lo - 1] if lo else 0) + HELD, side="right")))
        e, which = x.entries(tx[lo:hi])         # every entry of x meets all entries of y under its term
        times = ny[lo:hi][which]
        ex = np.repeat(np.arange(len(e)), times)
        ey = (y.starts[ty[lo:hi]][which] - (np.cumsum(times) - times))[ex] + np.arange(len(ex))
        flat += np.bincount((x.rows[e].astype(np.int64) * n)[ex] + y.rows[ey], x.w[e][ex] * y.w[ey], m * n)
        lo = hi
    return out


def best_of(rows: np.ndarray, sims: np.ndarray, ids: pa.Array, n: int) -> np.ndarray:
    """Places of the ``n`` best of each row, by similarity to nine digits and then by id."""
    by = np.lexsort((np.asarray(pc.rank(ids)), -np.round(sims, 9), rows))
    r = rows[by]
    return by[np.arange(len(r)) - np.searchsorted(r, r) < n]


def same_kind(x: Sequence[Sequence], y: Sequence[Sequence]) -> np.ndarray:
    """Which lists of ``x`` share a value with which lists of ``y``."""
    places: list[dict] = [{}, {}]
    for p, lists in zip(places, (x, y)):
        for k, values in enumerate(lists):
            for v in values or ():
                p.setdefault(v, []).append(k)
    out = np.zeros((len(x), len(y)), bool)
    for v in places[0].keys() & places[1].keys():
        out[np.ix_(places[0][v], places[1][v])] = True
    return out


def pair_products(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of vectors ``i`` of ``x`` and ``j`` of ``y``, one by one; nan where they share no term."""
    if 200 * len(i) >= len(x.ids) * len(y.ids):
        sim = block_product(x, y)[i, j]
        return np.where(sim > 0, sim, np.nan)
    n, at = len(y.ids), np.minimum(np.searchsorted(y.terms, x.terms), len(y.terms) - 1)
    term = np.repeat(np.where(y.terms[at] == x.terms, at, -1), x.ends - x.starts)      # of each entry of x, its place in y
    by = np.argsort(x.rows, kind="stable")
    by = by[term[by] >= 0]
    ends = np.cumsum(np.bincount(x.rows[by], minlength=len(x.ids)))
    size = np.diff(ends, prepend=0)
    term, w = term[by], x.w[by]
    there = np.repeat(np.arange(len(y.terms)), y.ends - y.starts) * n + y.rows
    total, met = np.zeros(len(i)), np.zeros(len(i), np.int64)
    lookups = np.cumsum(size[i])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(lookups, (lookups[lo - 1] if lo else 0) + HELD, side="right")))
        k = size[i[lo:hi]]
        pair = np.repeat(np.arange(hi - lo), k)
        e = ((ends - size)[i[lo:hi]] - (np.cumsum(k) - k))[pair] + np.arange(len(pair))
        key = term[e] * n + j[lo:hi][pair]
        found = np.minimum(np.searchsorted(there, key), len(there) - 1)
        hit = there[found] == key
        total[lo:hi] = np.bincount(pair[hit], w[e[hit]] * y.w[found[hit]], hi - lo)
        met[lo:hi] = np.bincount(pair[hit], minlength=hi - lo)
        lo = hi
    return np.where(met > 0, total, np.nan)


def crossed(blocks: DataFrame, left: DataFrame, half: bool = False) -> DataFrame:
    """Each block of ``left`` (columns x_) with each block (columns y_), read from files and not shuffled; by ``half`` one
    of two different blocks is x, evenly dealt."""
    y = blocks.select(*[F.col(c).alias(f"y_{c}") for c in blocks.columns])
    x = left.select(*[F.col(c).alias(f"x_{c}") for c in left.columns]).hint("shuffle_replicate_nl")
    i, j = F.col("x_block"), F.col("y_block")
    # the blocks stream past those of the right side, of which a task holds a partition
    return y.coalesce(3).join(x, (i == j) | ((i < j) == ((i + j) % 2 == 0)) if half else None)


def in_reach(sim: np.ndarray, threshold: float, top_n: int, so_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) that may be among the ``top_n`` best of their rows; ``so_far``: the worst of a row's best, if it has ``top_n``."""
    least = np.maximum(threshold, so_far - 1e-8)
    row, col = np.nonzero(sim >= least[:, None])
    if len(row) > 16 * top_n * len(sim) and sim.shape[1] > top_n:
        place = sim.shape[1] - top_n
        least = np.maximum(least, np.partition(sim, place, axis=1)[:, place] - 1e-8)
        row, col = np.nonzero(sim >= least[:, None])
    return row, col


def block_pairs(blocks: DataFrame, threshold: float, top_n: int | None) -> DataFrame:
    """Ordered (a, b, sim), a != b, with a cosine of at least ``threshold``; with ``top_n`` the best of each item (see
    :func:`similar_pairs`).  Labels of the blocks choose partners: ``own`` and ``probes`` those that share a bucket
    (:func:`share_bucket`), ``may``, ``kinds`` and ``open_kinds`` those of :func:`similar_pairs`."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    by_bucket, by_kind = "own" in blocks.columns, "may" in blocks.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}     # of each block and each choice among its partners: ids, rows, similarities and partners so far

        def improve(x: Block, y: Block, sim: np.ndarray) -> None:
            choices = [None]
            if by_kind:
                open_kinds = y.label("open_kinds")
                sim = np.where(np.array([bool(v) for v in y.label("may")]), sim, -1.0)
                choices += [same_kind(x.label("kinds"), open_kinds), np.array([bool(v) for v in open_kinds])]
            for c, among in enumerate(choices):
                s = sim if among is None else np.where(among, sim, -1.0)
                if (x.number, c) not in best:       # ids of its own: a slice would keep the whole batch
                    best[x.number, c] = x.ids.take(pa.array(np.arange(len(s)))), np.empty(0, np.int64), np.empty(0), x.ids.slice(0, 0), np.full(len(s), threshold)
                of, rows, sims, ids, so_far = best[x.number, c]
                row, col = in_reach(s, threshold, top_n, so_far)
                rows, sims, ids = np.r_[rows, row], np.r_[sims, s[row, col]], pa.concat_arrays([ids, y.ids.take(pa.array(col))])
                keep = best_of(rows, sims, ids, top_n)
                rows, sims, ids = rows[keep], sims[keep], ids.take(pa.array(keep))
                low = np.full(len(s), np.inf)
                np.minimum.at(low, rows, sims)
                best[x.number, c] = of, rows, sims, ids, np.where(np.bincount(rows, minlength=len(s)) >= top_n, low, threshold)

        for batch in batches:
            for r in range(batch.num_rows):
                x, y = Block(batch, r, "x_"), Block(batch, r, "y_")
                if by_bucket:
                    near = share_bucket(x, y) | share_bucket(y, x).T
                    row, col = np.nonzero(near)
                    sim = np.full(near.shape, -1.0)
                    sim[row, col] = np.nan_to_num(pair_products(x, y, row, col), nan=-1.0)
                else:
                    sim = block_product(x, y)
                if x.number == y.number:
                    np.fill_diagonal(sim, -1.0)
                if top_n is not None:
                    improve(x, y, sim)
                    if x.number != y.number:
                        improve(y, x, sim.T)
                    continue
                for k in range(0, len(sim), 256):
                    row, col = np.nonzero(sim[k:k + 256] >= threshold)
                    a, b, found = x.ids.take(pa.array(row + k)), y.ids.take(pa.array(col)), pa.array(sim[row + k, col])
                    yield pa.RecordBatch.from_arrays([a, b, found], ["a", "b", "sim"])
                    if x.number != y.number:
                        yield pa.RecordBatch.from_arrays([b, a, found], ["a", "b", "sim"])
        for of, rows, sims, ids, _ in best.values():
            yield pa.RecordBatch.from_arrays([of.take(pa.array(rows)), ids, pa.array(sims)], ["a", "b", "sim"])

    found = crossed(blocks, blocks, half=True).mapInArrow(score, f"a {kind}, b {kind}, sim double")
    return found.dropDuplicates(["a", "b"]) if by_kind else found


def similar_pairs(weights: DataFrame, threshold: float = 0.20, top_n: int | None = None, labels: DataFrame | None = None,
                  blocks: DataFrame | None = None) -> DataFrame:
    """All ordered (a, b, sim), a != b, with cosine >= threshold, exactly; with ``top_n`` at least those of the ``top_n``
    best of each item (ties by id).

    ``labels`` (doc_id, may boolean, kinds and open_kinds, arrays) need ``top_n``: only items that ``may`` are ``b``, and the
    ``top_n`` best are given of all these, of those with one of a's ``kinds`` among their ``open_kinds``, and of those
    with any.  ``blocks``: those of ``weights``, if they are made already."""
    return block_pairs(vector_blocks(weights, labels) if blocks is None else blocks, threshold, top_n)


def dot_products(pairs: DataFrame, weights: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Exact cosine (a, b, sim) of given (a, b) pairs of unit vectors that share a term.

    The pairs of a block of ``a`` become one list beside it, of which each block of ``b`` scores its part."""
    blocks = vector_blocks(weights) if blocks is None else blocks
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    asked = (pairs.select("a", "b").join(blocks.select("block", F.explode("ids").alias("a")), "a")
                  .groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("asked")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = Block(batch, r, "x_"), Block(batch, r, "y_")
                a, b = batch.column("x_asked")[r].values.flatten()
                j = pc.index_in(b, y.ids)
                here = pc.indices_nonzero(j.is_valid())
                a, b = a.take(here), b.take(here)
                sim = pair_products(x, y, pc.index_in(a, x.ids).to_numpy().astype(np.int64), j.take(here).to_numpy().astype(np.int64))
                met = pa.array(~np.isnan(sim))
                yield pa.RecordBatch.from_arrays([a.filter(met), b.filter(met), pa.array(sim[~np.isnan(sim)])], ["a", "b", "sim"])

    return crossed(blocks, blocks.join(asked, "block")).mapInArrow(score, f"a {kind}, b {kind}, sim double")


def both_ways(pairs: DataFrame, *cols: str) -> DataFrame:
    return pairs.select("a", "b", *cols).union(pairs.select("b", "a", *cols))


def similar_products(weights: DataFrame, attrs: DataFrame | None = None, id_col: str = "product_id",
                     category: str = "category", threshold: float = 0.20, top_n: int = 5,
                     boost: float = 1.2, blocks: DataFrame | None = None) -> DataFrame:
    """Top-n neighbours per product by raw cosine >= threshold (self excluded); the shown
    score is x boost (capped at 1) for the same category, ranking stays on the raw score."""
    top = top_neighbours(similar_pairs(weights, threshold, top_n, blocks=blocks), top_n)
    if attrs is not None:
        ca = attrs.select(F.col(id_col).alias("product_id"), F.col(category).alias("_ca"))
        cb = attrs.select(F.col(id_col).alias("similar_id"), F.col(category).alias("_cb"))
        top = (top.join(ca, "product_id", "left").join(cb, "similar_id", "left")
                  .withColumn("score", F.when(F.col("_ca") == F.col("_cb"), F.least(F.lit(1.0), F.col("sim") * boost))
                              .otherwise(F.col("sim"))).drop("_ca", "_cb"))
    else:
        top = top.withColumn("score", F.col("sim"))
    return top.select("product_id", "similar_id", "rank", "sim", "score")


def top_neighbours(pairs: DataFrame, top_n: int) -> DataFrame:
    """(product_id, similar_id, rank, sim): the ``top_n`` best of each item's ordered pairs, ties by id."""
    w = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), F.col("b"))
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return top.select(F.col("a").alias("product_id"), F.col("b").alias("similar_id"), "rank", "sim")


# ------------------------------------------------------------------ J04
def hyperplane_codes(weights: DataFrame, tables: int, bits: int, probes: int, seed: int) -> DataFrame:
    """(doc_id, own, probes): the codes of each vector in all tables, and in each those that it might have had.

    A bit is the side of a random hyperplane, whose component along a term is +1 or -1 by a hash of the term.  The
    probes of a table are the own code and others with the least certain bits flipped: those of the smallest projections,
    one at a time, then the two smallest together.  Projections are summed where the terms are read and merged by item."""
    need = tables * bits
    terms = weights.select("doc_id", "weight", *[F.xxhash64("term", F.lit(seed + j)).alias(f"h{j}") for j in range(-(-need // 64))])
    kind = terms.schema["doc_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                docs = pc.dictionary_encode(part.column("doc_id"), null_encoding="encode")
                row = docs.indices.to_numpy()
                by = np.argsort(row, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(row[by]) > 0])
                hashes = np.stack([part.column(f"h{j}").to_numpy()[by] for j in range(part.num_columns - 2)], 1)
                signs = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1), axis=1, count=need).astype(np.float32) * 2 - 1
                side = np.add.reduceat(signs * part.column("weight").to_numpy()[by].astype(np.float32)[:, None], at, axis=0)
                yield pa.RecordBatch.from_arrays([docs.dictionary, pa.FixedSizeListArray.from_arrays(pa.array(side.ravel()), need).cast(pa.list_(pa.float32()))], ["doc_id", "side"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            at = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())][:-1]
            side = parts.flatten().flatten().to_numpy().reshape(-1, need)
            side = np.add.reduceat(side, at, axis=0).reshape(-1, tables, bits)
            code = ((side > 0) * (1 << np.arange(bits))).sum(2)
            unsure = np.argsort(np.abs(side), axis=2, kind="stable")
            flips = [np.zeros_like(code)] + [1 << unsure[:, :, j] for j in range(min(probes, bits))]
            if probes and bits > 1:
                flips.append((1 << unsure[:, :, 0]) | (1 << unsure[:, :, 1]))
            codes = np.stack([code ^ f for f in flips], 2)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(c.ravel().astype(np.int32)), c[0].size).cast(pa.list_(pa.int32())) for c in (code, codes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "own", "probes"])

    vectors = terms.mapInArrow(project, f"doc_id {kind}, side array<float>").groupBy("doc_id").agg(F.collect_list("side").alias("parts"))
    return vectors.mapInArrow(encode, f"doc_id {kind}, own array<int>, probes array<int>")


def share_bucket(x: Block, y: Block) -> np.ndarray:
    """Which items of ``x`` look into a bucket that holds which of ``y``, in any table."""
    own = y.numbers("own")
    tables = own.shape[1]
    probes = x.numbers("probes").reshape(len(x.ids), tables, -1)
    out = np.zeros((len(probes), len(own)), bool)
    for t in range(tables):
        codes, at = np.unique(own[:, t], return_inverse=True)
        place = np.minimum(np.searchsorted(codes, probes[:, t]), len(codes) - 1)
        row, probe = np.nonzero(codes[place] == probes[:, t])
        bucket, size = place[row, probe], np.bincount(at)
        if 8 * size[bucket].sum() < out.size:
            by, n = np.argsort(at, kind="stable"), size[bucket]
            item = (np.cumsum(size) - size)[bucket] - (np.cumsum(n) - n)
            out[np.repeat(row, n), by[np.repeat(item, n) + np.arange(n.sum())]] = True
        else:       # few buckets hold most items: which are looked into, and then which items lie there
            looks = np.zeros((len(out), len(codes)), bool)
            looks[row, bucket] = True
            out |= looks[:, at]
    return out


def lsh_pairs(weights: DataFrame, threshold: float = 0.20, tables: int = 24, bits: int = 12, probes: int = 6, seed: int = 42,
              top_n: int | None = None) -> DataFrame:
    """Ordered pairs (a, b, sim) with cosine >= ``threshold`` that share a bucket in one of ``tables`` hyperplane tables;
    with ``top_n`` at least the best of each item.

    A vector lies in the bucket of its own code and looks into those of its probes.  Two vectors at angle x agree on
    a bit with probability 1 - x / pi, so near ones are found almost surely and those near a low threshold
    less so; ``bits`` grows with log2 of the number of items to keep buckets small, ``tables`` and ``probes`` buy recall.
    Buckets meet inside pairs of blocks, so candidates are never rows; they are scored exactly, none is cut."""
    return block_pairs(vector_blocks(weights, hyperplane_codes(weights, tables, bits, probes, seed)), threshold, top_n)


# ------------------------------------------------------------------ J05
def query_vectors(queries: DataFrame, q_id: str, text: str, vocab: DataFrame, ngram_max: int = 2,
                  sublinear: bool = True, stopwords: Sequence[str] | None = L.STOPWORDS) -> DataFrame:
    """Transform query texts into the catalogue's TF-IDF space (catalogue idf)."""
    return weighted(term_counts(queries, q_id, text, ngram_max, stopwords), vocab, sublinear)


def similar_to_text(qvec: DataFrame, catalogue: DataFrame, top_n: int = 5, pool_factor: int = 15,
                    min_sim: float = 0.0) -> DataFrame:
    """Catalogue items ranked by cosine to each query vector; pool of top_n x pool_factor.

    Work is the sum over query terms of the catalogue posting lists; queries
    are a separate, usually small, input (a request batch)."""
    q = qvec.select(F.col("doc_id").alias("query_id"), "term", F.col("weight").alias("wq"))
    c = catalogue.select(F.col("doc_id").alias("item_id"), "term", F.col("weight").alias("wc"))
    sims = q.join(c, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("wq") * F.col("wc")).alias("sim"))
    sims = sims.where(F.col("sim") > min_sim)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), F.col("item_id"))
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n * pool_factor)


# ------------------------------------------------------------------ J06
def safe_alternatives(pool: DataFrame, attrs: DataFrame, id_col: str = "item_id", safe: str = "is_safe",
                      category: str = "category", query_category: str = "query_category",
                      top_n: int = 5) -> DataFrame:
    """Safe items of the pool; same category as the query if any such exists, else any
    safe item; re-ranked by similarity.  ``mode`` tells which branch applied."""
    j = pool.join(attrs.select(F.col(id_col).alias("item_id"), safe, category), "item_id").where(F.col(safe))
    same = (F.col(category) == F.col(query_category)).cast("int")
    j = j.withColumn("_same", same).withColumn("_any_same", F.max("_same").over(Window.partitionBy("query_id")))
    j = j.where((F.col("_any_same") == 0) | (F.col("_same") == 1))
    j = j.withColumn("mode", F.when(F.col("_any_same") == 1, "same_category").otherwise("any_category"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), F.col("item_id"))
    return j.withColumn("alt_rank", F.row_number().over(w)).where(F.col("alt_rank") <= top_n).drop("_same", "_any_same")


# ------------------------------------------------------------------ J07
#: fixed values: ranks of the risk levels
RISK_RANK = (("high", 3), ("medium", 2), ("low", 1), ("none", 0))


def recommendation_candidates(similar: DataFrame, items: DataFrame, keys: Sequence[str], id_col: str, category: str,
                              similar_n: int, pool_n: int) -> DataFrame:
    """(keys, query_id, cand_id, c): candidates of each item, some of them more than once; ``c`` holds a candidate's columns.

    Similar items, then the first ``pool_n`` of the item's category by priority; with fewer than 5 of these
    (an item in both counts twice) the first ``pool_n`` of the tenant; with fewer than 3 of all these the first ones
    whatever their risk.  Only the last stage takes high-risk items, which are never recommended.  How many
    each stage gives is known from counts per category and tenant, so a stage is only joined for items that open it.
    Leaders are ranked once per category and tenant; an item joins ``pool_n`` + 1 of them, itself perhaps included."""
    k = list(keys)
    c = items.select(*k, F.col(id_col).alias("cand_id"), F.struct(*[x for x in items.columns if x not in (*k, id_col)]).alias("c"))
    safe = F.coalesce(F.col("c.risk_level") != "high", F.lit(True))
    t = items.select(*k, F.col(id_col).alias("query_id"), F.col(category).alias("_cat"),
                     F.coalesce(F.col("risk_level") != "high", F.lit(True)).cast("int").alias("_safe"))
    sim = (similar.where(F.col("rank") <= similar_n).select(F.col("product_id").alias("query_id"), F.col("similar_id").alias("cand_id"))
                  .join(t.select(*k, "query_id"), "query_id").join(c.where(safe), [*k, "cand_id"]))

    def leaders(of: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*k, *by).orderBy(F.col("c.priority_score").desc_nulls_last(), "cand_id")
        return of.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= pool_n + 1)

    def joined(who: DataFrame, lead: DataFrame, on) -> DataFrame:
        """The leaders but the item itself; the last one only where the item is among them."""
        mine = Window.partitionBy(*[who[x] for x in k], "query_id")
        j = who.join(lead.select(*[F.col(x).alias(f"_{x}") for x in k], *[x for x in lead.columns if x not in k]), on)
        j = j.withColumn("_among", F.max((F.col("cand_id") == F.col("query_id")).cast("int")).over(mine))
        return j.where((F.col("cand_id") != F.col("query_id")) & (F.col("_place") <= pool_n + F.col("_among"))).select(*k, "query_id", "cand_id", "c")

    same = lambda who: [who[x] == F.col(f"_{x}") for x in k]
    by_cat = c.where(safe).withColumn("_lead_cat", F.col(f"c.{category}"))
    cat = joined(t, leaders(by_cat, ["_lead_cat"]), [*same(t), F.col("_cat").eqNullSafe(F.col("_lead_cat"))])
    n_cat = by_cat.groupBy(*[F.col(x).alias(f"_{x}") for x in k], "_lead_cat").agg(F.count(F.lit(1)).alias("_n_cat"))
    n_safe = c.where(safe).groupBy(*k).agg(F.count(F.lit(1)).alias("_n_safe"))
    n_sim = sim.groupBy(*k, "query_id").agg(F.count(F.lit(1)).alias("_n_sim"))
    n = (t.join(n_cat, [*same(t), F.col("_cat").eqNullSafe(F.col("_lead_cat"))], "left").drop("_lead_cat", *[f"_{x}" for x in k])
          .join(n_sim, [*k, "query_id"], "left").join(n_safe, k, "left").fillna(0, ["_n_cat", "_n_sim", "_n_safe"]))
    pool = lambda x: F.least(F.lit(pool_n), F.greatest(F.col(x) - F.col("_safe"), F.lit(0)))
    n = n.withColumn("_have", F.col("_n_sim") + pool("_n_cat")).where("_have < 5").withColumn("_have", F.col("_have") + pool("_n_safe"))
    wide = n.select(*k, "query_id", "_have")
    any_safe = joined(wide, leaders(c.where(safe), []), same(wide))
    last = wide.where("_have < 3")
    return (sim.select(*k, "query_id", "cand_id", "c").unionByName(cat).unionByName(any_safe)
               .unionByName(joined(last, leaders(c, []), same(last))))


def recommendations(similar: DataFrame, items: DataFrame, keys: Sequence[str] = ("dealer_id",), id_col: str = "product_id",
                    category: str = "category", skin: str = "skin_type", top_n: int = 5, similar_n: int = 20, pool_n: int = 30) -> DataFrame:
    """The ``top_n`` best candidates of each item by a score relative to the item, never of high risk.

    ``items``: keys, id, category, skin, priority_score, risk_level, forecast_trend, avg_rating, stock_status and
    avg_monthly (mean units of its sales).  Equal scores are ranked by id.  Candidates that several stages
    give have one score, so they share a dense rank and are made one after the cut."""
    k = list(keys)
    cand = recommendation_candidates(similar, items, k, id_col, category, similar_n, pool_n).where(
        F.coalesce(F.col("c.risk_level") != "high", F.lit(True)))
    t = items.select(*k, F.col(id_col).alias("query_id"), F.struct(*[x for x in items.columns if x not in (*k, id_col)]).alias("t"))
    j = cand.join(t, [*k, "query_id"])
    rank = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in RISK_RANK for v in kv]), F.col(f"{x}.risk_level")), F.lit(0))
    ours, theirs = F.coalesce("t.avg_monthly", F.lit(0.0)), F.coalesce("c.avg_monthly", F.lit(0.0))
    rating, own_rating = F.coalesce("c.avg_rating", F.lit(0.0)), F.coalesce("t.avg_rating", F.lit(0.0))
    rising = F.coalesce(F.col("c.forecast_trend") == "increasing", F.lit(False))
    none = (F.coalesce("c.risk_level", F.lit("none")) == "none") & (F.coalesce("t.risk_level", F.lit("none")) == "none")
    faster = (ours > 0) & (theirs > ours * 1.2)
    slightly = ~faster & (theirs > 0) & (theirs > ours)
    safer = rank("c") < rank("t")
    better = (rating > 0) & (own_rating > 0) & (rating > own_rating + 0.2)
    stocked = F.coalesce(F.col("c.stock_status") == "normal", F.lit(False))
    skins = (F.length(f"t.{skin}") > 0) & (F.length(f"c.{skin}") > 0) & F.exists(
        F.split(F.col(f"t.{skin}"), ","), lambda s: F.contains(F.col(f"c.{skin}"), F.trim(s)))
    skins = F.coalesce(skins, F.lit(False))
    confident = (theirs > ours * 1.1) & rising & (rating >= own_rating)
    alike = F.coalesce((F.col(f"c.{category}") == F.col(f"t.{category}")) & (F.length(f"c.{category}") > 0), F.lit(False))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (F.lit(5) + F.when(faster, 40).when(slightly, 20).otherwise(0) + points(rising, 25)
             + F.when(safer, 45).when(none, 5).otherwise(0) + F.when(better, 25).when(rating >= 4.0, 10).otherwise(0)
             + points(stocked, 10) + points(skins, 10) + points(confident, 50) + points(alike, 5))
    j = j.withColumn("rec_score", score)
    w = Window.partitionBy(*k, "query_id").orderBy(F.desc("rec_score"), "cand_id")
    j = j.withColumn("rec_rank", F.dense_rank().over(w)).where(F.col("rec_rank") <= top_n).dropDuplicates([*k, "query_id", "cand_id"])
    whole = lambda x: F.bround(x).cast("long").cast("string")
    tenths = lambda x: F.concat((F.floor(x * 10 + 0.5) / 10).cast("long").cast("string"), F.lit("."),
                                F.pmod(F.floor(x * 10 + 0.5), F.lit(10)).cast("string"))
    percent = whole((theirs - ours) / ours * 100)
    reasons = F.array_compact(F.array(
        F.when(confident, F.lit("✨ Confident Replacement: High demand + Rising trend")),
        F.when(faster, F.concat(F.lit("Selling "), percent, F.lit("% more units/month than current product")))
         .when(slightly, F.lit("Slightly higher sales velocity")),
        F.when(rising, F.lit("Demand is trending upward this season")),
        F.when(safer, F.lit("🛡️ Safer alternative (No harmful ingredients)")),
        F.when(better, F.concat(F.lit("Superior satisfaction (⭐"), tenths(rating), F.lit(")")))
         .when(rating >= 4.0, F.lit("Highly rated by customers")),
        F.when(stocked, F.lit("Well stocked and available")),
        F.when(skins, F.lit("Suitable for same skin types"))))
    why = F.array_compact(F.array(
        F.when(faster, F.concat(F.lit("Higher demand ("), whole(theirs), F.lit("/mo vs "), whole(ours), F.lit("/mo)"))),
        F.when(rising, F.lit("Rising trend — good time to stock more")),
        F.when(safer, F.lit("Avoids harmful ingredients found in current product")),
        F.when(better, F.concat(F.lit("Better customer feedback than current (⭐"), tenths(own_rating), F.lit(")"))),
        F.when(confident, F.lit("Top-performing alternative with better growth potential"))))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("Alternative product in your inventory"))).otherwise(F.slice(reasons, 1, 3))
    return j.select(*k, "query_id", "cand_id", "rec_rank", "rec_score", reasons.alias("reasons"), F.slice(why, 1, 2).alias("why_better"),
                    rising.alias("is_trending"), confident.alias("is_confident"), F.bround(theirs).cast("long").alias("avg_monthly_sales"))


# ------------------------------------------------------------------ J09
def ranking_metrics(ranked: DataFrame, attrs: DataFrame, relevance: str, id_col: str = "product_id",
                    ks: Sequence[int] = (1, 3, 5, 10), full_ideal: bool = False) -> DataFrame:
    """P@K, NDCG@K, HR@K and MRR averaged over queries; relevant = same ``relevance`` attribute.

    ``ranked``: (product_id, similar_id, rank).  NDCG's ideal uses the relevant
    items retrieved in the top K (as the reference does) unless ``full_ideal``."""
    qa = attrs.select(F.col(id_col).alias("product_id"), F.col(relevance).alias("_qa"))
    ra = attrs.select(F.col(id_col).alias("similar_id"), F.col(relevance).alias("_ra"))
    j = ranked.join(qa, "product_id").join(ra, "similar_id")
    j = j.withColumn("rel", ((F.col("_qa") == F.col("_ra")) & F.col("_qa").isNotNull()).cast("int"))
    per_q = []
    for k in ks:
        per_q += [F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"n_rel_{k}"),
                  F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0))
                   .alias(f"dcg_{k}")]
    per_q.append(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rel"))
    q = j.groupBy("product_id").agg(*per_q)
    out = []
    for k in ks:
        nrel = F.col(f"n_rel_{k}")
        # ideal DCG over min(n_rel, k) positions: sum_{i=1..m} 1/log2(i+1)
        idcg = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(nrel, F.lit(k)), F.lit(1))), F.lit(0.0),
                           lambda acc, i: acc + 1.0 / F.log2(i + 1))
        idcg = F.when(nrel > 0, idcg).otherwise(F.lit(0.0))
        out += [F.avg(nrel / k).alias(f"p_at_{k}"),
                F.avg(F.when(idcg > 0, F.col(f"dcg_{k}") / idcg).otherwise(0.0)).alias(f"ndcg_at_{k}"),
                F.avg((nrel > 0).cast("double")).alias(f"hr_at_{k}")]
    out.append(F.avg(F.coalesce(1.0 / F.col("first_rel"), F.lit(0.0))).alias("mrr"))
    return q.agg(F.count(F.lit(1)).alias("n_queries"), *out)


# ------------------------------------------------------------------ J10
def coverage_diversity(ranked: DataFrame, weights: DataFrame, n_items: DataFrame, top_k: int = 10,
                       blocks: DataFrame | None = None) -> DataFrame:
    """Share of the catalogue ever recommended; mean pairwise (1 - sim) inside each top-k list
    (at most k(k-1)/2 pairs per query, exact sims from the vectors)."""
    r = stored(ranked.where(F.col("rank") <= top_k))
    cov = r.agg(F.count_distinct("similar_id").alias("covered")).crossJoin(n_items) \
           .withColumn("coverage", F.col("covered") / F.col("n_items"))
    x = r.select("product_id", F.col("similar_id").alias("a"), F.col("rank").alias("ra"))
    y = r.select("product_id", F.col("similar_id").alias("b"), F.col("rank").alias("rb"))
    pairs = x.join(y, "product_id").where(F.col("ra") < F.col("rb")).select("product_id", "a", "b")
    sims = dot_products(pairs.select("a", "b").distinct(), weights, blocks)
    pj = pairs.join(sims, ["a", "b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    div = pj.groupBy("product_id").agg(F.avg(1 - F.col("sim")).alias("_d")).agg(F.avg("_d").alias("diversity"))
    return cov.crossJoin(div)


# ------------------------------------------------------------------ J11
def matrix_density(pairs: DataFrame, n_items: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Non-zeros / n^2 of the thresholded similarity matrix and the count above threshold."""
    c = pairs.agg(F.count(F.lit(1)).alias("nnz"), F.count_if(F.col("sim") >= threshold).alias("above"))
    return c.crossJoin(n_items).withColumn("density_pct", 100.0 * F.col("nnz") / (F.col("n_items") * F.col("n_items")))


def density_before_threshold(weights: DataFrame, items: DataFrame, id_col: str = "product_id", rows: int = 300) -> DataFrame:
    """(n_sampled, density_pct, error_pct): the estimated share of non-zero similarities of different items in the whole matrix.

    About ``rows`` items are drawn by a hash of their ids, and for each all items are counted that share a term with
    it: whole rows of the matrix, so its cost is that many rows, not their square.  ``error_pct`` is the
    standard error, with the correction for a finite matrix; no error if all items are drawn."""
    n = items.agg(F.count(F.lit(1)).alias("n"))
    ids = items.select(F.col(id_col).alias("a")).crossJoin(F.broadcast(n))
    drawn = ids.where(md5_mod(F.col("a").cast("string"), DRAWS) < F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n")) * DRAWS).select("a")
    of_a = weights.select(F.col("doc_id").alias("a"), "term").join(drawn, "a")
    met = of_a.join(weights.select(F.col("doc_id").alias("b"), "term"), "term").where("a != b").select("a", "b").distinct()
    each = drawn.join(met.groupBy("a").agg(F.count(F.lit(1)).alias("k")), "a", "left").fillna(0, ["k"])
    s = each.agg(F.count(F.lit(1)).alias("m"), F.avg("k").alias("k"), F.stddev_samp("k").alias("sd")).crossJoin(n)
    left = F.greatest(F.lit(0.0), 1 - F.col("m") / F.col("n"))
    return s.select(F.col("m").alias("n_sampled"), (100.0 * F.col("k") / F.col("n")).alias("density_pct"),
                    (100.0 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("m") / F.col("n") * F.sqrt(left)).alias("error_pct"))


# ------------------------------------------------------------------ J12
def packed_vectors(df: DataFrame, id_col: str, vec: str, block: int) -> DataFrame:
    """(ids, vectors): blocks of at most ``block`` unit vectors, as one matrix of doubles each; null vectors are left out, zeros stay zero."""
    rows = df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                norm = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "vectors"])

    return rows.mapInArrow(pack, f"ids array<{id_type}>, vectors binary")


def embedding_topk(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                   q_id: str = "query_id", q_vec: str = "query_vec", k: int = 10, block: int = 4096) -> DataFrame:
    """Cosine top-k items per query vector (ties by id), exactly.

    Both sides are packed into blocks of vectors.  Each pair of blocks is one row, worked on as one matrix product;
    it gives the ``k`` best items of its block for each query, and these lists are merged.  So rows never meet one by
    one, what is shuffled is blocks and short lists, and neither side is broadcast but by the planner's own check."""
    items = packed_vectors(vectors, id_col, vec, block)
    qs = packed_vectors(queries, q_id, q_vec, block).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    id_type, q_type = items.schema["ids"].dataType.elementType.simpleString(), qs.schema["q_ids"].dataType.elementType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, q_ids = batch.column("ids")[r].values, batch.column("q_ids")[r].values
                x = np.frombuffer(batch.column("vectors")[r].as_buffer()).reshape(len(ids), -1)
                q = np.frombuffer(batch.column("q_vectors")[r].as_buffer()).reshape(len(q_ids), -1)
                order = np.asarray(pc.rank(ids))
                for at in range(0, len(q), 256):
                    cosine = np.round(q[at:at + 256] @ x.T, 9) + 0.0
                    least = np.partition(cosine, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                    row, col = np.nonzero(cosine >= least[:, None])
                    by = np.lexsort((order[col], -cosine[row, col], row))
                    row, col = row[by], col[by]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col = row[place < k], col[place < k]
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row + at)), ids.take(pa.array(col)), pa.array(cosine[row, col])], [q_id, id_col, "cosine"])

    j = items.crossJoin(qs).mapInArrow(best, f"{q_id} {q_type}, {id_col} {id_type}, cosine double")
    w = Window.partitionBy(q_id).orderBy(F.desc("cosine"), F.col(id_col))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """Mean vector per label (element-wise average; one row per label)."""
    v = vectors.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    m = v.groupBy(label, "i").agg(F.avg("x").alias("x"))
    return (m.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_s"))
             .select(F.col(label).alias("query_id"), F.transform("_s", lambda s: s["x"]).alias("query_vec")))


# ------------------------------------------------------------------ I13
def term_weights(weights: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), F.col("term"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
