"""Main text of web pages: structure, and line differences between pages of near addresses.

A page is cut into blocks (lines): the text between tags that break lines, with
character references decoded and white space turned into single spaces.  Each
line has a role from the elements it stands in: ``article`` (inside an article or
main element), ``aside`` (inside a menu, header or footer of the page, sidebar,
notice, advert, form or reader comments) or ``open`` (neither).

Pages of a site repeat what isn't their own.  The pages of each host are sorted
by the path of their address, neighbours are paired, and the longest common
subsequence of their lines tells which lines they share.  Shared lines are
deleted, unless they stand in the article itself: an article that quotes its
neighbour stays whole.  In a page with an article, the main text is the article;
in a page without one, it is the open lines that no neighbour shares.

The pairs come from one sort of all pages by host and path, so a host with most
of the pages is no single task; only 64-bit hashes of lines are moved, not texts.

Defined results: null or empty html has the text ''; a null url is a page
without neighbours; repeated rows are neighbours of each other only as far as
their other rows are: equal rows count as one page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_index
from ..session import cut_lineage
from .url_lists import host, path

OPEN, ARTICLE, ASIDE = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_WHITE = re.compile(r"[\s ]+")
_HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: text that is no text of the page
HIDDEN = {"script", "style", "template", "noscript", "iframe", "object", "svg", "head", "title", "textarea", "select", "canvas", "audio", "video", "math"}
ASIDES = {"nav", "footer", "aside", "form", "dialog", "menu", "button"}
#: words of class, id and role names that mark what isn't main text
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
               "sidebar", "footer", "cookie", "cookies", "consent", "notice", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "share", "social", "related",
               "comment", "comments", "replies", "disqus", "search", "contentinfo", "complementary"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: a new one of these ends an open one
CLOSED_BY_SELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def words_of(name: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


def lines(page: str) -> list[tuple[str, int]]:
    """(text, role) of the lines of a page, in order."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []   # open block elements and the role inside each
    role, at, n = OPEN, 0, len(page)

    def close_line() -> None:
        if held:
            text = _WHITE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                out.append((text, role))

    def text(raw: str) -> None:
        held.append(entities.unescape(raw) if "&" in raw else raw)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            tail = page[at:]
            cut = re.search(r"<(?:/?[a-zA-Z]|!|\?)[^>]*$", tail)   # a page that ends inside a tag
            text(tail[:cut.start()] if cut else tail)
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in HIDDEN:
            if not closing and not m[3].endswith("/"):
                if tag == "head":
                    continue
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                if tag in INLINE or end is None and tag not in ("script", "style", "title", "textarea", "template"):
                    continue
                at = n if end is None else page.find(">", end.start()) + 1 or n
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            if tag not in VOID and not closing and _HINT.search(m[3]) is None:
                continue
            if tag in VOID or closing and not any(t == tag for t, _ in stack):
                continue
        else:
            close_line()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    role = stack[-1][1] if stack else OPEN
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSED_BY_SELF and stack and stack[-1][0] == tag:
            stack.pop()
            role = stack[-1][1] if stack else OPEN
        inside = role
        if role != ASIDE:
            hints = {w for g in _HINT.findall(m[3]) for x in g if x for w in words_of(x)} if m[3] else set()
            if tag in ASIDES or tag == "header" and role == OPEN or tag not in ("body", "html", "article", "main") and hints & ASIDE_WORDS:
                if tag in INLINE:
                    close_line()
                inside = ASIDE
            elif tag in ("article", "main") or "main" in hints:
                inside = ARTICLE
        if tag in INLINE and inside == role:
            continue
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        stack.append((tag, inside))
        role = inside
    close_line()
    return out


def line_hashes(found: list[tuple[str, int]]) -> list[int]:
    """Hashes of the lines that may be main text; those that the page's structure rules out aren't compared."""
    return [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t, r in found if r != ASIDE]


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, by bit rows: one big number for each element of ``a``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    if not any(x in where for x in a):
        return set()
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    rows = [row]     # a zero bit j in row i: the length grows from b[:j] to b[:j + 1], against a[:i]
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, j = set(), len(b)
    for i in range(len(a), 0, -1):
        low = (1 << j) - 1
        zeros = ~rows[i] & low
        if zeros == 0:
            break
        if (~rows[i - 1] & low).bit_count() == zeros.bit_count():
            continue
        out.add(i - 1)
        # the match is the last element of b[:j] that raises the length
        j = zeros.bit_length() - 1
    return out


def main_text(found: list[tuple[str, int]], shared: set[int]) -> tuple[str, int]:
    """Main text, and how many lines were deleted as shared; ``shared`` counts as line_hashes does."""
    if any(r == ARTICLE for _, r in found):
        return "\n".join(t for t, r in found if r == ARTICLE), 0
    compared = [t for t, r in found if r != ASIDE]
    kept = [t for k, t in enumerate(compared) if k not in shared]
    return "\n".join(kept), len(compared) - len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines shared with neighbours), n_deleted (open lines deleted for it) for every row of ``pages``."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("key", F.xxhash64("page_id", "url", "html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([line_hashes(lines(x)) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["key", "url", "h"])

    rows = pages.where("url is not null").select("key", "url", "html").mapInArrow(hashes, "key long, url string, h array<long>").dropDuplicates(["key"])
    rows = rows.select("key", "h", host("url").alias("host"), path("url").alias("path"))
    at = global_index(rows, [F.col("host"), F.col("path"), F.col("key")], "at")
    side = lambda d, x: at.select((F.col("at") + d).alias("at"), F.col("host").alias(f"host_{x}"), F.col("h").alias(f"h_{x}"))
    trio = (at.select("at", "key", "host", "h").join(side(1, "prev"), "at", "left").join(side(-1, "next"), "at", "left")
              .select("key", "h", F.when(F.col("host_prev") == F.col("host"), F.col("h_prev")).alias("prev"), F.when(F.col("host_next") == F.col("host"), F.col("h_next")).alias("next")))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, *columns = batch.columns
            out = [sorted(common(h, p or []) | common(h, q or [])) for h, p, q in zip(*(c.to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([key, pa.array(out, pa.list_(pa.int32()))], names=["key", "shared"])

    shared = trio.mapInArrow(differ, "key long, shared array<int>")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(x or [], main_text(lines(h), set(x or []))) for h, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for _, (t, _) in both], pa.string()), pa.array([len(t) for _, (t, _) in both], pa.int64()),
                                              pa.array([len(x) for x, _ in both], pa.int64()), pa.array([d for _, (_, d) in both], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars", "n_shared", "n_deleted"])

    whole = pages.join(cut_lineage(shared), "key", "left").select("page_id", "url", "html", "shared")
    return whole.mapInArrow(texts, "page_id long, url string, text string, n_chars long, n_shared long, n_deleted long")
