"""Vectorised word hashing over Arrow batches of texts.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D) of the
UTF-8 text, with A-Z lower-cased; no other character is changed.  Words are
never built as Python objects: a batch is one byte buffer, and each word gets a
64-bit hash from a running polynomial sum over that buffer.  The buffer is cut
into blocks of whole texts of about :data:`BLOCK_BYTES`, so the working arrays
stay small; a longer text is a block of its own and is never cut.

Hashes stand for words: two different words agree with a probability of about
2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[ord("A"):ord("Z") + 1] = _CODE[ord("a"):ord("z") + 1]
_BASE = int(_rng.integers(1, 2**62)) * 4 + 3
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: odd multipliers for combining and for hash families
ODD = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = _rng.integers(1, 2**63, 512, dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 16 * BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


@dataclass
class Block:
    """The words of some consecutive texts of a batch."""

    first: int           # row of the first text in the batch
    words: np.ndarray    # uint64 hash of each word
    at: np.ndarray       # int64, n_texts + 1: where each text's words begin in ``words``
    start: np.ndarray    # byte position of each word in ``data``
    end: np.ndarray      # its exclusive end
    data: np.ndarray     # uint8, the texts' bytes
    text_at: np.ndarray  # int64, n_texts + 1: where each text begins in ``data``
    total: np.ndarray    # running sum that hashes come from

    def __len__(self) -> int:
        return len(self.at) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data, at


#: separators that leave runs of letters and digits (and all bytes beyond ASCII)
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def hash_words(data: np.ndarray, text_at: np.ndarray, first: int = 0, separators: np.ndarray = _SPACE) -> Block:
    """Split and hash the words of the texts that ``text_at`` marks out in ``data``."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Block(first, np.zeros(0, np.uint64), np.zeros(len(text_at), np.int64), none, none, data, text_at, np.zeros(1, np.uint64))
    inside = ~separators[data]
    fresh = np.empty(n + 1, bool)     # a text begins here, so no word runs on
    fresh[:] = False
    fresh[text_at[:-1]] = True
    fresh[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODE[data] * _power("up", _BASE, n), out=total[1:])
    words = mix((total[end] - total[start]) * _power("down", _BASE_INV, n)[start])
    at = np.searchsorted(start, text_at)
    return Block(first, words, at, start, end, data, text_at, total)


def blocks(column: pa.Array, size: int = BLOCK_BYTES, separators: np.ndarray = _SPACE) -> Iterator[Block]:
    """The texts of a column in blocks of about ``size`` bytes, in order; every row is in one block."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield hash_words(data[at[i]:at[j]], at[i:j + 1] - at[i], i, separators)
        i = j


def prefixes(block: Block, n: int) -> np.ndarray:
    """Hash of the first ``n`` bytes of each word (of the whole word if it is shorter)."""
    end = np.minimum(block.start + n, block.end)
    return mix(((block.total[end] - block.total[block.start]) * _power("down", _BASE_INV, len(block.data))[block.start]) ^ SALT[200 + n])


def ngrams(block: Block, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside one text, and where each text's runs begin.

    With ``whole_if_short`` a text of 1 to n-1 words has one run: all its words.
    """
    w, at = block.words, block.at
    count = np.diff(at)
    m = max(0, len(w) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += w[k:k + m] * ODD[k]
    h = mix(h ^ SALT[n])
    runs = np.maximum(count - n + 1, 0)
    keep = np.zeros(len(w) + 1, np.int64)   # +1 where a text's runs begin, -1 where they end
    np.add.at(keep, at[:-1], (runs > 0).astype(np.int64))
    np.add.at(keep, at[:-1] + runs, -(runs > 0).astype(np.int64))
    h = h[np.cumsum(keep)[:m] > 0]
    if whole_if_short:
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                here = count[short] > k
                extra[here] += w[at[:-1][short[here]] + k] * ODD[k]
            extra = mix(extra ^ SALT[n] ^ mix(count[short].astype(np.uint64)))
            runs_at = np.concatenate([[0], np.cumsum(runs)])
            h = np.insert(h, runs_at[short], extra)
            runs = runs.copy()
            runs[short] = 1
    return h, np.concatenate([[0], np.cumsum(runs)])


def distinct_sorted(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group ``h[at[i]:at[i+1]]``, and where the groups begin now."""
    h = h.copy()
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s > 1:
            h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    size = np.concatenate([[0], np.cumsum(new)])
    return h[new], size[at]


def per_text(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduce`` of each group; ``empty`` for groups without values."""
    out = np.full(len(at) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, at[:-1][full])
    return out


def int64(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed numbers, as Spark holds them."""
    return h.view(np.int64) if h.flags.c_contiguous else h.copy().view(np.int64)
