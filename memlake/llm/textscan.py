"""Word scanning over Arrow text batches with numpy.

The functions work on the UTF-8 bytes of an Arrow string column, so no Python
string is made per row or per word.  A batch is cut at document boundaries into
chunks of about ``CHUNK_BYTES`` to bound the memory of the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
_FNV_OFFSET = np.uint64(0xCBF29CE484222325)
_FNV_PRIME = np.uint64(0x100000001B3)

#: Byte classes: what belongs to a word.  Bytes from 0x80 are parts of non-ASCII characters.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Chunk(NamedTuple):
    """Documents ``first .. first + len(bounds) - 1`` of a batch; bounds has one more entry."""

    first: int
    bytes: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's documents, nulls as empty texts, in chunks of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield Chunk(first, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(chunk: Chunk, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the maximal runs of bytes of a class within each document."""
    inside = kind[chunk.bytes]
    n = len(inside)
    if n == 0 or not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = chunk.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    return np.searchsorted(chunk.bounds, start, "right") - 1, start, length


def words(chunk: Chunk, kind: np.ndarray = SPACED) -> Words:
    """The ``word_spans`` hashed with A-Z folded (FNV-1a, mixed)."""
    doc, start, length = word_spans(chunk, kind)
    return Words(doc, start, length, span_hashes(chunk, start, length))


def span_hashes(chunk: Chunk, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes, none of them empty, A-Z folded (FNV-1a, mixed)."""
    folded = LOWER[chunk.bytes].astype(np.uint64)
    h = np.full(len(start), _FNV_OFFSET)
    active, at = np.arange(len(start)), 0
    while len(active):
        h[active] = (h[active] ^ folded[start[active] + at]) * _FNV_PRIME
        at += 1
        active = active[length[active] > at]
    return mix(h)


def multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def grams(doc: np.ndarray, hashes: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of a document, and the index of their first word.

    With ``short``, a document of 1 to n - 1 words gives its whole sequence as one gram.
    """
    factors = multipliers(n, 77)
    total = len(hashes)
    at, g = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if total >= n:
        at = np.flatnonzero(doc[n - 1 :] == doc[: total - n + 1])
        g = np.zeros(len(at), np.uint64)
        for j in range(n):
            g += hashes[at + j] * factors[j]
    if short and total:
        firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        counts = np.diff(np.r_[firsts, total])
        small = np.flatnonzero(counts < n)
        if len(small):
            extra = counts[small].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for j in range(n - 1):
                has = counts[small] > j
                extra[has] += hashes[firsts[small[has]] + j] * factors[j]
            at, g = np.r_[at, firsts[small]], np.r_[g, extra]
            order = np.argsort(at, kind="stable")
            at, g = at[order], g[order]
    return at, mix(g)


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """int64 lists of the given sizes over the concatenated values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
