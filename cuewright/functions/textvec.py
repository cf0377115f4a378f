"""Vectorised views of text columns: words, hashes and slices over Arrow buffers.

Python stages of this library never loop over characters or words.  They take
the UTF-8 buffer of an Arrow string column, cut it into slices of a bounded
number of bytes (so that numpy temporaries stay small whatever the batch size)
and work on whole slices at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        base = np.full(size, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        with np.errstate(over="ignore"):
            _powers = (np.cumprod(base), np.cumprod(inverse))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Slice:
    """Rows ``first``..``first + rows`` of a batch: their bytes, and where each row begins."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous string array without nulls (a null becomes the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive slices of at most ``limit`` bytes each (a longer row is a slice of its own)."""
    column = as_strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        low, high = int(offsets[first]), int(offsets[last])
        yield Slice(first, last - first, data[low:high], offsets[first : last + 1] - low)
        first = last


_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True


@dataclass
class Words:
    """Words of a slice: byte spans, the row of each, and a 64-bit hash of its bytes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def fold(column: pa.Array) -> pa.Array:
    """Compatibility-normalised lower case, without zero-width characters."""
    column = as_strings(column)
    column = pc.utf8_lower(pc.utf8_normalize(column, "NFKC"))
    return pc.replace_substring_regex(column, "[​‌‍­﻿]", "")


def words(part: Slice) -> Words:
    """Maximal runs of ASCII letters, digits and non-ASCII bytes; a run ends with its row."""
    data, offsets = part.data, part.offsets
    inside = _WORD[data]
    edge = np.empty(len(data) + 1, bool)
    if len(data):
        edge[0] = edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    else:
        edge[:] = False
    bounds = np.flatnonzero(edge)
    start = bounds[:-1]
    keep = inside[start] if len(start) else np.zeros(0, bool)
    start, end = start[keep], bounds[1:][keep]
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, row, span_hash(data, start, end))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial; independent of the position."""
    if not len(start):
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=prefix[1:])
        value = (prefix[end] - prefix[start]) * inverses[start]
    return mix(value)


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` words from each position on, and which of them lie in a single row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        value = hashes[:count].copy()
        for k in range(1, n):
            value = value * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + count]
    return mix(value), row[:count] == row[n - 1 :]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + counts[i]`` of every ``i``, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def new_rows(part: Slice, seen: set[int]) -> np.ndarray:
    """Which rows of a slice are texts that aren't in ``seen`` yet; adds them. Repeated texts count once this way."""
    hashes = span_hash(part.data, part.offsets[:-1], part.offsets[1:])
    fresh = np.zeros(part.rows, bool)
    for k, h in enumerate(hashes.tolist()):
        if h not in seen:
            seen.add(h)
            fresh[k] = True
    return fresh
