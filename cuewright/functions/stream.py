"""Iterators over Arrow batches of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
    """Where a row differs from the one before it in any of ``columns``; true for the first row."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        new[1:] = False
        for c in columns:
            column = batch.column(c)
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if not pa.types.is_integer(column.type) or column.null_count else column.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[int], at_least: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole groups of rows with equal ``columns``, of a partition sorted by them.

    Only the group that a batch ends with is held back, so memory is bounded by
    the largest group and a batch.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        whole = _concat(held)
        cut = int(np.flatnonzero(changes(whole, columns))[-1])
        if cut:
            yield whole.slice(0, cut)
        held, rows = [whole.slice(cut)], 0
    if held:
        yield _concat(held)


def _concat(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
