"""Runs of consecutive segments that say the same, each as one event.

Method: symbol strings.  Canonical texts of a block of segments are mapped to
code points (a text that differs from the one before it only by a slip of the
pen gets that one's), the code points are concatenated, a pattern with a
backreference finds the repetitions, and spans are mapped back to segments and
times.  Blocks bound what a task holds of a hot medium; the first and last run
of each block are joined with its neighbours' afterwards, in one ordered pass
that other runs only cross.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.stream import changes, whole_groups
from cuewright.llm.speech import alike, canonical
from cuewright.operators.latest import BLOCK, latest_in_blocks

#: Columns of a piece that a run has too.
_RESULT = [0, 2, 3, 4, 5, 6, 7]
_PIECES = re.compile(r"([^\n])\1*")


def _symbols(says: list[str], first_of_block: np.ndarray) -> str:
    """A code point for each event and a line feed before each block."""
    out: list[str] = []
    known: dict[str, str] = {}
    before = ""
    for text, opens in zip(says, first_of_block.tolist()):
        if opens:
            out.append("\n")
            known, symbol = {}, ""
        else:
            symbol = out[-1] if alike(before, text) else ""
        if not symbol:
            symbol = known.get(text, "")
            if not symbol:
                at = 256 + len(known)
                symbol = chr(at if at < 0xD800 else at + 0x800)
        known.setdefault(text, symbol)
        out.append(symbol)
        before = text
    return "".join(out)


def _pieces(batches: Iterator[pa.RecordBatch], names: list[str], least: int) -> Iterator[pa.RecordBatch]:
    for batch in whole_groups(batches, [0, 1]):
        entity, block, position = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        says = canonical(batch.column(5).to_pylist())
        kept = np.array([i for i, s in enumerate(says) if s], np.int64)
        if not len(kept):
            continue
        group = np.cumsum(changes(batch, [0, 1]))[kept]
        opens = np.ones(len(kept), bool)
        opens[1:] = group[1:] != group[:-1]
        says = [says[i] for i in kept]
        text = _symbols(says, opens)
        spans = np.array([m.span() for m in _PIECES.finditer(text)], np.int64)
        event = np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) != 10) - 1
        low, high = event[spans[:, 0]], event[spans[:, 1] - 1]
        closes = np.append(opens[1:], True)
        head, tail = opens[low], closes[high]
        use = np.flatnonzero(head | tail | (high - low + 1 >= least))
        begin, end = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float)[kept] for c in (3, 4))
        start_ms, end_ms = np.fmin.reduceat(begin, low)[use], np.fmax.reduceat(end, low)[use]
        low, high, head, tail = low[use], high[use], head[use], tail[use]
        edge = head | tail
        rows = pa.array(kept[low])
        arrays = [
            entity.take(rows),
            pa.array(np.where(edge, -1, block[kept[low]]).astype(np.int32)),
            pa.array(position[kept[low]].astype(np.int64)),
            pa.array(position[kept[high]].astype(np.int64)),
            pa.array((high - low + 1).astype(np.int64)),
            pa.array(start_ms, mask=np.isnan(start_ms)),
            pa.array(end_ms, mask=np.isnan(end_ms)),
            batch.column(5).take(rows),
            pa.array(head),
            pa.array([says[i] if e else None for i, e in zip(low, edge)], pa.string()),
            pa.array([says[i] if e else None for i, e in zip(high, edge)], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _joined(batches: Iterator[pa.RecordBatch], names: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """Runs out of pieces ordered by (entity, bucket, first): those of bucket -1 may go on in the next one."""
    kept: list[tuple] = []
    open_run: list | None = None
    before = kind = None

    def closed() -> None:
        if open_run is not None and open_run[3] >= least:
            kept.append(tuple(open_run))

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), kind)], names=names)
        kept.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        edge = batch.column(1).to_numpy() < 0
        kind = [batch.column(c).type for c in _RESULT]
        if not edge.all():
            inner = batch.filter(pa.array(~edge))
            yield pa.RecordBatch.from_arrays([inner.column(c) for c in _RESULT], names=names)
        for entity, first, last, n, start, end, text, head, says_first, says_last in zip(*(c.to_pylist() for k, c in enumerate(batch.filter(pa.array(edge)).columns) if k != 1)):
            if open_run is not None and open_run[0] == entity and head and before is not None and says_first is not None and alike(before, says_first):
                open_run[2], open_run[3] = last, open_run[3] + n
                open_run[4] = min((x for x in (open_run[4], start) if x is not None), default=None)
                open_run[5] = max((x for x in (open_run[5], end) if x is not None), default=None)
            else:
                closed()
                open_run = [entity, first, last, n, start, end, text]
            before = says_last
        if kept:
            yield told()
    closed()
    if kept:
        yield told()


def collapse(
    df: DataFrame,
    entity: str = "media_id",
    position: str = "seg_idx",
    text: str = "text",
    start: str = "start_ms",
    end: str = "end_ms",
    version: str = "ingested_at",
    least: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """Each run of neighbouring events that say the same as one event.

    Columns: entity, ``first_seg_idx, last_seg_idx, n, start_ms, end_ms,
    duration_ms, text`` (of the first event); runs of at least ``least`` events.
    Of rows with one (entity, position) the latest version counts.  Null and
    blank texts, and those without any letter, digit or note sign, are skipped
    and don't break a run; rows without entity or position have no place and are
    left out.  Missing times count as absent: a run's start is the least and its
    end the greatest there is, null if there is none.  An empty table gives an
    empty result; further columns aren't read.  ``block`` positions are ordered
    by a task at a time; the result doesn't depend on it.
    """
    rows = df.select(
        F.col(entity).alias("entity"), F.col(position).alias("position"), F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"), F.col(text).alias("text"), F.col(version).alias("version")
    )
    current = latest_in_blocks(rows, "entity", "position", "version", block).where(F.length(F.trim("text")) > 0)
    schema = T.StructType(
        [T.StructField("entity", df.schema[entity].dataType), T.StructField("bucket", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("first", "last", "n")]
        + [T.StructField(c, T.DoubleType()) for c in ("start", "end")]
        + [T.StructField("text", T.StringType()), T.StructField("head", T.BooleanType()), T.StructField("says_first", T.StringType()), T.StructField("says_last", T.StringType())]
    )
    names = schema.fieldNames()
    pieces = current.select("entity", "block", "position", "start", "end", "text").mapInArrow(lambda it: _pieces(it, names, least), schema)
    result = T.StructType([schema["entity"], *(T.StructField(c, schema[o].dataType) for c, o in (("first_seg_idx", "first"), ("last_seg_idx", "last"), ("n", "n"), ("start_ms", "start"), ("end_ms", "end"), ("text", "text")))])
    found = result.fieldNames()
    runs = pieces.repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "first").mapInArrow(lambda it: _joined(it, found, least), result)
    return runs.select(
        F.col("entity").alias(entity),
        F.col("first_seg_idx").cast(df.schema[position].dataType).alias("first_seg_idx"),
        F.col("last_seg_idx").cast(df.schema[position].dataType).alias("last_seg_idx"),
        "n",
        "start_ms",
        "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        "text",
    )
