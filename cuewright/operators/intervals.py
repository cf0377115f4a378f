"""Continuous covered periods of overlapping intervals, and the gaps between them.

Method: time is discretised into whole units and every (entity, time shard) has
a compressed bitmap of the units that are covered, as sorted runs of set bits.
Containers are united before the shuffle, within each batch, and again after
it; set runs and clear runs are then read off.  Only the first and the last run
of a shard can go on in a neighbour, so one row per shard, not per interval, is
ordered per entity in the end: an entity that holds a third of all rows costs a
short sort of its shards.  Intervals of days to millennia cover most of their
shards whole; those they name in groups of 64, groups of 64 groups and so on, so
that an interval of any length costs a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of time in a shard: 70 minutes of milliseconds.
SHARD = 1 << 22
_STRIDE = SHARD << 1
#: Shards to a group, groups to a group of the next level, and so on up to all of time.
_GROUP, _LEVELS = 64, 6
#: An interval that touches more shards (or groups of a level) names those it covers whole by groups of the next level.
_MANY = 2 * _GROUP


def unite(group: np.ndarray, low: np.ndarray, high: np.ndarray, hole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of runs ``[low, high)`` by group, with holes of fewer than ``hole`` units filled; sorted."""
    if not len(low):
        return group, low, high
    first = group * _STRIDE + low
    order = np.argsort(first, kind="stable")
    first, last = first[order], (group * _STRIDE + high)[order]
    reach = np.maximum.accumulate(last)
    opens = np.empty(len(first), bool)
    opens[0] = True
    opens[1:] = (first[1:] - reach[:-1] >= max(hole, 1)) | (first[1:] // _STRIDE != first[:-1] // _STRIDE)
    at = np.flatnonzero(opens)
    ends = reach[np.append(at[1:] - 1, len(first) - 1)]
    ids = first[at] // _STRIDE
    return ids, first[at] - ids * _STRIDE, ends - ids * _STRIDE


def _grouped(codes: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense id of each (code, shard), and a row that has it."""
    order = np.lexsort((shard, codes))
    new = np.ones(len(order), bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (shard[order][1:] != shard[order][:-1])
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, order[new]


def _containers(entity: pa.Array, shard: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    """One row per group: entity, shard and its runs as pairs of 32-bit offsets."""
    counts = np.bincount(group, minlength=len(rows))
    body = np.empty((len(low), 2), "<i4")
    body[:, 0], body[:, 1] = low, high
    offsets = np.concatenate([[0], np.cumsum(counts) * 8]).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())])
    return [entity.take(pa.array(rows)), pa.array(shard[rows]), runs]


def _levels(first: np.ndarray, stop: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Shards ``[first, stop)`` of each interval as ranges of shards (level 0) and of groups: level, interval, first, stop."""
    out, who = [], np.arange(len(first))
    for level in range(_LEVELS):
        long = stop - first > (_MANY if level < _LEVELS - 1 else 1 << 62)
        out.append((level, who[~long], first[~long], stop[~long]))
        who, first, stop = who[long], first[long], stop[long]
        low, high = -(-(first + 1) // _GROUP) if level == 0 else -(-first // _GROUP), (stop - 1) // _GROUP if level == 0 else stop // _GROUP
        # At level 0 the first and the last shard may be covered in part only, so they are in no group.
        out += [(level, who, first, low * _GROUP), (level, who, high * _GROUP, stop)]
        first, stop = low, high
        if not len(who):
            break
    return out


def _partial(batches: Iterator[pa.RecordBatch], hole: int, long: bool) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: containers of each batch; groups of shards that are covered whole have none."""
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, low, high = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        names = entity.dictionary_encode().indices.to_numpy()
        for level, who, begin, stop in _levels(low // SHARD, (high - 1) // SHARD + 1):
            if level and len(who) and not long:
                raise ValueError(f"an interval touches more than {_MANY} shards, which was ruled out")
            count = stop - begin
            piece = np.cumsum(count) >> 20  # bounded temporaries, whatever the intervals
            for at in np.split(np.arange(len(who)), np.flatnonzero(np.diff(piece)) + 1) if len(who) else []:
                row = np.repeat(who[at], count[at])
                upto = np.cumsum(count[at])
                shard = np.repeat(begin[at], count[at]) + np.arange(len(row)) - np.repeat(upto - count[at], count[at])
                group, rows = _grouped(names[row], shard)
                if level:
                    arrays = [entity.take(pa.array(row[rows])), pa.array(shard[rows]), pa.nulls(len(rows), pa.binary())]
                else:
                    ids, a, b = unite(group, np.maximum(low[row] - shard * SHARD, 0), np.minimum(high[row] - shard * SHARD, SHARD), hole)
                    arrays = _containers(entity.take(pa.array(row)), shard, ids, a, b, rows)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(rows), level, np.int8))], names=["entity", "shard", "runs", "level"])


def _final(batches: Iterator[pa.RecordBatch], hole: int) -> Iterator[pa.RecordBatch]:
    """After the shuffle, ordered by (entity, shard): what is settled inside a shard, and its edges."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        entity, shard = batch.column(0), batch.column(1).to_numpy()
        codes = entity.dictionary_encode().indices.to_numpy()
        new = np.ones(len(shard), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (shard[1:] != shard[:-1])
        group, rows = np.cumsum(new) - 1, np.flatnonzero(new)
        runs = batch.column(2)
        offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
        pairs = np.frombuffer(runs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i4").reshape(-1, 2).astype(np.int64)
        ids, low, high = unite(np.repeat(group, np.diff(offsets) // 8), pairs[:, 0], pairs[:, 1], hole)
        own = ids == len(rows) - 1  # the last group may go on in the next batch
        held = pa.RecordBatch.from_arrays(_containers(entity, shard, np.zeros(own.sum(), np.int64), low[own], high[own], rows[-1:]), names=["entity", "shard", "runs"])
        if len(rows) > 1:
            yield _settled(entity, shard, rows[:-1], ids[~own], low[~own], high[~own])
    if held is not None:
        pairs = np.frombuffer(held.column(2)[0].as_py(), "<i4").reshape(-1, 2).astype(np.int64)
        yield _settled(held.column(0), held.column(1).to_numpy(), np.zeros(1, np.int64), np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])


def _settled(entity: pa.Array, shard: np.ndarray, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    low, high = low + shard[rows][ids] * SHARD, high + shard[rows][ids] * SHARD
    opens, closes = np.ones(len(ids), bool), np.ones(len(ids), bool)
    opens[1:] = closes[:-1] = ids[1:] != ids[:-1]
    gap = np.flatnonzero(~opens)
    inner, edge = np.flatnonzero(~opens & ~closes), np.flatnonzero(opens | closes)
    place = np.concatenate([inner, gap, edge])
    kind = np.concatenate([np.zeros(len(inner), np.int8), np.ones(len(gap), np.int8), np.full(len(edge), 2, np.int8)])
    start = np.concatenate([low[inner], high[gap - 1], low[edge]])
    end = np.concatenate([high[inner], low[gap], high[edge]])
    follows = np.concatenate([np.zeros(len(inner) + len(gap), bool), ~opens[edge]])
    bucket = np.where(kind == 2, -1, shard[rows][ids[place]] & 0xFFFF)
    arrays = [entity.take(pa.array(rows[ids[place]])), pa.array(kind), pa.array(bucket.astype(np.int32)), pa.array(start), pa.array(end), pa.array(follows)]
    return pa.RecordBatch.from_arrays(arrays, names=["entity", "kind", "bucket", "start", "end", "follows"])


def any_long(df: DataFrame, start: str, end: str) -> bool:
    """Whether an interval spans so many shards that ``coverage`` has to name groups of them; counted over the table."""
    spans = F.floor(F.col(end).cast("double") + 0.5) - F.floor(F.col(start).cast("double") + 0.5)
    return bool(df.where(_finite(start) & _finite(end)).agg(F.coalesce(F.max(spans), F.lit(0))).first()[0] > (_MANY - 2) * SHARD)


def _finite(bound: str) -> Column:
    return F.abs(F.col(bound).cast("double")) < F.lit(float(1 << 53))  # also false for NaN, which is greatest


def coverage(df: DataFrame, entity: str, start: str, end: str, join_below: int = 1, max_gap: int | None = None, out: tuple[str, str, str] = ("item_kind", "from_ms", "to_ms"), long: bool | None = None) -> DataFrame:
    """Periods that the intervals ``[start, end)`` of each entity cover, and the gaps between them.

    Bounds are rounded to whole units, half up.  Intervals with a null, NaN or
    infinite bound (or one beyond 2**53, where a double isn't exact), or an end
    not after the start, cover nothing; rows without an entity are left out.
    Repeated and nested intervals change nothing.  A hole of fewer than
    ``join_below`` units (at least 1) doesn't end a period; a hole of
    ``join_below`` to ``max_gap`` units, both included, between neighbouring
    periods is a 'gap'; a longer one is neither.  An empty table gives an empty
    result; further columns aren't read.

    Shuffles run containers by (entity, shard), then one row per shard and
    result.  An interval costs one container per shard (70 minutes of ms) that
    it touches, up to 128; a longer one costs no more than 800 rows, as it names
    what it covers whole by groups of 64 shards, of 64 groups and so on, and what
    lies in such a group is dropped by joins.  ``long`` tells whether there may be
    such intervals, by default ``any_long(df)``, which is a pass of its own; a
    table that ``df`` was made from may be asked instead.
    """
    if not 1 <= join_below < SHARD:
        raise ValueError(f"join_below must be from 1 to {SHARD - 1}")
    kind = df.schema[entity].dataType
    long = any_long(df, start, end) if long is None else long
    whole = [F.floor(F.col(c).cast("double") + 0.5).cast("long") for c in (start, end)]
    spans = df.where(F.col(entity).isNotNull() & _finite(start) & _finite(end)).select(F.col(entity).alias("entity"), whole[0].alias("low"), whole[1].alias("high")).where("high > low")
    container = T.StructType([T.StructField("entity", kind), T.StructField("shard", T.LongType()), T.StructField("runs", T.BinaryType()), T.StructField("level", T.ByteType())])
    settled = T.StructType([T.StructField("entity", kind), T.StructField("kind", T.ByteType()), T.StructField("bucket", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("follows", T.BooleanType())])
    shards = spans.mapInArrow(lambda it: _partial(it, join_below, long), container)
    covered = _covered(shards) if long else None
    if covered is not None:
        shards = shards.where("level = 0").join(covered.where("level = 0"), ["entity", "shard"], "left_anti")
    parts = shards.select("entity", "shard", "runs").repartition("entity", "shard").sortWithinPartitions("entity", "shard").mapInArrow(lambda it: _final(it, join_below), settled)
    if covered is not None:
        size = F.element_at(F.array(*(F.lit(SHARD * _GROUP**k) for k in range(_LEVELS))), F.col("level") + 1)
        parts = parts.unionByName(
            covered.where("level > 0").select("entity", F.lit(2).cast("byte").alias("kind"), F.lit(-1).alias("bucket"), (F.col("shard") * size).alias("start"), ((F.col("shard") + 1) * size).alias("end"), F.lit(False).alias("follows"))
        )

    # Edges of an entity meet in bucket -1; what is settled only passes through, spread over its shards.
    order = Window.partitionBy("entity", "bucket").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hole = F.col("start") - before
    apart = F.coalesce(F.col("follows") | (F.col("kind") < 2) | (hole >= join_below), F.lit(True))
    numbered = parts.withColumn("before", before).withColumn("opens", apart).withColumn("period", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.struct(F.when(F.col("kind") == 1, "gap").otherwise("period").alias("kind"), F.col("start").alias("start"), F.col("end").alias("end"))
    between = F.struct(F.lit("gap").alias("kind"), F.col("before").alias("start"), F.col("start").alias("end"))
    found = F.when((F.col("kind") == 2) & F.col("opens") & ~F.col("follows") & F.col("before").isNotNull(), F.array(own, between)).otherwise(F.array(own))
    rows = numbered.select("entity", "bucket", "period", F.inline(found))
    rows = rows.groupBy("entity", "bucket", "period", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if max_gap is not None:
        rows = rows.where((F.col("kind") == "period") | (F.col("end") - F.col("start") <= max_gap))
    return rows.select(F.col("entity").alias(entity), F.col("kind").alias(out[0]), F.col("start").alias(out[1]), F.col("end").alias(out[2]))


def _covered(shards: DataFrame) -> DataFrame:
    """``entity, level, shard``: groups that an interval covers whole, and those shards with runs of their own that lie in one."""
    groups = shards.where("level > 0").select("entity", "level", "shard").distinct()
    inside = shards.where("level = 0").select("entity", F.col("shard").alias("own")).distinct()
    above = inside.select("entity", "own", F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("level"), F.floor(F.col("own") / _GROUP**k).cast("long").alias("shard")) for k in range(1, _LEVELS)))).alias("g")).select("entity", "own", "g.*")
    known = above.join(groups, ["entity", "level", "shard"], "left_semi").select("entity", F.lit(0).cast("byte").alias("level"), F.col("own").alias("shard")).distinct()
    return groups.unionByName(known)
