"""Transcript segments against visual windows: overlap, best window, grouping, window filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import col
from cuewright.operators.latest import BLOCK, block_of

#: Windows of one medium that are joined as one array; a medium with more is matched in buckets of time.
MAX_WINDOWS = 1024
#: Seconds in a bucket of time.
BUCKET_SEC = 600


def overlap_ms(seg_start: Column | str, seg_end: Column | str, win_start: Column | str, win_end: Column | str) -> Column:
    """Milliseconds that two spans share; never negative. Null bounds share nothing."""
    shared = F.least(col(seg_end), col(win_end)) - F.greatest(col(seg_start), col(win_start))
    known = col(seg_start).isNotNull() & col(seg_end).isNotNull() & col(win_start).isNotNull() & col(win_end).isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), shared)).otherwise(F.lit(0.0))


def in_window(df: DataFrame, start_sec: float | None = None, end_sec: float | None = None, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Segments that overlap ``[start_sec, end_sec)``, not clipped; all of them if neither bound is given.

    A plain predicate on the stored columns, so it is pushed to the scan.
    Segments with a null bound are in no window.
    """
    if start_sec is None and end_sec is None:
        return df
    kept = F.col(end) > float(start_sec or 0) * 1000
    return df.where(kept if end_sec is None else kept & (F.col(start) < float(end_sec) * 1000))


def assign_to_windows(segments: DataFrame, windows: DataFrame, entity: str = "media_id", window: str = "grid_idx", start: str = "start_ms", end: str = "end_ms", dense: bool | None = None) -> DataFrame:
    """Each segment with the window of its medium that it overlaps most, and by how much.

    Adds ``window`` (null: it overlaps none) and ``overlap_ms``; ties go to the
    lowest window; every segment row comes out once.  ``windows`` has ``entity,
    window, start_sec, end_sec``.  Segments or windows with null bounds overlap
    nothing; nulls in ``entity`` match nothing.

    The windows of a medium travel as one array, so there is one join and no
    second shuffle for the best of each segment; a hot medium is split by the
    skew join of adaptive execution.  That needs windows to be few per medium:
    where one has more than ``MAX_WINDOWS`` (which is counted, unless ``dense``
    says), windows and segments meet in buckets of time instead.
    """
    wins = windows.where(F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull() & F.col(entity).isNotNull()).select(
        F.col(entity).alias("_entity"), F.col(window).alias("_w"), (F.col("start_sec") * 1000).alias("_a"), (F.col("end_sec") * 1000).alias("_b")
    )
    if dense is None:
        dense = bool(wins.groupBy("_entity").count().where(F.col("count") > MAX_WINDOWS).limit(1).count())
    if dense:
        return _assign_in_buckets(segments, wins, entity, window, start, end)
    arrays = wins.groupBy("_entity").agg(F.collect_list(F.struct("_w", "_a", "_b")).alias("_windows"))
    joined = segments.join(arrays, F.col(entity) == F.col("_entity"), "left")
    scored = F.transform("_windows", lambda w: F.struct(overlap_ms(start, end, w["_a"], w["_b"]).alias("ov"), (-w["_w"]).alias("neg")))
    best = F.array_max(F.filter(scored, lambda s: s["ov"] > 0))
    return joined.withColumn("_best", best).withColumn(window, -F.col("_best.neg")).withColumn("overlap_ms", F.coalesce(F.col("_best.ov"), F.lit(0.0))).drop("_entity", "_windows", "_best")


def _assign_in_buckets(segments: DataFrame, wins: DataFrame, entity: str, window: str, start: str, end: str) -> DataFrame:
    width = BUCKET_SEC * 1000.0
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.greatest(F.floor(a / width), F.floor((b - 0.001) / width))))
    keyed = segments.withColumn("_row", F.monotonically_increasing_id())
    usable = keyed.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)) & F.col(entity).isNotNull())
    left = usable.select("_row", F.col(entity).alias("_left"), F.col(start).alias("_s"), F.col(end).alias("_e"), buckets(F.col(start), F.col(end)).alias("_bucket"))
    right = wins.where("_b > _a").select("*", buckets(F.col("_a"), F.col("_b")).alias("_wb"))
    pairs = left.join(right, (F.col("_left") == F.col("_entity")) & (F.col("_bucket") == F.col("_wb")))
    ov = overlap_ms("_s", "_e", "_a", "_b")
    best = pairs.where(ov > 0).groupBy("_row").agg(F.max(F.struct(ov.alias("ov"), (-F.col("_w")).alias("neg"))).alias("_best"))
    return keyed.join(best, "_row", "left").withColumn(window, -F.col("_best.neg")).withColumn("overlap_ms", F.coalesce(F.col("_best.ov"), F.lit(0.0))).drop("_row", "_best")


def positions_by_window(assigned: DataFrame, windows: DataFrame, entity: str = "media_id", window: str = "grid_idx", position: str = "seg_idx", block: int = BLOCK) -> DataFrame:
    """``entity, window, block, positions``: segments of every window in order, one row per block of ``block`` positions.

    So no row grows with a window, whatever it holds.  A window without any
    segment has one row with a null block and an empty array; segments in no
    window, and those without a position, are left out.
    """
    kept = assigned.where(F.col(window).isNotNull() & F.col(position).isNotNull()).withColumn("block", block_of(position, block))
    grouped = kept.groupBy(entity, window, "block").agg(F.array_sort(F.collect_list(position)).alias("positions"))
    every = windows.select(entity, window).distinct()
    return every.join(grouped, [entity, window], "left").withColumn("positions", F.coalesce("positions", F.array().cast(grouped.schema["positions"].dataType)))
