"""As-of lookup of frames: the first at or after a time, else the last before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units of time in a block; what is sorted together is one block of a medium.
BLOCK_SEC = 3600.0
#: Frames this close to the end may be missing, so later targets look here.
TAIL_SEC = 0.2


def clamp_targets(targets: DataFrame, duration: str = "duration_sec", time: str = "timestamp_sec") -> DataFrame:
    """Targets with ``lookup_sec``: no later than 0.2 s before the end, never negative."""
    latest = F.greatest(F.lit(0.0), F.col(duration) - TAIL_SEC)
    return targets.withColumn("lookup_sec", F.when(F.col(duration).isNull(), F.col(time)).otherwise(F.least(F.col(time), latest)))


def frames_at(frames: DataFrame, targets: DataFrame, entity: str = "media_id", frame_time: str = "pts_sec", lookup: str = "lookup_sec", out: str = "frame_sec", block: float = BLOCK_SEC) -> DataFrame:
    """Targets with ``out``: the time of the first frame at or after ``lookup``, else of the last before it.

    Null where the medium has no frames.  Frames and targets with null entity or
    time match nothing; every target row comes out once, repeated ones too.

    Times meet in blocks: inside a block a window over the union of both tables
    finds the neighbours; across blocks one row per block knows the first and
    last frame of the blocks around it, so no task sorts a whole medium.
    """
    at = F.floor(F.col("_t") / F.lit(block)).cast("long")
    points = frames.where(F.col(entity).isNotNull() & F.col(frame_time).isNotNull()).select(F.col(entity).alias("_m"), F.col(frame_time).cast("double").alias("_t")).withColumn("_k", at)
    keyed = targets.withColumn("_m", F.col(entity)).withColumn("_t", F.col(lookup).cast("double")).withColumn("_k", at)
    per_block = points.groupBy("_m", "_k").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    wanted = keyed.select("_m", "_k").where("_m IS NOT NULL AND _k IS NOT NULL").distinct()
    around = per_block.join(wanted, ["_m", "_k"], "full")
    order = Window.partitionBy("_m").orderBy("_k")
    around = around.select(
        F.col("_m").alias("_bm"),
        F.col("_k").alias("_bk"),
        F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
        F.last("_hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    both = keyed.withColumn("_target", F.lit(True)).unionByName(points.withColumn("_target", F.lit(False)), allowMissingColumns=True).withColumn("_frame", F.when(~F.col("_target"), F.col("_t")))
    # At equal times targets come first, so that a frame at the very time follows them.
    inside = Window.partitionBy("_m", "_k").orderBy(F.col("_t"), F.col("_target").desc())
    found = (
        both.withColumn("_after", F.first("_frame", ignorenulls=True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_prior", F.last("_frame", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("_target")
    )
    joined = found.join(around, (F.col("_m") == F.col("_bm")) & (F.col("_k") == F.col("_bk")), "left")
    return joined.withColumn(out, F.coalesce("_after", "_next", "_prior", "_before")).select(*targets.columns, out)
