"""Sampling plans of videos: which times to look at, in which grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright import options as o
from cuewright.errors import error
from cuewright.functions.text import is_portrait
from cuewright.options import GridOptions


def _or(value: object, otherwise: Column | object) -> Column:
    return F.lit(value) if value is not None else (otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def normalise(media: DataFrame, opts: GridOptions | None = None) -> DataFrame:
    """Options of each video with defaults filled in, portrait ones where it is higher than wide.

    Adds ``n_grids, start_sec, end_sec, n_cols, n_rows, thumb_width, window_error``;
    reads ``type, duration_sec, width, height``.  An unusable duration or window
    makes an error row, not a failure.
    """
    opts = opts or GridOptions()
    tall = is_portrait("width", "height")
    pick = lambda value, portrait, usual: _or(value, F.when(tall, portrait).otherwise(usual)).cast("int")
    duration = F.col("duration_sec")
    begin = F.lit(float(opts.start_sec or 0))
    end = F.least(F.lit(float(opts.end_sec)), duration) if opts.end_sec is not None else duration
    usable = duration.isNotNull() & ~F.isnan(duration) & (duration > 0) & (duration < float("inf"))
    message = (
        F.when(~F.coalesce(F.col("type") == "video", F.lit(False)), F.lit(None))
        .when(~usable, F.lit("the duration of a video must be greater than 0"))
        .when(end <= begin, F.lit("the window ends before it starts"))
    )
    problem = F.when(~F.coalesce(F.col("type") == "video", F.lit(False)), error("NO_VIDEO_STREAM", "no video stream")).otherwise(error("INVALID_SAMPLING", message))
    return media.withColumns(
        {
            "n_grids": F.lit(opts.grids),
            "start_sec": begin,
            "end_sec": end,
            "n_cols": pick(opts.cols, o.PORTRAIT_COLS, o.COLS),
            "n_rows": pick(opts.rows, o.PORTRAIT_ROWS, o.ROWS),
            "thumb_width": pick(opts.thumb_width, o.PORTRAIT_THUMB_WIDTH, o.THUMB_WIDTH),
            "window_error": problem,
        }
    )


def plan(media: DataFrame, opts: GridOptions | None = None) -> DataFrame:
    """Sampling windows of each video, one row per grid; a video that can't be sampled is one row with an error.

    Adds to the columns of ``media``: ``grid_idx, grid_start_sec, grid_end_sec,
    timestamps_sec`` (bin centres, kept inside the window), ``frame_span_sec``
    and ``error``.  Grids may overlap or leave gaps if ``seconds_per_grid``
    isn't what their frames span; slack is shared by both ends.  The 'scene'
    strategy samples periodically, every ``frame_interval`` frames of a 30 fps
    clip: nothing detects scenes.  A generator: no shuffle.
    """
    opts = opts or GridOptions()
    frames = F.col("n_cols") * F.col("n_rows")
    total = F.col("end_sec") - F.col("start_sec")
    per_frame = opts.seconds_per_frame
    if opts.sampling_strategy == "scene" and per_frame is None:
        per_frame = max(1 / o.SCENE_FPS, opts.frame_interval / o.SCENE_FPS)
    spans = (
        normalise(media, opts)
        .withColumn("_frames", frames)
        .withColumn("_grid", _or(opts.seconds_per_grid, total / F.col("n_grids")).cast("double"))
        .withColumn("frame_span_sec", _or(per_frame, F.col("_grid") / F.col("_frames")).cast("double"))
        .withColumn("_required", (F.col("n_grids") - 1) * F.col("_grid") + F.col("_frames") * F.col("frame_span_sec"))
    )
    empty = (F.col("frame_span_sec") <= 0) | (F.col("_grid") <= 0)
    short = F.col("_required") - total > 1e-6
    message = F.when(empty, F.lit("the settings make windows of no width")).when(short, F.lit("the window is too short for so many grids and frames; ask for fewer, or for shorter spans"))
    checked = spans.withColumn("error", F.coalesce(F.col("window_error"), error("INVALID_SAMPLING", message)))
    offset = F.greatest(F.lit(0.0), total - F.col("_required")) / 2
    indices = F.when(F.col("error").isNull(), F.sequence(F.lit(0), F.col("n_grids") - 1)).otherwise(F.array(F.lit(None).cast("int")))
    rows = checked.withColumn("grid_idx", F.explode(indices))
    begin = F.col("start_sec") + offset + F.col("grid_idx") * F.col("_grid")
    rows = rows.withColumn("grid_start_sec", begin).withColumn("grid_end_sec", F.least(F.col("end_sec"), F.col("grid_start_sec") + F.col("_frames") * F.col("frame_span_sec")))
    last = F.greatest(F.col("start_sec"), F.col("end_sec") - 0.001)
    centre = lambda k: F.least(F.greatest(F.col("grid_start_sec") + k * F.col("frame_span_sec") + F.col("frame_span_sec") / 2, F.col("start_sec")), last)
    times = F.when(F.col("grid_idx").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("_frames") - 1), centre))
    return rows.withColumn("timestamps_sec", times).drop("_frames", "_grid", "_required", "window_error")
