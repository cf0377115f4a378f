"""Schemas of the records this library reads and writes.

Offsets into a medium are numbers, seconds in ``*_sec`` and milliseconds in
``*_ms`` columns; time stamps are only for when a row came in.
"""

from __future__ import annotations

from pyspark.sql import types as T

from cuewright.errors import ERROR


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """A struct of ``name type`` pairs, nested types by name; parsed here, as Spark's parser needs a session."""
    pairs = [field.split() for field in text.split(",") if field.strip()]
    return T.StructType([T.StructField(name, _TYPES[kind] if kind in _TYPES else nested[kind]) for name, kind in pairs])


SEGMENT = _struct("media_id string, seg_idx int, start_ms double, end_ms double, text string, turn boolean")
ACCELERATION = _struct("backend string, hardware boolean")
MEDIA_INFO = _struct(
    "path string, type string, duration_sec double, width int, height int, video_codec string, fps double, audio_codec string, "
    "sample_rate int, channels int, file_size_bytes bigint, acceleration accel",
    accel=ACCELERATION,
)
#: A probe never fails its task: a row has either a value or an error.
PROBE_RESULT = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("path", T.StringType()), T.StructField("info", MEDIA_INFO), T.StructField("error", ERROR)])
GRID_WINDOW = _struct("media_id string, grid_idx int, start_sec double, end_sec double")
PLANNED_WINDOW = _struct("grid_idx int, start_sec double, end_sec double, timestamps_sec times", times=T.ArrayType(T.DoubleType()))
TILE = _struct("timestamp_sec double, timestamp_label string")
FRAME = _struct("image binary, timestamp_sec double, timestamp_label string")
GRID_IMAGE = _struct("image binary, start_sec double, end_sec double, tiles tiles", tiles=T.ArrayType(TILE))
#: Text and image items; nulls are left out of the JSON, which makes the two shapes.
CONTENT_ITEM = _struct("type string, text string, data string, mimeType string")
VIDEO_INFO = _struct(
    "id string, title string, duration_sec double, description string, uploader string, view_count bigint, upload_date string, "
    "thumbnail_url string, has_subtitles boolean, subtitle_languages names, url string",
    names=T.ArrayType(T.StringType()),
)
#: One nested row per medium, for what is kept of a whole analysis.
UNDERSTAND_RESULT = _struct("info info, segments segments, transcript string, grid_images grids", info=MEDIA_INFO, segments=T.ArrayType(SEGMENT), grids=T.ArrayType(GRID_IMAGE))
