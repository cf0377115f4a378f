"""Streams of arriving files and segments, through the same functions as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.schemas import SEGMENT
from cuewright.sources import subtitles


def subtitle_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Cues of subtitle files as they arrive in a folder: ``path, seg_idx, start_ms, end_ms, text``."""
    arriving = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return subtitles.parse(arriving.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def segments(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Segments as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(T.StructType([*SEGMENT.fields, T.StructField("ingested_at", T.TimestampType())])).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, keys: list[str], at: str = "ingested_at", late: str = "10 days") -> DataFrame:
    """Each (keys, ``at``) once, rows up to ``late`` behind the newest one included; state beyond that is let go."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, at])


def arrivals_per_medium(stream: DataFrame, width: str = "1 hour", slide: str | None = None, at: str = "ingested_at", late: str = "10 days") -> DataFrame:
    """Segments per medium and window of arrival; a window comes out once nothing can come for it any more."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy("media_id", window).agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("text")).alias("n_chars")).select("media_id", F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n_segments", "n_chars")


def sessions(stream: DataFrame, key: str, at: str, pause: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events: a pause of that length ends one."""
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, pause)).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "n_events")
