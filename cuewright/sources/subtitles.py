"""Subtitle files as segments: SRT and WebVTT, anything else as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import srt_separators, strip_tags

_STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
#: The grammar of cues, for Spark's expressions and for Python alike: the line with the arrow, what parts blocks, blocks that are none.
ARROW = rf"(?m)^[^\S\n]*{_STAMP}[^\S\n]+-->[^\S\n]+{_STAMP}[^\n]*$"
BETWEEN = r"\n[^\S\n]*\n\s*"
NO_CUE = r"^\s*(NOTE|STYLE|REGION)\b"


def _ms(block: Column, first: int) -> Column:
    part = lambda k: F.regexp_extract(block, ARROW, first + k)
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    return number(part(0)) * 3_600_000 + number(part(1)) * 60_000 + number(part(2)) * 1000 + number(F.rpad(part(3), 3, "0"))


def parse(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Cues of each file: the other columns, ``seg_idx, start_ms, end_ms, text``.

    Blocks are what empty lines set apart; those without an arrow (headers,
    STYLE, NOTE) are no cues, nor are cues without text.  Tags go, line feeds
    become blanks.  Cues are numbered as they stand.  Files that are neither
    ``.srt`` nor ``.vtt`` give one segment from 0 to 0 with all their text; a
    null text gives none.  Everything stays in the JVM, one row per file to one
    per cue, no shuffle.
    """
    extension = F.lower(F.regexp_extract(F.col(path), r"(\.[^./\\]*)$", 1))
    keep = [c for c in df.columns if c not in (path, content)]
    unix = F.regexp_replace(F.regexp_replace(F.col(content), "\r\n?", "\n"), "^﻿", "")
    known = extension.isin(".srt", ".vtt")
    blocks = F.split(F.when(extension == ".srt", srt_separators(unix)).otherwise(unix), BETWEEN)
    cues = F.filter(blocks, lambda b: b.rlike(ARROW) & ~b.rlike(NO_CUE))
    cell = lambda b: F.struct(_ms(b, 1).alias("start_ms"), _ms(b, 5).alias("end_ms"), strip_tags(F.element_at(F.split(b, ARROW, 2), 2)).alias("text"))
    whole = F.array(F.struct(F.lit(0.0).alias("start_ms"), F.lit(0.0).alias("end_ms"), F.col(content).alias("text")))
    found = F.when(F.col(content).isNull(), F.array().cast("array<struct<start_ms:double,end_ms:double,text:string>>")).when(known, F.filter(F.transform(cues, cell), lambda c: F.length(c["text"]) > 0)).otherwise(whole)
    return df.select(*keep, F.col(path), F.posexplode(found).alias("seg_idx", "_cue")).select(*keep, path, "seg_idx", "_cue.*")


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, seg_idx, start_ms, end_ms, text`` of subtitle files (a path, a folder or a glob)."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return parse(files)
