"""Operators on tables of probed media: preflight, isolation of errors, caches, distinct paths and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import options as o
from cuewright.errors import error
from cuewright.functions.text import col, duration_label, fixed1


def preflight_size(size: Column | str, tool: str, most: int = o.MAX_FILE_BYTES) -> Column:
    """``FILE_TOO_LARGE`` above the limit (not at it); null for an unknown size."""
    message = F.concat(F.lit("This file is "), fixed1(col(size).cast("double") / 1024**3), F.lit(f" GB, too large for {tool}: the most is {most / 1024**3:g} GB."))
    return error("FILE_TOO_LARGE", F.when(col(size) > most, message))


def preflight_duration(kind: Column | str, duration: Column | str, most: int, tool: str) -> Column:
    """``FILE_TOO_LARGE`` for audio and video longer than ``most`` seconds (not at it)."""
    advice = (
        f"{tool} reads the whole sound track whatever the window; sample pictures with a window, or ask for the transcript alone."
        if most == o.MAX_DURATION_FULL_SEC
        else "Probe first, sample pictures of a part, or take a summary of the beginning."
    )
    message = F.concat(F.lit("This file is "), duration_label(duration), F.lit(f" long; {tool} takes "), duration_label(F.lit(float(most))), F.lit(f" at most.\n\n{advice}"))
    return error("FILE_TOO_LARGE", F.when(col(kind).isin("audio", "video") & (col(duration) > most), message))


def preflight(media: DataFrame, tool: str = "understand_media", most: int = o.MAX_DURATION_FULL_SEC) -> DataFrame:
    """``media`` with ``error``: what keeps a medium from heavy work, its size first. Filter on it before that work."""
    return media.withColumn("error", F.coalesce(preflight_size("file_size_bytes", tool), preflight_duration("type", "duration_sec", most, tool)))


def isolate_errors(media: DataFrame, code: str = "error_code") -> DataFrame:
    """Each row with ``ok`` and its ``error`` struct: one bad file never fails the others."""
    return media.withColumn("ok", F.col(code).isNull()).withColumn("error", F.when(F.col(code).isNotNull(), F.struct(F.col(code).alias("code"), F.lit("the probe failed").alias("message"))))


def probe_counts(media: DataFrame, code: str = "error_code", by: list[str] | None = None) -> DataFrame:
    return media.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col(code).isNull()).alias("n_ok"), F.count_if(F.col(code).isNotNull()).alias("n_failed"))


def check_batch(media: DataFrame, max_files: int | None = None, lift: bool = False) -> DataFrame:
    """``media`` unchanged, or ``INVALID_SAMPLING`` if it has more rows than one call may probe (``lift``: batch jobs have no such limit)."""
    from cuewright.errors import MediaError

    limit = o.probe_limit(max_files)
    if not lift and len(media.select(F.lit(1)).take(limit + 1)) > limit:
        raise MediaError("INVALID_SAMPLING", f"the request names more than {limit} files; name fewer, or raise max_files (at most {o.MOST_PROBE_FILES})")
    return media


def first_seen(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Distinct ``key`` values with the ordinal at which each came first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ordinal).alias(ordinal))


def union_in_order(*arrays: Column | str) -> Column:
    """Distinct elements of several arrays, where each came first; null arrays and elements don't count."""
    out = F.array().cast("array<string>")
    for a in arrays:
        out = F.array_union(out, F.filter(F.coalesce(col(a), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return out


def admit_to_cache(df: DataFrame, key: list[str], text: str, used_at: str, entries: int = o.CACHE_ENTRIES, most_chars: int = o.CACHE_TRANSCRIPT_CHARS) -> DataFrame:
    """The transcripts a cache of ``entries`` keeps: the most recently used of those short enough.

    Keyed by content fingerprint *and* model, so that a second model doesn't get
    the first one's text.  A top-k: only ``entries`` rows per task are sorted on.
    """
    newest = Window.partitionBy(*key).orderBy(F.col(used_at).desc_nulls_last(), F.col(text).desc_nulls_last())
    one_each = df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    fits = one_each.where(F.coalesce(F.length(text), F.lit(0)) <= most_chars)
    return fits.orderBy(F.col(used_at).desc_nulls_last(), *key).limit(entries)
