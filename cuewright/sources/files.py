"""Files as DataFrames: paths, sizes, kinds, fingerprints, and probes of their headers."""

from __future__ import annotations

import glob as globs
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.errors import MediaError
from cuewright.schemas import PROBE_RESULT
from cuewright.sources import headers

#: Bytes at either end of a file that its fingerprint reads.
SAMPLE_BYTES = 64 * 1024
#: Paths a worker probes in one batch.
PROBE_BATCH = 64


def is_glob(path: str) -> bool:
    return any(c in path for c in "*?[]{")


def _braces(pattern: str) -> list[str]:
    """Patterns with ``{a,b}`` written out."""
    start = pattern.find("{")
    if start < 0:
        return [pattern]
    depth, parts, last = 0, [], start + 1
    for i in range(start, len(pattern)):
        if pattern[i] == "{":
            depth += 1
        elif pattern[i] == "," and depth == 1:
            parts.append(pattern[last:i])
            last = i + 1
        elif pattern[i] == "}":
            depth -= 1
            if depth == 0:
                parts.append(pattern[last:i])
                return [p for middle in parts for p in _braces(pattern[:start] + middle + pattern[i + 1 :])]
    return [pattern]


def expand_paths(paths: str | list[str]) -> list[str]:
    """Absolute paths of literals and glob patterns, each once, where it came first.

    A literal that matches nothing is kept, so that probing it reports the
    error; a pattern that matches nothing adds nothing.  Nothing but blanks, or
    nothing at all in the end, is an error.
    """
    entries = [paths] if isinstance(paths, str) else list(paths)
    entries = [e.strip() for e in entries if e.strip()]
    if not entries:
        raise MediaError("INVALID_SAMPLING", "give at least one path or pattern that isn't empty")
    found: dict[str, None] = {}
    for entry in entries:
        if is_glob(entry) and not os.path.exists(entry):
            for pattern in _braces(entry):
                for match in sorted(globs.glob(pattern, recursive=True)):
                    found.setdefault(os.path.abspath(match))
        else:
            found.setdefault(os.path.abspath(entry))
    if not found:
        raise MediaError("INVALID_SAMPLING", "the paths and patterns match no files")
    return list(found)


def paths_frame(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``ordinal, path`` of a list of paths."""
    return spark.createDataFrame(pd.DataFrame({"ordinal": range(len(paths)), "path": paths}), "ordinal long, path string")


def stat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, file_size_bytes`` of the files under paths; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(paths).select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("file_size_bytes"))


def kind_of(head: Column | str, path: Column | str) -> Column:
    """'image', 'av' or 'unknown' of a file, by its first bytes, else by its extension."""
    head, path = (F.col(x) if isinstance(x, str) else x for x in (head, path))
    code = F.hex(F.substring(head, 1, 16))
    starts = lambda *marks: F.coalesce(code.rlike("^(" + "|".join(marks) + ")"), F.lit(False))
    image = starts(*headers.IMAGE_MAGIC)
    av = starts(*headers.AV_MAGIC)
    extension = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when(image, "image").when(av, "av").when(extension.isin(*headers.IMAGE_EXTENSIONS), "image").otherwise("unknown")


def fingerprint(content: Column | str, length: Column | str) -> Column:
    """SHA-256 of the size as text, the first 64 KiB, and the last 64 KiB if the file is larger than both."""
    content, length = (F.col(x) if isinstance(x, str) else x for x in (content, length))
    tail = F.when(length > 2 * SAMPLE_BYTES, F.substring(content, (length - SAMPLE_BYTES + 1).cast("int"), F.lit(SAMPLE_BYTES))).otherwise(F.lit(b""))
    return F.sha2(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, SAMPLE_BYTES), tail), 256)


def file_fingerprint(path: str) -> str:
    """The same of one file, reading no more than those bytes whatever its size."""
    import hashlib

    size = os.stat(path).st_size
    digest = hashlib.sha256(str(size).encode())
    with open(path, "rb") as f:
        digest.update(f.read(min(SAMPLE_BYTES, size)))
        if size > 2 * SAMPLE_BYTES:
            f.seek(size - SAMPLE_BYTES)
            digest.update(f.read(SAMPLE_BYTES))
    return digest.hexdigest()


Prober = Callable[[str], headers.Info]


def probe_file(path: str, prober: Prober = headers.probe) -> tuple[dict | None, dict | None]:
    """``(info, error)`` of one file; never raises."""
    try:
        if not os.path.isfile(path):
            raise MediaError("FILE_NOT_FOUND", f"no such file: {path}")
        info = asdict(prober(path))
        return {**info, "path": path, "file_size_bytes": os.stat(path).st_size}, None
    except MediaError as bad:
        return None, {"code": bad.code, "message": bad.message}
    except Exception as bad:  # noqa: BLE001
        return None, {"code": "UNSUPPORTED_FORMAT", "message": f"cannot read {path}: {bad}"}


def probe_content(df: DataFrame, key: str, path: str = "path", content: str = "content") -> DataFrame:
    """``key, info, error`` of files whose content (as much of it as has headers) is in a column; one row per row, no shuffle."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *PROBE_RESULT.fields[2:]])

    def one(name: str | None, body: bytes | None) -> tuple[dict | None, dict | None]:
        try:
            if body is None:
                raise MediaError("FILE_NOT_FOUND", "no content")
            return {**asdict(headers.probe_bytes(bytes(body), name or "")), "path": name, "file_size_bytes": len(body)}, None
        except MediaError as bad:
            return None, {"code": bad.code, "message": bad.message}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(n, b) for n, b in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"key": batch["key"].values, "info": [i for i, _ in found], "error": [e for _, e in found]})

    return df.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, schema).withColumnRenamed("key", key)


def probe(paths: DataFrame, prober: Prober = headers.probe, partitions: int | None = None) -> DataFrame:
    """``ordinal, path, info, error`` of each path of ``ordinal, path``: headers only, nothing is decoded.

    One narrow stage over slices of paths, which must be reachable from every
    executor.  A file that can't be read has an error; the others don't notice.
    """
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("path", T.StringType()), *PROBE_RESULT.fields[2:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), PROBE_BATCH):
                part = batch.iloc[low : low + PROBE_BATCH]
                found = [probe_file(p, prober) if p is not None else (None, {"code": "FILE_NOT_FOUND", "message": "no path"}) for p in part["path"]]
                yield pd.DataFrame({"ordinal": part["ordinal"].values, "path": part["path"].values, "info": [i for i, _ in found], "error": [e for _, e in found]})

    rows = paths.select("ordinal", "path")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, schema)
