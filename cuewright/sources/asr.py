"""Transcripts of sound: providers of segments, and a table that keeps what has been transcribed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.errors import ERROR, MediaError
from cuewright.operators.frames import ready
from cuewright.options import DEFAULT_MODEL
from cuewright.sources import subtitles
from cuewright.sources.files import file_fingerprint

#: Fixed value: the shape of the names of speech models.
MODEL_NAME = re.compile(r"(tiny|base|small|medium)(\.en)?(-q\d_\d)?|large(-v[123](-turbo)?)?(-q\d_\d)?")
SEGMENTS = T.ArrayType(T.StructType([T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("turn", T.BooleanType())]))


def model_name(name: str | None = None) -> str:
    """A valid model name: given, from the environment, or the default."""
    name = name or os.environ.get("CUEWRIGHT_MODEL") or DEFAULT_MODEL
    if not MODEL_NAME.fullmatch(name):
        raise MediaError("TRANSCRIBE_FAILED", f"no such speech model: {name!r}")
    return name


def model_dir() -> str:
    """Where speech models are kept: ``XDG_CACHE_HOME``, ``LOCALAPPDATA`` on Windows, else ``~/.cache``."""
    base = os.environ.get("XDG_CACHE_HOME") or (os.environ.get("LOCALAPPDATA") if os.name == "nt" else None) or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(base, "cuewright", "models")


class Transcriber(Protocol):
    """Turns a file into segments on an executor."""

    def segments(self, path: str, model: str) -> list[dict]:
        """``start_ms, end_ms, text`` and maybe ``turn`` of each segment."""


class Sidecar:
    """Segments from a subtitle file beside the medium: ``talk.srt`` for ``talk.mp4``."""

    def segments(self, path: str, model: str) -> list[dict]:
        for extension in (".srt", ".vtt"):
            beside = Path(path).with_suffix(extension)
            if beside.is_file():
                return parse_text(beside.read_text("utf-8", "replace"), extension)
        raise MediaError("NO_AUDIO_STREAM", f"nothing transcribes {path}: no speech provider, no subtitles beside it")


def parse_text(content: str, extension: str) -> list[dict]:
    """Cues of one subtitle text by the grammar of ``sources.subtitles``, without Spark."""
    if extension not in (".srt", ".vtt"):
        return [{"start_ms": 0.0, "end_ms": 0.0, "text": content}]
    out = []
    for block in re.split(subtitles.BETWEEN, content.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")):
        stamp = re.search(subtitles.ARROW, block)
        if stamp is None or re.match(subtitles.NO_CUE, block):
            continue
        text = re.sub(r"<[^>]*>", "", block[stamp.end() :]).replace("\n", " ").strip()
        if text:
            ms = [int(h or 0) * 3_600_000 + int(m) * 60_000 + int(s) * 1000 + int(f.ljust(3, "0")) for h, m, s, f in (stamp.groups()[:4], stamp.groups()[4:])]
            out.append({"start_ms": float(ms[0]), "end_ms": float(ms[1]), "text": text})
    return out


def transcribe(files: DataFrame, transcriber: Transcriber | None = None, model: str | None = None, known: DataFrame | None = None, key: str = "media_id", path: str = "path") -> DataFrame:
    """``key, fingerprint, model, segments, error`` of each file.

    ``known`` is a table of earlier results: files whose (fingerprint, model) it
    has are not transcribed again.  A file that fails has an error.  Heavy work
    per row: repartition ``files`` to what the cluster can run at once.
    """
    model = model_name(model)
    transcriber = transcriber or Sidecar()
    kind = files.schema[key].dataType
    marks = T.StructType([T.StructField("k", kind), T.StructField("p", T.StringType()), T.StructField("fingerprint", T.StringType())])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(fingerprint=[file_fingerprint(p) if p is not None and os.path.isfile(p) else None for p in batch["p"]])

    result = T.StructType([*marks.fields, T.StructField("segments", SEGMENTS), T.StructField("error", ERROR)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    if row.fingerprint is None:
                        raise MediaError("FILE_NOT_FOUND", f"no such file: {row.p}")
                    ready(transcriber)
                    found = [{"turn": None, **s} for s in transcriber.segments(row.p, model)]
                    out.append((row.k, row.p, row.fingerprint, found, None))
                except MediaError as bad:
                    out.append((row.k, row.p, row.fingerprint, None, {"code": bad.code, "message": bad.message}))
                except Exception as bad:  # noqa: BLE001
                    out.append((row.k, row.p, row.fingerprint, None, {"code": "TRANSCRIBE_FAILED", "message": str(bad)}))
            yield pd.DataFrame(out, columns=["k", "p", "fingerprint", "segments", "error"])

    marked = files.select(F.col(key).alias("k"), F.col(path).alias("p")).mapInPandas(mark, marks)
    if known is None:
        done = marked.mapInPandas(work, result)
    else:
        had = known.where(F.col("model") == model).select(F.col("fingerprint").alias("f"), F.col("segments").alias("s")).dropDuplicates(["f"])
        old = marked.join(had, F.col("fingerprint") == F.col("f")).select("k", "p", "fingerprint", F.col("s").cast(SEGMENTS).alias("segments"), F.lit(None).cast(ERROR).alias("error"))
        done = marked.join(had, F.col("fingerprint") == F.col("f"), "left_anti").mapInPandas(work, result).unionByName(old)
    return done.select(F.col("k").alias(key), "fingerprint", F.lit(model).alias("model"), "segments", "error")


def segment_rows(transcribed: DataFrame, key: str = "media_id") -> DataFrame:
    """Segments of ``transcribe``, one row each, numbered."""
    return transcribed.select(key, F.posexplode("segments").alias("seg_idx", "s")).select(key, "seg_idx", "s.*")
