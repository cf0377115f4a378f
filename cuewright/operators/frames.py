"""Frames and frame grids as JPEG columns: one row in, one picture out, no shuffle of pixels."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.errors import ERROR, MediaError
from cuewright.functions import images
from cuewright.functions.text import QUALITY


class FrameProvider(Protocol):
    """Decodes pictures of a medium on an executor."""

    def frame(self, path: str, at_sec: float) -> np.ndarray:
        """RGB pixels of the first frame at or after ``at_sec``, else of the last before it."""


class FrameFolder:
    """Frames that lie beside a medium: ``clip.mp4.frames/000012345.png`` is the one at 12.345 s."""

    def frame(self, path: str, at_sec: float) -> np.ndarray:
        folder = f"{path}.frames"
        names = sorted(n for n in os.listdir(folder) if os.path.splitext(n)[0].isdigit()) if os.path.isdir(folder) else []
        if not names:
            raise MediaError("NO_VIDEO_STREAM", f"no frames of {path}: no decoder, no folder of frames beside it")
        times = np.array([int(os.path.splitext(n)[0]) for n in names]) / 1000
        at = min(int(np.searchsorted(times, at_sec)), len(names) - 1)
        with open(os.path.join(folder, names[at]), "rb") as f:
            return images.decode(f.read())


class Fallback:
    """The first provider that delivers, in order: hardware decoders before software ones."""

    def __init__(self, *providers: FrameProvider) -> None:
        self.providers = providers

    def frame(self, path: str, at_sec: float) -> np.ndarray:
        for provider in self.providers[:-1]:
            try:
                return provider.frame(path, at_sec)
            except Exception:  # noqa: BLE001
                continue
        return self.providers[-1].frame(path, at_sec)


def ready(provider: object) -> None:
    """``FFMPEG_NOT_FOUND`` if a provider says that what it needs isn't installed."""
    available = getattr(provider, "available", None)
    if available is not None and not available():
        raise MediaError("FFMPEG_NOT_FOUND", f"{type(provider).__name__} isn't available here")


def _label(sec: float) -> str:
    ms = max(0, int(np.floor(sec * 1000 + 0.5)))
    return f"{ms // 3_600_000:02d}:{ms % 3_600_000 // 60_000:02d}:{ms % 60_000 // 1000:02d}.{ms % 1000:03d}"


def _lookup(sec: float, duration: float | None) -> float:
    return sec if duration is None or duration != duration else min(sec, max(0.0, duration - 0.2))


def _one_frame(provider: FrameProvider, path: str, sec: float, duration: float | None) -> np.ndarray:
    at = _lookup(sec, duration)
    return images.with_banner(provider.frame(path, at), _label(at))


def _problem(bad: Exception, code: str) -> dict:
    return {"code": bad.code, "message": bad.message} if isinstance(bad, MediaError) else {"code": code, "message": str(bad)}


def grid_images(plans: DataFrame, provider: FrameProvider | None = None, aspect_mode: str = "contain", most_width: int = 1280) -> DataFrame:
    """``plans`` with ``image`` (a JPEG of the grid) and ``error``.

    Reads ``path, duration_sec, timestamps_sec, n_cols, thumb_width``.  Each
    frame has a banner with its time; tiles take the first frame's shape.  Every
    grid is a row of its own, so grids of one medium are made in parallel; a
    grid that fails doesn't harm the others.  Rows with an error keep it.
    """
    provider = provider or FrameFolder()
    had = "error" in plans.columns
    rows = plans if had else plans.withColumn("error", F.lit(None).cast(ERROR))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "error"], T.StructField("image", T.BinaryType()), T.StructField("error", ERROR)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pictures, errors = [], []
            for row in batch.itertuples(index=False):
                picture, bad = None, row.error
                if bad is None:
                    try:
                        ready(provider)
                        found = [_one_frame(provider, row.path, t, row.duration_sec) for t in row.timestamps_sec]
                        picture = images.encode_jpeg(images.shrink(images.compose(found, int(row.n_cols), int(row.thumb_width), aspect_mode), most_width), QUALITY["q75"])
                    except Exception as failed:  # noqa: BLE001
                        bad = _problem(failed, "GRID_FAILED")
                pictures.append(picture)
                errors.append(bad)
            yield batch.drop(columns="error").assign(image=pictures, error=errors)

    return rows.mapInPandas(run, schema)


def frame_images(targets: DataFrame, provider: FrameProvider | None = None, most_width: int = 1280) -> DataFrame:
    """``targets`` with ``image``, ``timestamp_label`` and ``error``; reads ``path, duration_sec, timestamp_sec``.

    A negative time is an error of its row.
    """
    provider = provider or FrameFolder()
    schema = T.StructType([*targets.schema.fields, T.StructField("image", T.BinaryType()), T.StructField("timestamp_label", T.StringType()), T.StructField("error", ERROR)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pictures, labels, errors = [], [], []
            for row in batch.itertuples(index=False):
                picture = bad = None
                try:
                    if row.timestamp_sec is None or not row.timestamp_sec >= 0:
                        raise MediaError("FRAME_FAILED", "a time must not be negative")
                    ready(provider)
                    picture = images.encode_jpeg(images.shrink(_one_frame(provider, row.path, row.timestamp_sec, row.duration_sec), most_width), QUALITY["q75"])
                except Exception as failed:  # noqa: BLE001
                    bad = _problem(failed, "FRAME_FAILED")
                pictures.append(picture)
                labels.append(None if row.timestamp_sec is None else _label(row.timestamp_sec))
                errors.append(bad)
            yield batch.assign(image=pictures, timestamp_label=labels, error=errors)

    return targets.mapInPandas(run, schema)
