"""Media behind URLs: metadata of a downloader, cached downloads, and local paths."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.errors import MediaError
from cuewright.functions.text import number_or_zero, text_or_empty


def parse_metadata(df: DataFrame, json: str, url: str) -> DataFrame:
    """``VIDEO_INFO`` columns from the JSON a downloader dumps for a URL, beside the other columns.

    Texts that are missing are empty, numbers zero; the channel stands in for a
    missing uploader; languages are the keys of subtitles and of automatic
    captions, each once, where it came first.  A broken JSON gives empty values.
    """
    keep = [c for c in df.columns if c not in (json, url)]
    get = lambda name: F.get_json_object(json, f"$.{name}")
    keys = lambda name: F.coalesce(F.json_object_keys(get(name)), F.array().cast("array<string>"))
    languages = F.array_union(keys("subtitles"), keys("automatic_captions"))
    uploader: Column = F.when(F.length(text_or_empty(get("uploader"))) > 0, get("uploader")).otherwise(text_or_empty(get("channel")))
    return df.select(
        *keep,
        text_or_empty(get("id")).alias("id"),
        text_or_empty(get("title")).alias("title"),
        number_or_zero(get("duration")).alias("duration_sec"),
        text_or_empty(get("description")).alias("description"),
        uploader.alias("uploader"),
        number_or_zero(get("view_count")).cast("long").alias("view_count"),
        text_or_empty(get("upload_date")).alias("upload_date"),
        text_or_empty(get("thumbnail")).alias("thumbnail_url"),
        (F.size(languages) > 0).alias("has_subtitles"),
        languages.alias("subtitle_languages"),
        F.col(url).alias("url"),
    )


class Fetcher(Protocol):
    """What a downloader can do; implementations run on executors, one URL at a time."""

    def metadata(self, url: str) -> str:
        """JSON of a URL's metadata."""

    def download(self, url: str, kind: str, target: str) -> None:
        """Write files named ``kind.*`` for a URL into the folder ``target``."""


#: Extensions that a download of each kind may have.
EXTENSIONS = {"subs": [".srt", ".vtt", ".ass", ".json3"], "thumb": [".jpg", ".png", ".webp"], "video": [".mp4", ".webm", ".mkv"], "audio": [".m4a", ".mp3", ".wav", ".opus", ".ogg"]}


def find_file(folder: str, prefix: str, extensions: list[str]) -> str | None:
    """The first file, by name, with a prefix and one of the extensions."""
    if not os.path.isdir(folder):
        return None
    for name in sorted(os.listdir(folder)):
        if name.startswith(prefix) and Path(name).suffix.lower() in extensions:
            return os.path.join(folder, name)
    return None


class CommandFetcher:
    """A fetcher that calls an installed command-line downloader."""

    # What that command takes for each kind of file.
    ARGUMENTS = {
        "subs": ["--write-subs", "--write-auto-subs", "--sub-lang", "all", "--sub-format", "srt/vtt/best", "--skip-download"],
        "thumb": ["--write-thumbnail", "--skip-download"],
        "video": ["-f", "worst[ext=mp4]/worst"],
        "audio": ["-x", "--audio-format", "m4a"],
    }

    def __init__(self, command: str = "yt-dlp", timeout_sec: int = 300, run: Callable[..., subprocess.CompletedProcess] = subprocess.run) -> None:
        self.command, self.timeout, self._run = command, timeout_sec, run

    def available(self) -> bool:
        return shutil.which(self.command) is not None

    def _call(self, arguments: list[str], may_fail: bool = False) -> str:
        if not self.available():
            raise MediaError("YT_DLP_NOT_FOUND", f"{self.command} is not installed")
        try:
            done = self._run([self.command, "--no-warnings", "--no-playlist", *arguments], capture_output=True, text=True, timeout=self.timeout)
        except subprocess.TimeoutExpired as late:
            raise MediaError("YT_DLP_FAILED", f"{self.command} took more than {self.timeout} s", late) from late
        if done.returncode and not may_fail:
            raise MediaError("YT_DLP_FAILED", (done.stderr or "the download failed").strip()[-500:])
        return done.stdout

    def metadata(self, url: str) -> str:
        return self._call(["--dump-json", "--no-download", "--", url])

    def download(self, url: str, kind: str, target: str) -> None:
        self._call([*self.ARGUMENTS[kind], "-o", os.path.join(target, f"{kind}.%(ext)s"), "--", url], may_fail=kind == "subs")


def hash_of(url: str) -> str:
    import hashlib

    return hashlib.sha256(url.strip().encode()).hexdigest()[:16]


def fetch(url: str, kind: str, cache: str, fetcher: Fetcher) -> str | None:
    """The cached file of a URL, downloaded if it isn't there; None only for subtitles that don't exist."""
    folder = os.path.join(cache, hash_of(url))
    if found := find_file(folder, kind, EXTENSIONS[kind]):
        return found
    os.makedirs(folder, exist_ok=True)
    fetcher.download(url, kind, folder)
    found = find_file(folder, kind, EXTENSIONS[kind])
    if found is None and kind != "subs":
        raise MediaError("YT_DLP_FAILED", f"no {kind} was downloaded for {url}")
    return found


def local_path(url: str, cache: str, fetcher: Fetcher, audio: bool = False) -> str:
    """A local file for a URL: its video, or its sound with the video as a fallback."""
    if audio:
        try:
            return fetch(url, "audio", cache, fetcher)
        except MediaError:
            pass
    return fetch(url, "video", cache, fetcher)


def resolve(df: DataFrame, cache: str, fetcher: Fetcher, path: str = "path", audio: bool = False) -> DataFrame:
    """``df`` with ``local`` and ``error``: URLs downloaded to a cache that all executors share, other paths as they are.

    One URL that can't be had is one row with an error.  URLs are made distinct
    and spread first, so that each is downloaded once.
    """
    from pyspark.sql import types as T

    from cuewright.functions.text import is_url

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    out.append((url, local_path(url.strip(), cache, fetcher, audio), None, None))
                except MediaError as bad:
                    out.append((url, None, bad.code, bad.message))
                except Exception as bad:  # noqa: BLE001
                    out.append((url, None, "UNKNOWN", str(bad)))
            yield pd.DataFrame(out, columns=["url", "local", "code", "message"])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "local", "code", "message")])
    wanted = df.where(is_url(path)).select(F.col(path).alias("url")).distinct()
    got = wanted.mapInPandas(run, schema).select("url", F.col("local").alias("_local"), F.when(F.col("code").isNotNull(), F.struct("code", "message")).alias("error"))
    joined = df.join(got, F.col(path) == F.col("url"), "left").drop("url")
    return joined.withColumn("local", F.when(is_url(path), F.col("_local")).otherwise(F.col(path))).drop("_local")
