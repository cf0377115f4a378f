"""The tools for one medium or a few: plain Python in, an answer of text and image items out.

Each answers ``{"content": [...]}``, or ``{"isError": True, "content": [...]}``
with one text.  They are thin: the plans behind them take any number of media.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cuewright import options as o
from cuewright.errors import MediaError, text_of
from cuewright.operators import media as guards
from cuewright.operators import sampling
from cuewright.operators.align import in_window
from cuewright.operators.frames import FrameProvider, frame_images, grid_images
from cuewright.options import GridOptions
from cuewright.plans import render, tools
from cuewright.sources import asr, files, subtitles, urls
from cuewright.sources.asr import Transcriber
from cuewright.sources.urls import Fetcher


# Wording of answers, which clients read.
EXTRACTED = "Extracted {} timestamped grid image(s)."
FROM_SUBTITLES = "\n--- TRANSCRIPT (from subtitles) ---\n"


def answers(run: Callable) -> Callable:
    """Any failure becomes an error answer."""

    @wraps(run)
    def answer(*args: object, **kwargs: object) -> dict:
        try:
            return {"content": run(*args, **kwargs)}
        except Exception as bad:  # noqa: BLE001
            return {"isError": True, "content": [{"type": "text", "text": text_of(bad)}]}

    return answer


def _text(text: str) -> dict:
    return {"type": "text", "text": text}


def _image(data: bytes) -> dict:
    return {"type": "image", "data": base64.b64encode(data).decode(), "mimeType": "image/jpeg"}


def _is_url(path: str) -> bool:
    return path.strip().lower().startswith(("http://", "https://"))


def _local(path: str, cache: str | None, fetcher: Fetcher | None, audio: bool = False) -> str:
    if not _is_url(path):
        return path
    if cache is None:
        raise MediaError("YT_DLP_NOT_FOUND", "a URL needs a cache folder and a downloader")
    return urls.local_path(path.strip(), cache, fetcher or urls.CommandFetcher(), audio)


def _raise(row: object) -> None:
    if row is not None and row["error"] is not None:
        raise MediaError(row["error"]["code"], row["error"]["message"])


def _probed(spark: SparkSession, path: str, tool: str, most_sec: int | None = None):
    """A one-row frame of a medium that passed its guards."""
    [absolute] = files.expand_paths([path]) if not files.is_glob(path) else [path]
    probed = files.probe(files.paths_frame(spark, [absolute])).cache()
    _raise(probed.first())
    medium = probed.select(F.lit("0").alias("media_id"), "info.*")
    checked = guards.preflight(medium, tool, most_sec if most_sec is not None else 1 << 60)
    _raise(checked.first())
    return medium


class Answer(tools.Payload):
    """A payload whose image items carry their data."""

    def add_image(self, data: bytes) -> bool:
        item = _image(data)
        if not self._fits(self.image_size(len(item["data"]))):
            return False
        self._add(item, self.image_size(len(item["data"])))
        return True

    def text(self, text: str, force: bool = False) -> bool:
        size = self.text_size(text)
        if not force and not self._fits(size):
            return False
        self._add(_text(text), size)
        return True

    def finish(self, what: str) -> list[dict]:
        images = sum(len(i["data"]) for i in self.items if i["type"] == "image")
        self.text(f"Payload: {self.length} chars total, {images} base64 image chars.", force=True)
        if self.length > self.most:
            bad = self.error(f"The final {what} payload exceeds the budget")
            raise MediaError(bad["code"], bad["message"])
        return self.items

    def fail(self, what: str, size: int) -> None:
        bad = self.error(what, self.length + size)
        raise MediaError(bad["code"], bad["message"])


@answers
def probe_media(spark: SparkSession, paths: str | list[str], max_files: int | None = None, cache: str | None = None, fetcher: Fetcher | None = None) -> list[dict]:
    """A report on the metadata of files, patterns and URLs; a file that can't be read is reported like the others."""
    entries = [paths] if isinstance(paths, str) else list(paths)
    expanded = files.expand_paths([_local(p, cache, fetcher) for p in entries])
    limit = o.probe_limit(max_files)
    if len(expanded) > limit:
        raise MediaError("INVALID_SAMPLING", f"{len(expanded)} files, but at most {limit} are probed at once ({o.MOST_PROBE_FILES} with max_files)")
    probed = files.probe(files.paths_frame(spark, expanded), partitions=min(len(expanded), spark.sparkContext.defaultParallelism))
    reports = probed.select("ordinal", F.col("error").isNull().alias("ok"), render.file_report(render.media_block(F.col("info")), "path", F.col("error")).alias("report")).orderBy("ordinal").collect()
    good = sum(r["ok"] for r in reports)
    return [_text(f"Probed {len(reports)} file(s): {good} succeeded, {len(reports) - good} failed.\n\n" + "\n\n".join(r["report"] for r in reports).strip())]


def _segments(spark: SparkSession, path: str, transcriber: Transcriber | None, model: str | None):
    """Segments of one local file; raises what its transcription raised."""
    done = asr.transcribe(spark.createDataFrame([("0", path)], "media_id string, path string"), transcriber, model).cache()
    _raise(done.first())
    return asr.segment_rows(done)


@answers
def get_transcript(
    spark: SparkSession,
    path: str,
    format: str | None = None,  # noqa: A002
    start_sec: float | None = None,
    end_sec: float | None = None,
    max_chars: int | None = None,
    model: str | None = None,
    transcriber: Transcriber | None = None,
    cache: str | None = None,
    fetcher: Fetcher | None = None,
) -> list[dict]:
    """What is said in a medium, as text, SRT or JSON. Subtitles of a URL come before listening to it."""
    most = max_chars if max_chars is not None else o.setting("MAX_CHARS", o.DEFAULT_TRANSCRIPT_CHARS)
    kind = o.transcript_format(format)
    found = urls.fetch(path.strip(), "subs", cache, fetcher or urls.CommandFetcher()) if _is_url(path) and cache else None
    if found is not None:
        segments = subtitles.read(spark, found).withColumn("media_id", F.lit("0"))
    else:
        local = _local(path, cache, fetcher, audio=True)
        _probed(spark, local, "get_transcript", o.MAX_DURATION_TRANSCRIPT_SEC)
        segments = _segments(spark, local, transcriber, model)
    text = render.transcripts(in_window(segments, start_sec, end_sec), kind, most).first()
    return [_text(text["text"] if text is not None else render.no_speech(start_sec, end_sec))]


def _grids(medium, opts: GridOptions, provider: FrameProvider | None):
    rows = grid_images(sampling.plan(medium, opts), provider, opts.aspect_mode).orderBy("grid_idx").collect()
    for row in rows:
        _raise(row)
    return rows


def _grid_text(row: object, index: int, total: int) -> str:
    from cuewright.functions.text import _fixed
    from cuewright.operators.frames import _label

    times = ", ".join(_label(t) for t in row["timestamps_sec"])
    return f"Grid {index}/{total} covers {_fixed(row['grid_start_sec'], 3)}s-{_fixed(row['grid_end_sec'], 3)}s. Tile timestamps: {times}"


@answers
def get_video_grids(spark: SparkSession, path: str, options: GridOptions | None = None, max_total_chars: int | None = None, provider: FrameProvider | None = None, cache: str | None = None, fetcher: Fetcher | None = None) -> list[dict]:
    """Grids of frames over a window. Asked for a number of grids, all must fit; else as many as do."""
    opts = options or GridOptions()
    medium = _probed(spark, _local(path, cache, fetcher), "get_video_grids")
    rows = _grids(medium, opts, provider)
    if not rows:
        return [_text("No grid frames found: shorten the window, or ask for shorter spans.")]
    answer = Answer(max_total_chars if max_total_chars is not None else o.DEFAULT_TOTAL_CHARS)
    answer.text(EXTRACTED.format(len(rows)), force=True)
    for k, row in enumerate(rows):
        fits = answer.text(_grid_text(row, k + 1, len(rows)))
        if not (fits and answer.add_image(row["image"])):
            if opts.max_grids is not None:
                answer.fail(f"Grid {k + 1} of {len(rows)} exceeds the budget", answer.image_size(len(row["image"]) * 4 // 3))
            if fits:
                answer.drop()
            break
    return answer.finish("get_video_grids")


@answers
def get_frames(spark: SparkSession, path: str, timestamps: list[float], max_total_chars: int | None = None, provider: FrameProvider | None = None, cache: str | None = None, fetcher: Fetcher | None = None) -> list[dict]:
    """Single frames, in the order asked for; all must fit."""
    times = o.frame_times(timestamps)
    medium = _probed(spark, _local(path, cache, fetcher), "get_frames")
    if medium.first()["type"] != "video":
        raise MediaError("NO_VIDEO_STREAM", f"no video stream in {path}")
    wanted = medium.select("path", "duration_sec", F.posexplode(F.array(*(F.lit(float(t)) for t in times))).alias("ordinal", "timestamp_sec"))
    rows = frame_images(wanted, provider).withColumn("label", render.frame_label("timestamp_sec")).orderBy("ordinal").collect()
    answer = Answer(max_total_chars if max_total_chars is not None else o.DEFAULT_TOTAL_CHARS)
    for row in rows:
        _raise(row)
        if not (answer.text(row["label"]) and answer.add_image(row["image"])):
            answer.fail(f"{len(times)} frame(s) exceed the budget", answer.image_size(len(row["image"]) * 4 // 3))
    return answer.finish("get_frames")


@answers
def understand_media(
    spark: SparkSession,
    path: str,
    options: GridOptions | None = None,
    max_total_chars: int | None = None,
    model: str | None = None,
    transcriber: Transcriber | None = None,
    provider: FrameProvider | None = None,
    cache: str | None = None,
    fetcher: Fetcher | None = None,
) -> list[dict]:
    """Metadata, transcript and pictures of one medium, interleaved by time, within a budget."""
    local = _local(path, cache, fetcher)
    medium = _probed(spark, local, "understand_media", o.MAX_DURATION_FULL_SEC)
    info = medium.first()
    most = max_total_chars if max_total_chars is not None else o.DEFAULT_TOTAL_CHARS
    pictures: dict[int | None, bytes] = {}
    segments = spark.createDataFrame([], "media_id string, seg_idx int, start_ms double, end_ms double, text string")
    windows = spark.createDataFrame([], "media_id string, grid_idx int, start_sec double, end_sec double, timestamps_sec array<double>, image_size int")
    if info["type"] in ("audio", "video"):
        segments = _segments(spark, local, transcriber, model)
    if info["type"] == "video":
        rows = _grids(medium, options or GridOptions(), provider)
        pictures = {r["grid_idx"]: r["image"] for r in rows}
        windows = spark.createDataFrame([("0", r["grid_idx"], r["grid_start_sec"], r["grid_end_sec"], list(r["timestamps_sec"]), len(r["image"])) for r in rows], windows.schema)
    if info["type"] == "image":
        from cuewright.functions import images

        with open(info["path"], "rb") as f:
            pictures[None] = images.encode_jpeg(images.shrink(images.decode(f.read())), 75)
        windows = spark.createDataFrame([("0", 0, 0.0, 0.0, [], len(pictures[None]))], windows.schema)
    row = tools.understand_content(medium, segments, windows, most, F.col("image_size")).first()
    _raise(row)
    return [_text(i["text"]) if i["type"] == "text" else _image(pictures[i["grid_idx"]]) for i in row["content"]]


@answers
def fetch_video(spark: SparkSession, url: str, cache: str, include_subtitles: bool = True, include_video: bool = False, include_audio: bool = False, include_thumbnail: bool = False, fetcher: Fetcher | None = None) -> list[dict]:
    """Metadata and files of a URL, with its subtitles as a transcript."""
    fetcher = fetcher or urls.CommandFetcher()
    dumped = spark.createDataFrame([(fetcher.metadata(url), url)], "json string, url string")
    subs = urls.fetch(url, "subs", cache, fetcher) if include_subtitles else None
    info = urls.parse_metadata(dumped, "json", "url").withColumn("_subs", F.lit(subs).cast("string"))
    lines = [info.select(render.video_report("_subs" if include_subtitles else None).alias("t")).first()["t"]]
    for kind, wanted, name in (("thumb", include_thumbnail, "Thumbnail"), ("video", include_video, "Video"), ("audio", include_audio, "Audio")):
        if wanted:
            lines.append(f"{name}: {urls.fetch(url, kind, cache, fetcher)}")
    out = [_text("\n".join([*lines, "", "These paths can be given to the other tools."]))]
    if subs is not None:
        segments = subtitles.read(spark, subs).withColumn("media_id", F.lit("0"))
        text = render.transcripts(segments, "text", o.setting("MAX_CHARS", o.DEFAULT_TRANSCRIPT_CHARS)).first()
        if text is not None:
            out.append(_text(FROM_SUBTITLES + text["text"]))
    return out


#: What each tool is for, for clients that list them.
DESCRIPTIONS = {
    "probe_media": "Metadata of many files, read from their headers.",
    "understand_media": "Transcript and frame grids of one file, interleaved by time.",
    "get_video_grids": "Frame grids of a part of a video.",
    "get_frames": "Frames at exact times.",
    "get_transcript": "What is said, as text, SRT or JSON.",
    "fetch_video": "Metadata, subtitles and files of a URL.",
}


def available_tools(fetcher: urls.CommandFetcher | None = None) -> list[str]:
    """Names of the tools that work here; the one for URLs needs a downloader."""
    with_urls = (fetcher or urls.CommandFetcher()).available()
    return [name for name in DESCRIPTIONS if with_urls or name != "fetch_video"]
