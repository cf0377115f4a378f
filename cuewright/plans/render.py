"""Renderers: transcripts as text, SRT or JSON, media blocks, grid and frame labels, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import CUT_MARK, col, cut_middle, fixed1, round_half_up, short_duration, size_label, srt_timestamp, strip, timestamp_label, to_fixed, utf16_length

#: Wording of labels that other programs read.
SAMPLING_NOTE = " grid image(s), each tile has an exact timestamp overlay."
LAYOUT_NOTE = "Output format: transcript segments are interleaved with their corresponding visual grids by time alignment."
NO_SPEECH = "No speech detected"
#: Lines of an entity that are summed together before a total is known.
BLOCK_LINES = 1024


def segment_line(start: Column | str = "start_ms", end: Column | str = "end_ms", text: Column | str = "text") -> Column:
    """``[12.3–15.0] words``: seconds to one decimal, trimmed text. A null text says nothing."""
    return F.concat(F.lit("["), fixed1(col(start) / 1000), F.lit("–"), fixed1(col(end) / 1000), F.lit("] "), strip(F.coalesce(col(text), F.lit(""))))


def srt_block(start: Column | str = "start_ms", end: Column | str = "end_ms", text: Column | str = "text") -> Column:
    """An SRT cue without its number."""
    return F.concat(srt_timestamp(start), F.lit(" --> "), srt_timestamp(end), F.lit("\n"), strip(F.coalesce(col(text), F.lit(""))))


def json_string(text: Column) -> Column:
    """A text as a JSON string, with its quotes."""
    json = F.to_json(F.struct(text.alias("t")))
    return json.substr(F.lit(6), F.length(json) - 6)


def json_entry(start: Column | str = "start_ms", end: Column | str = "end_ms", text: Column | str = "text") -> Column:
    """A segment as it stands in the pretty-printed list of segments."""
    return F.concat(
        F.lit('    {\n      "start": '), round_half_up(start).cast("string"), F.lit(',\n      "end": '), round_half_up(end).cast("string"), F.lit(',\n      "text": '), json_string(strip(F.coalesce(col(text), F.lit("")))), F.lit("\n    }")
    )


def join_lines(df: DataFrame, entity: str, order: str, line: str, glue: str, most: int, head: str = "", foot: str = "", numbered: bool = False, block: int = BLOCK_LINES, utf16: bool = True, whole: bool = True) -> DataFrame:
    """Lines of each entity, in order, as one text of at most ``most`` characters but for the mark where the middle is cut.

    ``entity, n_lines, text``.  Lines are measured in blocks of positions first; only blocks
    that reach into the first or last ``most`` characters are collected, so an
    entity with any number of lines costs no more than the text it makes.
    ``numbered`` puts the running number and a line feed before each line.
    Lengths are in UTF-16 units, or code points.  Without ``whole`` the result is
    ``entity, n_lines, a, b, n``: as much of the beginning and of the end as may be
    needed, and the length of it all, for a cut that is decided later.
    """
    measure = utf16_length if utf16 else F.length
    rows = df.where(F.col(line).isNotNull()).select(F.col(entity).alias("e"), F.col(order).cast("long").alias("o"), F.col(line).alias("line")).withColumn("k", F.floor(F.col("o") / block))
    sized = rows.withColumn("size", measure("line").cast("long") + len(glue))
    sums = sized.groupBy("e", "k").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("e").orderBy("k")
    everything = Window.partitionBy("e")
    digits = 12 if numbered else 0  # what a number may add, for what is kept
    blocks = sums.select(
        "e",
        "k",
        (F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"),
        (F.coalesce(F.sum("size").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))).alias("after"),
        (F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("n_before"),
        F.sum("n").over(everything).alias("n_lines"),
        F.sum("size").over(everything).alias("total"),
    )
    kept = sized.join(blocks.where((F.col("before") <= most) | (F.col("after") <= most)), ["e", "k"])
    inside = Window.partitionBy("e", "k").orderBy("o", "line")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    in_block = F.sum("size").over(Window.partitionBy("e", "k"))
    placed = kept.withColumn("from", F.col("before") + upto - F.col("size")).withColumn("rest", F.col("after") + in_block - upto).withColumn("i", F.col("n_before") + F.row_number().over(inside))
    near = placed.where((F.col("from") <= most) | (F.col("rest") <= most))
    body = F.concat(F.col("i").cast("string"), F.lit("\n"), F.col("line")) if numbered else F.col("line")
    item = F.struct("i", body.alias("line"))
    grouped = near.groupBy("e").agg(
        F.first("n_lines").alias("n_lines"),
        F.first("total").alias("total"),
        F.collect_list(F.when(F.col("from") <= most, item)).alias("first"),
        F.collect_list(F.when(F.col("rest") <= most, item)).alias("last"),
    )
    joined = lambda name: F.array_join(F.transform(F.array_sort(name), lambda x: x["line"]), glue)
    # Numbers take digits + 1 characters each; how many there are of each length follows from the count.
    extra = sum((F.greatest(F.lit(0).cast("long"), F.col("n_lines") - (10**d - 1)) for d in range(1, digits)), F.col("n_lines") * 2) if numbered else F.lit(0)
    total = F.col("total") - len(glue) + len(head) + len(foot) + extra
    texts = grouped.select(F.col("e").alias(entity), "n_lines", F.concat(F.lit(head), joined("first")).alias("a"), F.concat(joined("last"), F.lit(foot)).alias("b"), total.cast("long").alias("n"))
    if not whole:
        return texts
    uncut = F.when(F.col("n") <= most, F.concat("a", F.lit(foot)))
    if utf16:
        return texts.select(entity, "n_lines", F.coalesce(uncut, cut_middle("a", "b", "n", F.lit(most))).alias("text"))
    keep = most * 6 // 10
    cut = F.concat(F.substring("a", 1, keep), F.lit(CUT_MARK), F.right("b", F.lit(most - keep)))
    return texts.select(entity, "n_lines", F.coalesce(uncut, cut).alias("text"))


def transcripts(segments: DataFrame, kind: str = "text", most: int = 32_000, entity: str = "media_id", position: str = "seg_idx", utf16: bool = True) -> DataFrame:
    """``entity, n_lines, text``: the transcript of each medium as 'text', 'srt' or 'json', its middle cut to ``most`` characters.

    A JSON text that is cut is no valid JSON any more, as it is no longer whole.
    Segments with null bounds have no line.
    """
    line = {"text": segment_line, "srt": srt_block, "json": json_entry}[kind]()
    rows = segments.withColumn("_line", line)
    if kind == "json":
        return join_lines(rows, entity, position, "_line", ",\n", most, '{\n  "segments": [\n', "\n  ]\n}", utf16=utf16)
    if kind == "srt":
        return join_lines(rows, entity, position, "_line", "\n\n", most, numbered=True, utf16=utf16)
    return join_lines(rows, entity, position, "_line", "\n", most, utf16=utf16)


def plain_transcripts(segments: DataFrame, most: int = 32_000, entity: str = "media_id", position: str = "seg_idx", utf16: bool = True) -> DataFrame:
    """``entity, n_lines, text``: all texts of a medium in order, with blanks between, cut in the middle."""
    return join_lines(segments.withColumn("_line", F.coalesce("text", F.lit(""))), entity, position, "_line", " ", most, utf16=utf16)


def media_block(info: Column | None = None) -> Column:
    """Label lines of a medium; what is null has no line. Reads the columns of ``MEDIA_INFO`` (or the struct ``info``)."""
    c = (lambda name: info[name]) if info is not None else F.col
    line = lambda label, value, unit="": F.concat(F.lit(label), value.cast("string"), F.lit(unit))
    named = lambda label, name: F.when(F.length(c(name)) > 0, line(label, c(name)))
    return F.concat_ws(
        "\n",
        line("File: ", c("path")),
        line("Type: ", c("type")),
        F.concat(F.lit("Duration: "), fixed1(c("duration_sec")), F.lit("s")),
        F.concat(F.lit("Resolution: "), c("width").cast("string"), F.lit("x"), c("height").cast("string")),
        F.concat(F.lit("FPS: "), to_fixed(c("fps"), 2)),
        named("Video codec: ", "video_codec"),
        named("Audio codec: ", "audio_codec"),
        line("Sample rate: ", c("sample_rate"), "Hz"),
        line("Channels: ", c("channels")),
        line("Size: ", c("file_size_bytes"), " bytes"),
        F.concat(F.lit("Acceleration: "), c("acceleration")["backend"], F.when(c("acceleration")["hardware"], " (hardware)").otherwise(" (software)")),
    )


def understand_block(n_grids: Column | str) -> Column:
    """The block at the head of an analysis: zeros have no line either, acceleration has none, grids have two."""
    n_grids, some = col(n_grids), lambda name: F.nullif(F.col(name), F.lit(0))
    line = lambda label, value, unit="": F.concat(F.lit(label), value.cast("string"), F.lit(unit))
    named = lambda label, name: F.when(F.length(F.col(name)) > 0, line(label, F.col(name)))
    has = (F.col("type") == "video") & (n_grids > 0)
    return F.concat_ws(
        "\n",
        line("File: ", F.col("path")),
        line("Type: ", F.col("type")),
        F.concat(F.lit("Duration: "), fixed1("duration_sec"), F.lit("s")),
        F.concat(F.lit("Resolution: "), some("width").cast("string"), F.lit("x"), F.col("height").cast("string")),
        F.concat(F.lit("FPS: "), to_fixed(some("fps"), 2)),
        named("Video codec: ", "video_codec"),
        named("Audio codec: ", "audio_codec"),
        line("Sample rate: ", some("sample_rate"), "Hz"),
        line("Channels: ", some("channels")),
        line("Size: ", F.col("file_size_bytes"), " bytes"),
        F.when(has, F.concat(F.lit("Video sampling: "), n_grids.cast("string"), F.lit(SAMPLING_NOTE))),
        F.when(has, F.lit(LAYOUT_NOTE)),
    )


def grid_label(index: Column, total: Column, start_sec: Column | str, end_sec: Column | str, times: Column | str) -> Column:
    """``Grid 1/6 covers 0.000s-10.000s. Tile timestamps: ...``"""
    tiles = F.array_join(F.transform(col(times), timestamp_label), ", ")
    return F.concat(F.lit("Grid "), index.cast("string"), F.lit("/"), total.cast("string"), F.lit(" covers "), to_fixed(start_sec, 3), F.lit("s-"), to_fixed(end_sec, 3), F.lit("s. Tile timestamps: "), tiles)


def frame_label(time: Column | str) -> Column:
    return F.concat(F.lit("Frame at "), timestamp_label(time), F.lit(" ("), to_fixed(time, 3), F.lit("s)"))


def file_report(info_block: Column, path: Column | str, problem: Column) -> Column:
    """A file's block, or its path and what went wrong."""
    bad = F.concat(F.lit("File: "), col(path), F.lit("\nError: ["), problem["code"], F.lit("] "), problem["message"])
    return F.when(problem.isNull(), info_block).otherwise(bad)


def probe_summary(n: Column | str, ok: Column | str, failed: Column | str) -> Column:
    return F.concat(F.lit("Probed "), col(n).cast("string"), F.lit(" file(s): "), col(ok).cast("string"), F.lit(" succeeded, "), col(failed).cast("string"), F.lit(" failed."))


def cli_line() -> Column:
    """``[Video] 2m15s 1920x1080 h264/aac 1.5 MB`` of a row of ``MEDIA_INFO``."""
    both = F.when((F.length("video_codec") > 0) & (F.length("audio_codec") > 0), F.concat("video_codec", F.lit("/"), "audio_codec")).when(F.length("audio_codec") > 0, F.col("audio_codec"))
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), F.initcap("type"), F.lit("]")),
        F.when(F.col("type") != "image", short_duration("duration_sec")),
        F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")),
        both,
        size_label("file_size_bytes"),
    )


def no_speech(start_sec: float | None = None, end_sec: float | None = None) -> str:
    """What stands for a transcript without segments."""
    number = lambda x: f"{x:g}" if x == int(x) else repr(x)
    window = "" if start_sec is None and end_sec is None else f" in the requested window ({number(start_sec or 0)}s–{'end' if end_sec is None else number(end_sec)})"
    return f"{NO_SPEECH}{window}."


def video_report(subtitles: Column | str | None = None) -> Column:
    """Report lines of a video from a URL: title, duration, uploader, URL, and which subtitles there are."""
    listed = F.array_join(F.filter(F.coalesce("subtitle_languages", F.array().cast("array<string>")), lambda x: x.isNotNull()), ", ")
    languages = F.when(F.length(listed) > 0, listed).otherwise("auto-generated")
    lines = [
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Duration: "), F.coalesce(F.regexp_replace(F.col("duration_sec").cast("string"), r"\.0$", ""), F.lit("0")), F.lit("s")),
        F.concat(F.lit("Uploader: "), F.coalesce("uploader", F.lit(""))),
        F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))),
        F.lit(""),
    ]
    if subtitles is not None:
        path = col(subtitles)
        lines += [F.when(path.isNotNull(), F.concat(F.lit("Subtitles: "), path)).otherwise("Subtitles: none available"), F.when(path.isNotNull(), F.concat(F.lit("Subtitle languages available: "), languages))]
    return F.concat_ws("\n", *lines)
