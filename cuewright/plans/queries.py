"""Queries of the core operators by name, with the SQL that checks them.

Every query runs over whole tables.  Columns that both sides compute carry the
same names and widths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import text as t
from cuewright.functions.register import register
from cuewright.operators import align, asof, budget, intervals, media, sampling
from cuewright.operators.latest import latest, latest_in_blocks
from cuewright.options import GridOptions
from cuewright.plans import render, tools
from cuewright.sources import files, subtitles, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments in their current version (of rows that tie on it, which are identical, one)."""
    return latest_in_blocks(table(spark, folder, "segments"), "media_id", "seg_idx", "ingested_at").drop("block")


def current_media(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "media_info"), ["media_id"], "probed_at", ["file_path"])


def current_videos(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "videos"), ["media_id"], "fetched_at", ["title"])


def current_results(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "understand_results"), ["media_id"], "created_at", ["transcript"])


# ------------------------------------------------------------------ SQL shared by the checks

CURRENT = """current AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY ingested_at DESC) AS rn
  FROM segments WHERE media_id IS NOT NULL AND seg_idx IS NOT NULL) WHERE rn = 1)"""
MEDIA = """media AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY probed_at DESC NULLS LAST, file_path DESC NULLS LAST) AS rn FROM media_info) WHERE rn = 1)"""
VIDEOS = """vids AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY fetched_at DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM videos) WHERE rn = 1)"""
RESULTS = """results AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY created_at DESC NULLS LAST, transcript DESC NULLS LAST) AS rn FROM understand_results) WHERE rn = 1)"""


def fixed_sql(x: str) -> str:
    """One decimal, halves up: printf rounds exact halves (quarters of a unit) to even, so they are nudged."""
    return f"(CASE WHEN ({x}) * 4 = floor(({x}) * 4) AND (({x}) * 4) % 2 = 1 THEN printf('%.1f', ({x}) + 0.01) ELSE printf('%.1f', {x}) END)"


def clock_sql(ms: str, point: str) -> str:
    two = lambda v: f"(CASE WHEN {v} < 100 THEN lpad(CAST({v} AS VARCHAR), 2, '0') ELSE CAST({v} AS VARCHAR) END)"
    return f"({two(f'({ms} // 3600000)')} || ':' || {two(f'(({ms} % 3600000) // 60000)')} || ':' || {two(f'(({ms} % 60000) // 1000)')} || '{point}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


LINE = f"'[' || {fixed_sql('start_ms / 1000')} || '–' || {fixed_sql('end_ms / 1000')} || '] ' || {strip_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}"
CUT = "chr(10) || chr(10) || '[…transcript truncated…]' || chr(10) || chr(10)"
SRT_START, SRT_END = (f"greatest(0, CAST(floor({c} + 0.5) AS BIGINT))" for c in ("start_ms", "end_ms"))


def cut_sql(x: str, most: int) -> str:
    keep = most * 6 // 10
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE substring({x}, 1, {keep}) || {CUT} || right({x}, {most - keep}) END"


def cut16_sql(x: str, most: int | str) -> str:
    """``cut_sql`` in UTF-16 units: a list of units, in which a character of two is followed by an empty text; a half at the cut goes."""
    keep, units = f"(({most}) * 6 // 10)", f"list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [c, ''] ELSE [c] END)"
    return f"""(SELECT CASE WHEN len(u) <= {most} THEN array_to_string(u, '') ELSE array_to_string(u[1:CASE WHEN u[{keep} + 1] = '' THEN {keep} - 1 ELSE {keep} END], '') || {CUT} || array_to_string(u[len(u) - (({most}) - {keep}) + 1:], '') END FROM (SELECT flatten({units}) AS u))"""


OVERLAP = "greatest(0.0, least(s.end_ms, g.end_sec * 1000) - greatest(s.start_ms, g.start_sec * 1000))"
ASSIGNED = f"""{CURRENT}, pairs AS (SELECT s.media_id, s.seg_idx, g.grid_idx, {OVERLAP} AS ov FROM current s JOIN grid_windows g USING (media_id)
  WHERE s.start_ms IS NOT NULL AND s.end_ms IS NOT NULL),
best AS (SELECT media_id, seg_idx, grid_idx, ov FROM (SELECT *, row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY ov DESC, grid_idx) AS rk FROM pairs WHERE ov > 0) WHERE rk = 1),
assigned AS (SELECT c.media_id, c.seg_idx, b.grid_idx, coalesce(b.ov, 0.0) AS overlap_ms FROM current c LEFT JOIN best b ON b.media_id = c.media_id AND b.seg_idx = c.seg_idx)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


# ------------------------------------------------------------------ intervals


@query(
    "p2_found",
    f"""WITH {CURRENT},
spans AS (SELECT media_id, CAST(floor(start_ms + 0.5) AS BIGINT) AS a, CAST(floor(end_ms + 0.5) AS BIGINT) AS b FROM current
  WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL AND isfinite(start_ms) AND isfinite(end_ms)),
reach AS (SELECT *, max(b) OVER (PARTITION BY media_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM spans WHERE b > a),
marked AS (SELECT *, sum(CASE WHEN upto IS NULL OR a - upto >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM reach),
periods AS (SELECT media_id, k, min(a) AS a, max(b) AS b FROM marked GROUP BY ALL),
holes AS (SELECT media_id, lag(b) OVER (PARTITION BY media_id ORDER BY a) AS a, a AS b FROM periods)
SELECT media_id, 'period' AS item_kind, a AS from_ms, b AS to_ms FROM periods
UNION ALL SELECT media_id, 'gap', a, b FROM holes WHERE b - a BETWEEN 500 AND 600000""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segments").select("media_id", "seg_idx", "start_ms", "end_ms", "ingested_at")
    current = latest_in_blocks(rows, "media_id", "seg_idx", "ingested_at")
    long = intervals.any_long(rows, "start_ms", "end_ms")  # asked before the shuffle: no current row is longer than all rows
    found = intervals.coverage(current, "media_id", "start_ms", "end_ms", join_below=500, max_gap=600_000, long=long)
    return found.select("media_id", "item_kind", "from_ms", "to_ms")


# ------------------------------------------------------------------ alignment


@query("segment_grid_assign", f"WITH {ASSIGNED} SELECT media_id, seg_idx, grid_idx, round(overlap_ms, 3) AS overlap_ms FROM assigned")
def segment_grid_assign(spark: SparkSession, folder: str) -> DataFrame:
    found = align.assign_to_windows(current_segments(spark, folder).select("media_id", "seg_idx", "start_ms", "end_ms"), table(spark, folder, "grid_windows"))
    return found.select("media_id", "seg_idx", "grid_idx", F.round("overlap_ms", 3).alias("overlap_ms"))


@query(
    "segments_per_grid",
    f"""WITH {ASSIGNED}, g AS (SELECT DISTINCT media_id, grid_idx FROM grid_windows)
SELECT g.media_id, g.grid_idx, CAST(a.seg_idx // 4096 AS INTEGER) AS block, CAST(count(a.seg_idx) AS BIGINT) AS n_segments, coalesce(string_agg(CAST(a.seg_idx AS VARCHAR), ',' ORDER BY a.seg_idx), '') AS positions
FROM g LEFT JOIN assigned a ON a.media_id = g.media_id AND a.grid_idx = g.grid_idx GROUP BY 1, 2, 3""",
)
def segments_per_grid(spark: SparkSession, folder: str) -> DataFrame:
    windows = table(spark, folder, "grid_windows")
    assigned = align.assign_to_windows(current_segments(spark, folder).select("media_id", "seg_idx", "start_ms", "end_ms"), windows)
    grouped = align.positions_by_window(assigned, windows)
    return grouped.select("media_id", "grid_idx", "block", F.size("positions").cast("long").alias("n_segments"), F.array_join("positions", ",").alias("positions"))


@query("segment_grid_assign_dense", f"WITH {ASSIGNED} SELECT media_id, seg_idx, grid_idx, round(overlap_ms, 3) AS overlap_ms FROM assigned")
def segment_grid_assign_dense(spark: SparkSession, folder: str) -> DataFrame:
    """The same in buckets of time, as for media with many windows."""
    found = align.assign_to_windows(current_segments(spark, folder).select("media_id", "seg_idx", "start_ms", "end_ms"), table(spark, folder, "grid_windows"), dense=True)
    return found.select("media_id", "seg_idx", "grid_idx", F.round("overlap_ms", 3).alias("overlap_ms"))


@query("unassigned_segments", f"WITH {ASSIGNED} SELECT media_id, seg_idx FROM assigned WHERE grid_idx IS NULL")
def unassigned_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = align.assign_to_windows(current_segments(spark, folder).select("media_id", "seg_idx", "start_ms", "end_ms"), table(spark, folder, "grid_windows"))
    return found.where("grid_idx IS NULL").select("media_id", "seg_idx")


@query("window_filter", f"WITH {CURRENT} SELECT media_id, seg_idx, start_ms, end_ms FROM current WHERE start_ms < 600000 AND end_ms > 60000")
def window_filter(spark: SparkSession, folder: str) -> DataFrame:
    return align.in_window(current_segments(spark, folder), 60, 600).select("media_id", "seg_idx", "start_ms", "end_ms")


# ------------------------------------------------------------------ sampling and frames

_PLAN_SQL = f"""WITH {MEDIA}, m AS (SELECT media_id, duration_sec, CASE WHEN height > width THEN 3 ELSE 4 END AS c FROM media
  WHERE type = 'video' AND duration_sec > 0 AND isfinite(duration_sec)),
grids AS (SELECT *, CAST(unnest(range(6)) AS INTEGER) AS grid_idx FROM m),"""


@query(
    "sampling_plan",
    _PLAN_SQL.replace("type =", "media_type =")
    + """frames AS (SELECT *, unnest(range(c * c)) AS k FROM grids)
SELECT media_id, grid_idx, CAST(k AS INTEGER) AS frame_idx, round(least(greatest(grid_idx * (duration_sec / 6) + k * (duration_sec / 6 / (c * c)) + duration_sec / 6 / (c * c) / 2, 0), greatest(0, duration_sec - 0.001)), 9) AS timestamp_sec FROM frames""",
)
def sampling_plan(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampling.plan(current_media(spark, folder).withColumnRenamed("media_type", "type")).where("error IS NULL")
    frames = rows.select("media_id", "grid_idx", F.posexplode("timestamps_sec").alias("frame_idx", "timestamp_sec"))
    return frames.withColumn("timestamp_sec", F.round("timestamp_sec", 9))


@query(
    "sampling_scene",
    f"""WITH {MEDIA}, m AS (SELECT media_id, media_type, duration_sec, CASE WHEN height > width THEN 9 ELSE 16 END AS fpg FROM media)
SELECT media_id, CASE WHEN media_type IS NULL OR media_type <> 'video' THEN 'NO_VIDEO_STREAM' WHEN duration_sec IS NULL OR duration_sec <= 0 OR 5 * (duration_sec / 6) + fpg * 10 - duration_sec > 1e-6 THEN 'INVALID_SAMPLING' END AS code,
CAST(CASE WHEN media_type = 'video' AND duration_sec > 0 AND NOT (5 * (duration_sec / 6) + fpg * 10 - duration_sec > 1e-6) THEN 6 ELSE 0 END AS BIGINT) AS n_grids FROM m""",
)
def sampling_scene(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampling.plan(current_media(spark, folder).withColumnRenamed("media_type", "type"), GridOptions(sampling_strategy="scene"))
    return rows.groupBy("media_id").agg(F.first("error.code").alias("code"), F.count("grid_idx").alias("n_grids"))


@query(
    "sampling_options",
    f"""WITH {MEDIA} SELECT media_id, CAST(CASE WHEN height > width THEN 3 ELSE 4 END AS INTEGER) AS n_cols, CAST(CASE WHEN height > width THEN 3 ELSE 4 END AS INTEGER) AS n_rows,
CAST(CASE WHEN height > width THEN 120 ELSE 480 END AS INTEGER) AS thumb_width, CASE WHEN duration_sec IS NULL THEN 3600.0 ELSE least(3600.0, duration_sec) END AS end_sec FROM media""",
)
def sampling_options(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampling.normalise(current_media(spark, folder).withColumnRenamed("media_type", "type"), GridOptions(end_sec=3600))
    return rows.select("media_id", "n_cols", "n_rows", "thumb_width", "end_sec")


_TARGETS_SQL = f"""WITH {CURRENT}, {MEDIA}, frames AS (SELECT media_id, start_ms / 1000 AS pts FROM current WHERE start_ms IS NOT NULL),
targets AS (SELECT media_id, grid_idx, k AS frame_idx, round(least(greatest(grid_idx * (duration_sec / 6) + (k + 0.5) * (duration_sec / 96), 0), greatest(0, duration_sec - 0.2)), 3) AS at FROM
  (SELECT media_id, duration_sec, CAST(unnest(range(6)) AS INTEGER) AS grid_idx FROM media WHERE duration_sec > 0 AND media_type IN ('audio', 'video')), (SELECT CAST(unnest(range(16)) AS INTEGER) AS k))"""


@query(
    "frame_asof",
    _TARGETS_SQL
    + """ SELECT t.media_id, t.grid_idx, t.frame_idx, coalesce(a.pts, b.pts) AS frame_sec FROM targets t
ASOF LEFT JOIN (SELECT DISTINCT * FROM frames) a ON a.media_id = t.media_id AND a.pts >= t.at
ASOF LEFT JOIN (SELECT DISTINCT * FROM frames) b ON b.media_id = t.media_id AND b.pts < t.at""",
)
def frame_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of segments stand for frames: a point series per medium, with holes, repeats and a hot medium."""
    frames = current_segments(spark, folder).where("start_ms IS NOT NULL").select("media_id", (F.col("start_ms") / 1000).alias("pts_sec"))
    known = current_media(spark, folder).where("duration_sec > 0 AND media_type IN ('audio', 'video')").select("media_id", "duration_sec")
    grids = known.withColumn("grid_idx", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(15))))
    centre = F.greatest(F.col("grid_idx") * (F.col("duration_sec") / 6) + (F.col("frame_idx") + 0.5) * (F.col("duration_sec") / 96), F.lit(0.0))
    targets = asof.clamp_targets(grids.withColumn("timestamp_sec", centre)).withColumn("lookup_sec", F.round("lookup_sec", 3))
    return asof.frames_at(frames, targets).select("media_id", "grid_idx", "frame_idx", "frame_sec")


# ------------------------------------------------------------------ renderers


@query("transcript_text", f"WITH {CURRENT}, lines AS (SELECT media_id, seg_idx, {LINE} AS line FROM current), texts AS (SELECT media_id, count(line) AS n_lines, string_agg(line, chr(10) ORDER BY seg_idx) AS text FROM lines WHERE line IS NOT NULL GROUP BY 1) SELECT media_id, n_lines, {cut16_sql('text', 4000)} AS text FROM texts")
def transcript_text(spark: SparkSession, folder: str) -> DataFrame:
    return render.transcripts(current_segments(spark, folder), "text", 4000)


@query(
    "transcript_srt",
    f"""WITH {CURRENT}, cues AS (SELECT media_id, seg_idx, {clock_sql(SRT_START, ',')} || ' --> ' || {clock_sql(SRT_END, ',')} || chr(10) || {strip_sql("coalesce(text, '')")} AS cue FROM current WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
numbered AS (SELECT media_id, seg_idx, CAST(row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS VARCHAR) || chr(10) || cue AS cue FROM cues),
texts AS (SELECT media_id, count(*) AS n_lines, string_agg(cue, chr(10) || chr(10) ORDER BY seg_idx) AS text FROM numbered GROUP BY 1) SELECT media_id, n_lines, {cut16_sql('text', 4000)} AS text FROM texts""",
)
def transcript_srt(spark: SparkSession, folder: str) -> DataFrame:
    return render.transcripts(current_segments(spark, folder), "srt", 4000)


@query(
    "transcript_json",
    f"""WITH {CURRENT}, entries AS (SELECT media_id, seg_idx, '    {{' || chr(10) || '      "start": ' || CAST(CAST(floor(start_ms + 0.5) AS BIGINT) AS VARCHAR) || ',' || chr(10) || '      "end": ' || CAST(CAST(floor(end_ms + 0.5) AS BIGINT) AS VARCHAR) || ',' || chr(10) || '      "text": ' || CAST(to_json({strip_sql("coalesce(text, '')")}) AS VARCHAR) || chr(10) || '    }}' AS entry FROM current),
texts AS (SELECT media_id, count(entry) AS n_lines, '{{' || chr(10) || '  "segments": [' || chr(10) || string_agg(entry, ',' || chr(10) ORDER BY seg_idx) || chr(10) || '  ]' || chr(10) || '}}' AS text FROM entries WHERE entry IS NOT NULL GROUP BY 1)
SELECT media_id, n_lines, {cut16_sql('text', 4000)} AS text FROM texts""",
)
def transcript_json(spark: SparkSession, folder: str) -> DataFrame:
    return render.transcripts(current_segments(spark, folder), "json", 4000)


@query("plain_transcript", f"WITH {CURRENT}, texts AS (SELECT media_id, count(*) AS n_lines, string_agg(coalesce(text, ''), ' ' ORDER BY seg_idx) AS text FROM current GROUP BY 1) SELECT media_id, n_lines, {cut16_sql('text', 32000)} AS text FROM texts")
def plain_transcript(spark: SparkSession, folder: str) -> DataFrame:
    return render.plain_transcripts(current_segments(spark, folder), 32_000)


@query("truncate_middle", f"WITH {RESULTS} SELECT media_id, {cut_sql('transcript', 1000)} AS text FROM results")
def truncate_middle(spark: SparkSession, folder: str) -> DataFrame:
    return current_results(spark, folder).select("media_id", t.truncate_middle("transcript", 1000).alias("text"))


@query("truncate_middle_utf16", f"WITH {RESULTS} SELECT media_id, {cut16_sql('transcript', 1001)} AS text FROM results")
def truncate_middle_utf16(spark: SparkSession, folder: str) -> DataFrame:
    """The same in UTF-16 units, which is what limits of payloads are in."""
    return current_results(spark, folder).select("media_id", t.cut_middle("transcript", "transcript", t.utf16_length("transcript"), F.lit(1001)).alias("text"))


@query("transcript_text_points", f"WITH {CURRENT}, lines AS (SELECT media_id, seg_idx, {LINE} AS line FROM current), texts AS (SELECT media_id, count(line) AS n_lines, string_agg(line, chr(10) ORDER BY seg_idx) AS text FROM lines WHERE line IS NOT NULL GROUP BY 1) SELECT media_id, n_lines, {cut_sql('text', 1500)} AS text FROM texts")
def transcript_text_points(spark: SparkSession, folder: str) -> DataFrame:
    """A transcript cut in code points, which takes no Python."""
    return render.transcripts(current_segments(spark, folder), "text", 1500, utf16=False)


_BLOCK_SQL = f"""concat_ws(chr(10), 'File: ' || file_path, 'Type: ' || media_type, 'Duration: ' || {fixed_sql('duration_sec')} || 's', 'Resolution: ' || width || 'x' || height, 'FPS: ' || printf('%.2f', fps),
  'Video codec: ' || nullif(video_codec, ''), 'Audio codec: ' || nullif(audio_codec, ''), 'Sample rate: ' || sample_rate || 'Hz', 'Channels: ' || channels, 'Size: ' || file_size_bytes || ' bytes'"""


@query("media_block", f"WITH {MEDIA} SELECT media_id, {_BLOCK_SQL}, 'Acceleration: ' || acceleration.backend || CASE WHEN acceleration.hardware THEN ' (hardware)' ELSE ' (software)' END) AS block FROM media WHERE error_code IS NULL")
def media_block(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_media(spark, folder).where("error_code IS NULL").withColumnsRenamed({"media_type": "type", "file_path": "path"})
    return rows.select("media_id", render.media_block().alias("block"))


@query(
    "understand_block",
    f"""WITH {MEDIA}, n AS (SELECT media_id, count(*) AS n FROM grid_windows GROUP BY 1)
SELECT m.media_id, {_BLOCK_SQL.replace('|| width', '|| nullif(width, 0)').replace("printf('%.2f', fps)", "printf('%.2f', nullif(fps, 0))").replace('|| sample_rate', '|| nullif(sample_rate, 0)').replace('|| channels', '|| nullif(channels, 0)')},
CASE WHEN media_type = 'video' AND n.n > 0 THEN 'Video sampling: ' || n.n || ' grid image(s), each tile has an exact timestamp overlay.' || chr(10) || 'Output format: transcript segments are interleaved with their corresponding visual grids by time alignment.' END) AS block
FROM media m LEFT JOIN n ON n.media_id = m.media_id WHERE error_code IS NULL""",
)
def understand_block(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_media(spark, folder).where("error_code IS NULL").withColumnsRenamed({"media_type": "type", "file_path": "path"})
    counts = table(spark, folder, "grid_windows").groupBy("media_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts, "media_id", "left").select("media_id", render.understand_block("_n").alias("block"))


@query(
    "grid_labels",
    f"""SELECT media_id, grid_idx, 'Grid ' || (grid_idx + 1) || '/' || n || ' covers ' || printf('%.3f', start_sec) || 's-' || printf('%.3f', end_sec) || 's. Tile timestamps: ' || {clock_sql('CAST(floor(start_sec * 1000 + 0.5) AS BIGINT)', '.')} || ', ' || {clock_sql('CAST(floor((start_sec + end_sec) / 2 * 1000 + 0.5) AS BIGINT)', '.')} AS label
FROM (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM grid_windows)""",
)
def grid_labels(spark: SparkSession, folder: str) -> DataFrame:
    windows = table(spark, folder, "grid_windows")
    counts = windows.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    times = F.array(F.col("start_sec"), (F.col("start_sec") + F.col("end_sec")) / 2)
    return windows.join(counts, "media_id").select("media_id", "grid_idx", render.grid_label(F.col("grid_idx") + 1, F.col("n"), "start_sec", "end_sec", times).alias("label"))


@query("frame_labels", f"SELECT media_id, grid_idx, 'Frame at ' || {clock_sql('CAST(floor(start_sec * 1000 + 0.5) AS BIGINT)', '.')} || ' (' || printf('%.3f', start_sec) || 's)' AS label FROM grid_windows")
def frame_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "grid_windows").select("media_id", "grid_idx", render.frame_label("start_sec").alias("label"))


@query(
    "cli_lines",
    f"""WITH {MEDIA}, m AS (SELECT *, CAST(floor(duration_sec / 3600) AS BIGINT) AS h, CAST(floor((duration_sec % 3600) / 60) AS BIGINT) AS mi, CAST(floor(duration_sec % 60) AS BIGINT) AS s FROM media WHERE error_code IS NULL)
SELECT media_id, concat_ws(' ', '[' || upper(media_type[1]) || media_type[2:] || ']',
 CASE WHEN media_type <> 'image' THEN CASE WHEN h > 0 THEN h || 'h' || CASE WHEN mi > 0 THEN ' ' || mi || 'm' ELSE '' END WHEN mi > 0 THEN mi || 'm' || CASE WHEN s > 0 THEN s || 's' ELSE '' END ELSE s || 's' END END,
 width || 'x' || height, CASE WHEN length(video_codec) > 0 AND length(audio_codec) > 0 THEN video_codec || '/' || audio_codec WHEN length(audio_codec) > 0 THEN audio_codec END,
 CASE WHEN file_size_bytes >= 1073741824 THEN {fixed_sql('file_size_bytes / 1073741824')} || ' GB' WHEN file_size_bytes >= 1048576 THEN {fixed_sql('file_size_bytes / 1048576')} || ' MB' WHEN file_size_bytes >= 1024 THEN {fixed_sql('file_size_bytes / 1024')} || ' KB' ELSE file_size_bytes || ' B' END) AS line FROM m""",
)
def cli_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_media(spark, folder).where("error_code IS NULL").withColumnsRenamed({"media_type": "type", "file_path": "path"})
    return rows.select("media_id", render.cli_line().alias("line"))


@query(
    "video_reports",
    f"""WITH {VIDEOS} SELECT media_id, 'Title: ' || coalesce(title, '') || chr(10) || 'Duration: ' || coalesce(regexp_replace(CAST(duration_sec AS VARCHAR), '\\.0$', ''), '0') || 's' || chr(10) || 'Uploader: ' || coalesce(uploader, '') || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || chr(10) ||
'Subtitles: ' || media_id || chr(10) || 'Subtitle languages available: ' || coalesce(nullif(array_to_string(list_filter(coalesce(subtitle_languages, []), lambda x: x IS NOT NULL), ', '), ''), 'auto-generated') AS report FROM vids""",
)
def video_reports(spark: SparkSession, folder: str) -> DataFrame:
    return current_videos(spark, folder).select("media_id", render.video_report("media_id").alias("report"))


# ------------------------------------------------------------------ guards and counts


@query(
    "preflight",
    f"""WITH {MEDIA} SELECT media_id, CASE WHEN file_size_bytes > 10737418240 THEN 'size' WHEN media_type IN ('audio', 'video') AND duration_sec > 7200 THEN 'duration' END AS reason,
CASE WHEN file_size_bytes > 10737418240 OR (media_type IN ('audio', 'video') AND duration_sec > 7200) THEN 'FILE_TOO_LARGE' END AS code FROM media""",
)
def preflight(spark: SparkSession, folder: str) -> DataFrame:
    rows = media.preflight(current_media(spark, folder).withColumnRenamed("media_type", "type"))
    reason = F.when(F.col("error.message").contains(" GB, "), "size").when(F.col("error").isNotNull(), "duration")
    return rows.select("media_id", reason.alias("reason"), F.col("error.code").alias("code"))


@query("preflight_transcript", f"WITH {MEDIA} SELECT media_id FROM media WHERE media_type IN ('audio', 'video') AND duration_sec > 1800")
def preflight_transcript(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_media(spark, folder)
    return rows.where(media.preflight_duration("media_type", "duration_sec", 1_800, "get_transcript").isNotNull()).select("media_id")


@query("probe_summary", "SELECT media_type, count(*) AS n_files, count(*) FILTER (error_code IS NULL) AS n_ok, count(*) FILTER (error_code IS NOT NULL) AS n_failed, 'Probed ' || count(*) || ' file(s): ' || count(*) FILTER (error_code IS NULL) || ' succeeded, ' || count(*) FILTER (error_code IS NOT NULL) || ' failed.' AS summary FROM media_info GROUP BY 1")
def probe_summary(spark: SparkSession, folder: str) -> DataFrame:
    return media.probe_counts(table(spark, folder, "media_info"), by=["media_type"]).withColumn("summary", render.probe_summary("n_files", "n_ok", "n_failed"))


@query("isolated_errors", f"WITH {MEDIA} SELECT media_id, error_code IS NULL AS ok, '[' || error_code || '] the probe failed' AS text FROM media")
def isolated_errors(spark: SparkSession, folder: str) -> DataFrame:
    from cuewright.errors import envelope

    return media.isolate_errors(current_media(spark, folder)).select("media_id", "ok", F.when(F.col("error").isNotNull(), envelope(F.col("error"))).alias("text"))


@query("distinct_paths", "SELECT file_path, min(media_id) AS media_id FROM media_info WHERE file_path IS NOT NULL GROUP BY 1")
def distinct_paths(spark: SparkSession, folder: str) -> DataFrame:
    return media.first_seen(table(spark, folder, "media_info"), "file_path", "media_id")


@query(
    "language_union",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY fetched_at DESC NULLS LAST, subtitle_languages DESC NULLS LAST, title DESC NULLS LAST) AS late, row_number() OVER (PARTITION BY media_id ORDER BY fetched_at NULLS FIRST, subtitle_languages NULLS FIRST, title NULLS FIRST) AS early FROM videos),
own AS (SELECT media_id, CASE WHEN late = 1 THEN 0 ELSE 1 END AS part, unnest(subtitle_languages) AS lang, generate_subscripts(subtitle_languages, 1) AS k FROM f WHERE late = 1
  UNION ALL SELECT media_id, 1, unnest(subtitle_languages), generate_subscripts(subtitle_languages, 1) FROM f WHERE early = 1 UNION ALL SELECT media_id, 2, 'und', 1 FROM f WHERE late = 1),
firsts AS (SELECT media_id, lang, min(part * 1000 + k) AS place FROM own WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT media_id, string_agg(lang, ',' ORDER BY place) AS languages, count(*) AS n FROM firsts GROUP BY 1""",
)
def language_union(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the last and of the first fetch of a video, and 'und', each where it comes first."""
    fetches, listed = table(spark, folder, "videos").select("media_id", "title", "subtitle_languages", "fetched_at"), "subtitle_languages"
    last = latest(fetches, ["media_id"], "fetched_at", [listed, "title"]).select("media_id", F.col(listed).alias("late"))
    order = Window.partitionBy("media_id").orderBy(F.col("fetched_at").asc_nulls_first(), F.col(listed).asc_nulls_first(), F.col("title").asc_nulls_first())
    first = fetches.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("media_id", F.col(listed).alias("early"))
    union = media.union_in_order("late", "early", F.array(F.lit("und")))
    return last.join(first, "media_id").select("media_id", F.array_join(union, ",").alias("languages"), F.size(union).cast("long").alias("n"))


@query(
    "transcript_cache",
    """SELECT media_id, model_name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY media_id, model_name ORDER BY created_at DESC NULLS LAST, transcript DESC NULLS LAST) AS rn FROM understand_results)
WHERE rn = 1 AND coalesce(length(transcript), 0) <= 500000 ORDER BY created_at DESC NULLS LAST, media_id, model_name LIMIT 32""",
)
def transcript_cache(spark: SparkSession, folder: str) -> DataFrame:
    """A limit that is the feature: the cache holds 32 transcripts."""
    return media.admit_to_cache(table(spark, folder, "understand_results"), ["media_id", "model_name"], "transcript", "created_at").select("media_id", "model_name", "created_at")


# ------------------------------------------------------------------ budgets


_UNITS = lambda x: f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"
_ITEM = "CAST(to_json({'type': 'text', 'text': text}) AS VARCHAR)"


@query(
    "payload_length",
    f"""WITH {CURRENT}, items AS (SELECT media_id, 14 + sum({_UNITS(_ITEM)}) + count(*) - 1 AS total, count(*) AS n FROM current
  WHERE text IS NOT NULL GROUP BY 1) SELECT media_id, CAST(total AS BIGINT) AS total, n, total > 48000 AS over FROM items""",
)
def payload_length(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of payloads of one text item per segment, in UTF-16 units; the check counts characters beyond U+FFFF twice."""
    return _payloads(current_segments(spark, folder).where("text IS NOT NULL"))


def _payloads(segments: DataFrame) -> DataFrame:
    sized = segments.withColumn("size", budget.item_length(budget.text_item("text")).cast("long"))
    return budget.all_or_error(sized, "media_id", "seg_idx", "size", 48_000).select("media_id", "total", "n", F.col("error").isNotNull().alias("over"))


@query(
    "budget_prefix",
    f"""WITH {CURRENT}, sized AS (SELECT media_id, seg_idx, length(text) AS size FROM current WHERE length(text) > 0),
run AS (SELECT *, 14 + sum(size) OVER w + row_number() OVER w - 1 AS running FROM sized WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING))
SELECT media_id, seg_idx, CAST(running AS BIGINT) AS running FROM run WHERE running <= 4000""",
)
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    sized = current_segments(spark, folder).where("length(text) > 0").select("media_id", "seg_idx", F.length("text").cast("long").alias("size"))
    return budget.prefix_that_fits(sized, "media_id", "seg_idx", "size", 4000).select("media_id", "seg_idx", F.col("running").cast("long").alias("running"))


@query(
    "budget_errors",
    f"""WITH {CURRENT}, items AS (SELECT media_id, 14 + sum({_UNITS(_ITEM)}) + count(*) - 1 AS total FROM current WHERE text IS NOT NULL GROUP BY 1)
SELECT media_id, 'BUDGET_EXCEEDED' AS code, 'The payload exceeds the budget (~' || format('{{:,}}', CAST(total AS BIGINT)) || ' chars, ~' || {fixed_sql('total / 9000')} || 'x over budget at max_total_chars=9,000).' AS message FROM items WHERE total > 9000""",
)
def budget_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of payloads that don't fit, all or nothing."""
    sized = current_segments(spark, folder).where("text IS NOT NULL").withColumn("size", budget.item_length(budget.text_item("text")).cast("long"))
    return budget.all_or_error(sized, "media_id", "seg_idx", "size", 9_000).where("error IS NOT NULL").select("media_id", "error.code", "error.message")


@query(
    "budget_hints",
    f"""WITH {MEDIA} SELECT media_id, CASE WHEN height > width THEN 'This video is portrait (' || width || 'x' || height || '): each grid tile is tall and makes large images.' || chr(10) ELSE '' END
|| 'Try:' || chr(10) || CASE WHEN fps > 26 THEN '- thumb_width=120 (smaller tiles)' || chr(10) ELSE '' END || '- fewer tiles: cols=3, rows=3' || chr(10) || '- a shorter window: start_sec, end_sec' || chr(10) || '- a larger max_total_chars, if the client takes it' AS grids,
CASE WHEN height > width THEN 'This video is portrait (' || width || 'x' || height || '): each frame image is large.' || chr(10) ELSE '' END || 'Try:' || chr(10) || '- fewer timestamps in a call' || chr(10) || '- a larger max_total_chars, if the client takes it' AS frames FROM media""",
)
def budget_hints(spark: SparkSession, folder: str) -> DataFrame:
    thumb = F.when(F.col("fps") > 26, 480).otherwise(120)
    return current_media(spark, folder).select("media_id", budget.hints("width", "height", thumb).alias("grids"), budget.hints("width", "height", mode="frames").alias("frames"))


@query(
    "payload_summaries",
    f"""WITH {RESULTS}, x AS (SELECT media_id, transcript AS text, to_base64(encode(media_id)) AS data FROM results), y AS (SELECT media_id, length(data) AS images, 14 + coalesce({_UNITS(_ITEM)}, length('{{"type":"text"}}')) + 1 + length('{{"type":"image","data":"","mimeType":"image/jpeg"}}') + length(data) AS total FROM x)
SELECT media_id, 'Payload: ' || total || ' chars total, ' || images || ' base64 image chars.' AS summary, total + 1 + length('{{"type":"text","text":"end"}}') <= 900 AS appended FROM y""",
)
def payload_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """A transcript and an image: the payload's summary, and whether one more item fits."""
    content = F.array(budget.text_item("transcript"), budget.image_item(F.base64(F.col("media_id").cast("binary"))))
    grown = budget.append_if_fits(content, budget.text_item(F.lit("end")), 900)
    return current_results(spark, folder).select("media_id", budget.payload_summary(content).alias("summary"), (F.size(grown) == 3).alias("appended"))


@query("vision_tokens", f"WITH {MEDIA} SELECT media_id, CAST(ceil(CAST(width AS DOUBLE) * height / 750) AS BIGINT) AS tokens, coalesce(height > width, false) AS portrait FROM media")
def vision_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return current_media(spark, folder).select("media_id", t.vision_tokens("width", "height").alias("tokens"), t.is_portrait("width", "height").alias("portrait"))


@query("overage_ratios", f"WITH {RESULTS} SELECT media_id, '~' || {fixed_sql('length(transcript) / 1000')} || 'x over budget' AS ratio FROM results WHERE length(transcript) > 1000")
def overage_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return current_results(spark, folder).where("length(transcript) > 1000").select("media_id", t.overage(F.length("transcript"), F.lit(1000)).alias("ratio"))


_JSON = lambda x: f"CAST(to_json({{'type': 'text', 'text': {x}}}) AS VARCHAR)"
_IMAGE = "(4 * 1000 + length('{\"type\":\"image\",\"data\":\"\",\"mimeType\":\"image/jpeg\"}'))"


def _understand_sql(most: int) -> str:
    """The fold over a medium's grids as a recursive query: what is used, how many items there are, what went wrong."""
    heading = "chr(10) || '--- TRANSCRIPT ' || span || ' ---' || chr(10)"
    label = f"chr(10) || '--- FRAME GRID ' || k || '/' || n || ' ---' || chr(10) || 'Grid ' || k || '/' || n || ' covers ' || printf('%.3f', start_sec) || 's-' || printf('%.3f', end_sec) || 's. Tile timestamps: ' || {clock_sql('CAST(floor((start_sec + end_sec) / 2 * 1000 + 0.5) AS BIGINT)', '.')}"
    block = ORACLE["understand_block"].split("SELECT m.media_id, ")[1].split(" AS block")[0]
    rest, alone = "chr(10) || '--- TRANSCRIPT (remaining) ---' || chr(10)", "chr(10) || '--- TRANSCRIPT ---' || chr(10)"
    bad = "'BUDGET_EXCEEDED'"
    return f"""WITH RECURSIVE {ASSIGNED}, {MEDIA}, counted AS (SELECT media_id, count(*) AS n FROM grid_windows GROUP BY 1),
lines AS (SELECT a.media_id, a.grid_idx, c.seg_idx, {LINE} AS line FROM assigned a JOIN current c ON a.media_id = c.media_id AND a.seg_idx = c.seg_idx),
chunks AS (SELECT media_id, grid_idx, string_agg(line, chr(10) ORDER BY seg_idx) AS text FROM lines WHERE line IS NOT NULL GROUP BY 1, 2),
grids AS (SELECT g.*, row_number() OVER (PARTITION BY g.media_id ORDER BY start_sec, g.grid_idx) AS k, count(*) OVER (PARTITION BY g.media_id) AS n, {fixed_sql('start_sec')} || 's–' || {fixed_sql('end_sec')} || 's' AS span, c.text FROM grid_windows g LEFT JOIN chunks c ON c.media_id = g.media_id AND c.grid_idx = g.grid_idx),
heads AS (SELECT m.media_id, coalesce(media_type, 'unknown') AS kind, n.n AS n, {block} AS block FROM media m LEFT JOIN counted n ON n.media_id = m.media_id WHERE error_code IS NULL),
opened AS (SELECT media_id, kind, n, 14 + {_UNITS(_JSON('block'))} AS used FROM heads),
first AS (SELECT media_id, kind, CAST(0 AS BIGINT) AS k, used, CAST(1 AS BIGINT) AS items, CAST(0 AS BIGINT) AS images, CASE WHEN used > {most} THEN {bad} END AS code, kind = 'video' AND coalesce(n, 0) > 0 AS woven FROM opened),
fold AS (SELECT * FROM first UNION ALL
  SELECT media_id, kind, k, CASE WHEN bad THEN used2 ELSE used2 + 1 + label_size + 1 + {_IMAGE} END, items2 + CASE WHEN bad THEN 0 ELSE 2 END, images + CASE WHEN bad THEN 0 ELSE 1 END, CASE WHEN bad THEN {bad} END, woven FROM (
    SELECT *, used2 + 1 + label_size > {most} OR used2 + 1 + label_size + 1 + {_IMAGE} > {most} AS bad FROM (
      SELECT *, CASE WHEN used + 1 + size <= {most} THEN used + 1 + size ELSE used END AS used2, items + CASE WHEN used + 1 + size <= {most} THEN 1 ELSE 0 END AS items2, {_UNITS(_JSON('label'))} AS label_size FROM (
        SELECT f.media_id, f.kind, g.k, f.used, f.items, f.images, f.woven, {label.replace("|| k ||", "|| g.k ||")} AS label, CASE WHEN g.text IS NOT NULL THEN {_UNITS(_JSON(f"{heading} || {cut16_sql('g.text', f'greatest(32, {most} - f.used - 1024)')}"))} END AS size
        FROM fold f JOIN grids g ON g.media_id = f.media_id AND g.k = f.k + 1 WHERE f.woven AND f.code IS NULL)))),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY k DESC) = 1),
tails AS (SELECT l.*, c.text, CASE WHEN woven THEN {_UNITS(_JSON(f"{rest} || {cut16_sql('c.text', f'greatest(32, {most} - used - 256)')}"))}
  WHEN kind <> 'image' AND greatest(0, {most} - used - 256) > length({alone}) + 32 THEN {_UNITS(_JSON(f"{alone} || {cut16_sql('c.text', f'greatest(32, greatest(0, {most} - used - 256) - length({alone}))')}"))} END AS size FROM last l LEFT JOIN chunks c ON c.media_id = l.media_id AND c.grid_idx IS NULL),
ended AS (SELECT *, CASE WHEN code IS NOT NULL THEN used WHEN kind = 'image' THEN used + CASE WHEN used + 1 + {_IMAGE} - 4000 <= {most} THEN 1 + {_IMAGE} - 4000 ELSE 0 END WHEN text IS NOT NULL AND used + 1 + size <= {most} THEN used + 1 + size ELSE used END AS used3,
  items + CASE WHEN code IS NULL AND (kind = 'image' OR (text IS NOT NULL AND used + 1 + size <= {most})) THEN 1 ELSE 0 END AS items3, coalesce(code, CASE WHEN NOT woven AND text IS NOT NULL AND kind <> 'image' AND used + 1 + size > {most} THEN {bad} END) AS code3 FROM tails),
closed AS (SELECT *, CASE WHEN code3 IS NOT NULL THEN used3 ELSE used3 + 1 + length('{{"type":"text","text":"Payload: ' || used3 || ' chars total, ' || images * 4000 || ' base64 image chars."}}') END AS total FROM ended)
SELECT media_id, CAST(CASE WHEN code3 IS NOT NULL OR total > {most} THEN 0 ELSE items3 + 1 END AS BIGINT) AS items, CAST(total AS BIGINT) AS total_chars, CASE WHEN total > {most} THEN {bad} ELSE code3 END AS code FROM closed"""


@query("understand_content", _understand_sql(48_000))
def understand_content(spark: SparkSession, folder: str) -> DataFrame:
    """The whole analysis of each medium within its budget: how many items it has, their length, and what went wrong."""
    return _understood(spark, folder, 48_000)


@query("understand_tight", _understand_sql(9_000))
def understand_tight(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a budget that cuts chunks, drops them, and has no room for all grids."""
    return _understood(spark, folder, 9_000)


def _understood(spark: SparkSession, folder: str, most: int) -> DataFrame:
    rows = current_media(spark, folder).where("error_code IS NULL").withColumnsRenamed({"media_type": "type", "file_path": "path"})
    found = tools.understand_content(rows, current_segments(spark, folder), table(spark, folder, "grid_windows"), most)
    return found.select("media_id", F.size("content").cast("long").alias("items"), "total_chars", F.col("error.code").alias("code"))


@query(
    "no_speech",
    f"WITH {CURRENT}, {MEDIA}, spoken AS (SELECT DISTINCT media_id FROM current WHERE start_ms < 90500 AND end_ms > 60000 AND length(trim(text)) > 0) SELECT media_id, 'No speech detected in the requested window (60s–90.5).' AS text FROM media WHERE error_code IS NULL AND media_id NOT IN (SELECT media_id FROM spoken)",
)
def no_speech(spark: SparkSession, folder: str) -> DataFrame:
    """What stands for the transcripts of media that say nothing in a window of time."""
    spoken = align.in_window(table(spark, folder, "segments").select("media_id", "seg_idx", "start_ms", "end_ms", "text", "ingested_at").transform(lambda rows: latest_in_blocks(rows, "media_id", "seg_idx", "ingested_at")), 60, 90.5).where("length(trim(text)) > 0")
    return current_media(spark, folder).where("error_code IS NULL").join(spoken, "media_id", "left_anti").select("media_id", F.lit(render.no_speech(60, 90.5)).alias("text"))


# ------------------------------------------------------------------ files


def _media_files(spark: SparkSession, folder: str) -> DataFrame:
    """The beginnings of files with the properties of each medium: WAV for sound, and pictures of several formats."""
    rows = current_media(spark, folder).select("media_id", "file_path", "media_type", "width", "height", "sample_rate", "channels", F.length("media_id").alias("k"))
    big = lambda c, n: F.unhex(F.lpad(F.hex(F.col(c)), 2 * n, "0"))
    little = lambda c, n: F.concat(*(F.unhex(F.lpad(F.hex((F.col(c) / 256**i).cast("long") % 256), 2, "0")) for i in range(n)))
    mark = lambda text: F.unhex(F.lit(text))
    rows = rows.withColumn("rate", F.col("sample_rate").cast("long") * F.col("channels") * 2).withColumn("two", F.lit(2)).withColumn("bits", F.lit(16)).withColumn("data", (F.col("rate") / 20).cast("long"))
    wav = F.concat(mark("52494646FFFFFFFF57415645666D7420100000000100"), little("channels", 2), little("sample_rate", 4), little("rate", 4), little("two", 2), little("bits", 2), mark("64617461"), little("data", 4), F.unhex(F.repeat(F.lit("00"), F.col("data").cast("int"))))
    png = F.concat(mark("89504E470D0A1A0A0000000D49484452"), big("width", 4), big("height", 4), mark("0802000000"))
    gif = F.concat(mark("474946383961"), little("width", 2), little("height", 2), mark("000000"))
    bmp = F.concat(mark("424D" + "00" * 16), little("width", 4), little("height", 4), mark("00" * 28))
    svg = F.encode(F.concat(F.lit('<?xml version="1.0"?>\n<svg width="'), "width", F.lit('px" height="'), "height", F.lit('">')), "utf-8")
    turn = F.crc32("media_id") % 4
    picture = F.when(turn == 0, png).when(turn == 1, gif).when(turn == 2, bmp).otherwise(svg)
    extension = F.when(turn == 0, ".png").when(turn == 1, ".gif").when(turn == 2, ".bmp").otherwise(".svg")
    content = F.when(F.col("media_type") == "audio", wav).when(F.col("width").isNotNull(), picture).otherwise(F.encode(F.lit("no media"), "utf-8"))
    path = F.concat("media_id", F.when(F.col("media_type") == "audio", ".wav").when(F.col("width").isNotNull(), extension).otherwise(".txt"))
    return rows.select("media_id", path.alias("path"), content.alias("content"))


@query(
    "probed_files",
    f"""WITH {MEDIA} SELECT media_id, CASE WHEN media_type = 'audio' THEN 'av' WHEN width IS NOT NULL THEN 'image' ELSE 'unknown' END AS kind, CASE WHEN media_type = 'audio' THEN 'audio' WHEN width IS NOT NULL THEN 'image' END AS type,
CASE WHEN media_type IS DISTINCT FROM 'audio' THEN width END AS width, CASE WHEN media_type IS DISTINCT FROM 'audio' THEN height END AS height, CASE WHEN media_type = 'audio' THEN sample_rate END AS sample_rate, CASE WHEN media_type = 'audio' THEN channels END AS channels,
CASE WHEN media_type = 'audio' THEN 0.05 WHEN width IS NOT NULL THEN 0.0 END AS duration_sec, CASE WHEN media_type IS DISTINCT FROM 'audio' AND width IS NULL THEN 'UNSUPPORTED_FORMAT' END AS code FROM media""",
)
def probed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every medium as the beginning of a file, by its magic bytes or its extension, and probed."""
    heads = _media_files(spark, folder)
    kinds = heads.select("media_id", files.kind_of("content", "path").alias("kind"))
    probed = files.probe_content(heads, "media_id").join(kinds, "media_id")
    return probed.select("media_id", "kind", "info.type", "info.width", "info.height", "info.sample_rate", "info.channels", F.round("info.duration_sec", 6).alias("duration_sec"), F.col("error.code").alias("code"))


@query(
    "fingerprints",
    f"""WITH {MEDIA}, x AS (SELECT media_id, repeat(media_id || '.', CASE WHEN media_type = 'video' THEN 20000 ELSE 100 END) AS body FROM media)
SELECT media_id, sha256(length(body) || substring(body, 1, 65536) || CASE WHEN length(body) > 131072 THEN right(body, 65536) ELSE '' END) AS fingerprint FROM x""",
)
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of contents below and above the size of which only both ends are read."""
    body = F.repeat(F.concat("media_id", F.lit(".")), F.when(F.col("media_type") == "video", 20_000).otherwise(100))
    rows = current_media(spark, folder).select("media_id", F.encode(body, "utf-8").alias("content"))
    return rows.select("media_id", files.fingerprint("content", F.octet_length("content").cast("long")).alias("fingerprint"))


@query(
    "file_reports",
    f"WITH {MEDIA} SELECT media_id, CASE WHEN error_code IS NULL THEN {_BLOCK_SQL}, 'Acceleration: ' || acceleration.backend || CASE WHEN acceleration.hardware THEN ' (hardware)' ELSE ' (software)' END) ELSE 'File: ' || file_path || chr(10) || 'Error: [' || error_code || '] the probe failed' END AS report FROM media",
)
def file_reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = media.isolate_errors(current_media(spark, folder)).withColumnsRenamed({"media_type": "type", "file_path": "path"})
    return rows.select("media_id", render.file_report(render.media_block(), "path", F.col("error")).alias("report"))


# ------------------------------------------------------------------ scalar functions


@query(
    "url_keys",
    f"""WITH {VIDEOS} SELECT media_id, substring(sha256(regexp_replace(url, '^\\s+|\\s+$', '', 'g')), 1, 16) AS hash, coalesce(regexp_matches(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '(?i)^https?://'), false) AS is_url,
regexp_matches(url, '[*?\\[\\]{{]') AS has_glob FROM vids""",
)
def url_keys(spark: SparkSession, folder: str) -> DataFrame:
    return current_videos(spark, folder).select("media_id", t.url_hash("url").alias("hash"), t.is_url("url").alias("is_url"), t.has_glob("url").alias("has_glob"))


@query(
    "clean_captions",
    f"""WITH {CURRENT} SELECT media_id, seg_idx, {strip_sql("replace(regexp_replace(text, '<[^>]*>', '', 'g'), chr(10), ' ')")} AS plain, regexp_replace(text, '(\\d{{2}}:\\d{{2}}:\\d{{2}})\\.(\\d{{3}})', '\\1,\\2', 'g') AS stamps,
replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM current""",
)
def clean_captions(spark: SparkSession, folder: str) -> DataFrame:
    return current_segments(spark, folder).select("media_id", "seg_idx", t.strip_tags("text").alias("plain"), t.srt_separators("text").alias("stamps"), t.escape_xml("text").alias("escaped"))


@query(
    "time_labels",
    f"""WITH {CURRENT}, s AS (SELECT *, greatest(0, CAST(floor(start_ms + 0.5) AS BIGINT)) AS ms, CAST(floor(end_ms / 1000 / 3600) AS BIGINT) AS h, CAST(floor((end_ms / 1000 % 3600) / 60) AS BIGINT) AS m FROM current WHERE start_ms IS NOT NULL AND end_ms >= 0)
SELECT media_id, seg_idx, {clock_sql('ms', ',')} AS srt, {fixed_sql('end_ms / 1000')} AS seconds, CASE WHEN h > 0 AND m > 0 THEN h || 'h ' || m || 'm' WHEN h > 0 THEN h || 'h' ELSE m || 'm' END AS duration FROM s""",
)
def time_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_segments(spark, folder).where("start_ms IS NOT NULL AND end_ms >= 0")
    return rows.select("media_id", "seg_idx", t.srt_timestamp("start_ms").alias("srt"), t.fixed1(F.col("end_ms") / 1000).alias("seconds"), t.duration_label(F.col("end_ms") / 1000).alias("duration"))


@query(
    "video_metadata",
    f"""WITH {VIDEOS} SELECT media_id, coalesce(title, '') AS title, coalesce(duration_sec, 0.0) AS duration_sec, coalesce(uploader, '') AS uploader, coalesce(view_count, 0) AS view_count,
coalesce(array_to_string(list_sort(list_distinct(list_filter(subtitle_languages, lambda x: x IS NOT NULL AND x <> ''))), ','), '') AS languages, coalesce(len(list_distinct(list_filter(subtitle_languages, lambda x: x IS NOT NULL AND x <> ''))), 0) > 0 AS has_subtitles FROM vids""",
)
def video_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Rows go out as the JSON a downloader dumps and come back through the parser of that source."""
    videos = current_videos(spark, folder)
    langs = F.filter("subtitle_languages", lambda x: x.isNotNull() & (x != ""))
    captions = F.map_from_entries(F.transform(F.array_distinct(F.coalesce(langs, F.array().cast("array<string>"))), lambda x: F.struct(x.alias("key"), F.array().cast("array<string>").alias("value"))))
    dumped = videos.select("media_id", F.to_json(F.struct("title", F.col("duration_sec").alias("duration"), "uploader", "view_count", "url", captions.alias("subtitles"))).alias("json"), "url")
    return urls.parse_metadata(dumped, "json", "url").select("media_id", "title", "duration_sec", "uploader", "view_count", F.array_join(F.array_sort("subtitle_languages"), ",").alias("languages"), "has_subtitles")


@query(
    "subtitle_round_trip",
    f"""WITH {CURRENT} SELECT media_id, CAST(greatest(0, floor(start_ms + 0.5)) AS DOUBLE) AS start_ms, CAST(greatest(0, floor(end_ms + 0.5)) AS DOUBLE) AS end_ms, plain AS text FROM
(SELECT *, {strip_sql("replace(regexp_replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '<[^>]*>', '', 'g'), chr(10), ' ')")} AS plain FROM current) WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL AND length(plain) > 0""",
)
def subtitle_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Segments written as SRT files' text, and read again by the parser of subtitle files."""
    rows = current_segments(spark, folder).withColumn("text", F.regexp_replace("text", r"\s*\n\s*", " "))
    cues = rows.withColumn("content", F.concat(F.lit("1\n"), render.srt_block())).select("media_id", F.lit("x.srt").alias("path"), "content")
    return subtitles.parse(cues, "path", "content").select("media_id", "start_ms", "end_ms", "text")


# ------------------------------------------------------------------ relational breadth


@query(
    "revenue_rollup",
    """SELECT r_name, n_name, CAST(round(sum(l_extendedprice * (1 - l_discount)), 0) AS BIGINT) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def revenue_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue is summed per order before anything is joined, so that orders needn't be told apart again at each level."""
    r = lambda name: table(spark, folder, name)
    per_order = r("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = per_order.join(r("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.round(F.sum("revenue"), 0).cast("long").alias("revenue"), F.count("o_orderkey").alias("n_orders"))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 0) AS BIGINT) AS sum_qty, count(*) AS n, round(avg(l_discount), 4) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 0).cast("long").alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 4).alias("avg_disc"))


@query("customers_without_urgent_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, folder, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("media_sets", "SELECT media_id, 'both' AS side FROM (SELECT media_id FROM segments INTERSECT SELECT media_id FROM videos) UNION ALL SELECT media_id, 'unfetched' FROM (SELECT media_id FROM media_info EXCEPT SELECT media_id FROM videos)")
def media_sets(spark: SparkSession, folder: str) -> DataFrame:
    ids = {name: table(spark, folder, name).select("media_id") for name in ("segments", "videos", "media_info")}
    both, without = ids["segments"].intersect(ids["videos"]), ids["media_info"].subtract(ids["videos"])
    return both.withColumn("side", F.lit("both")).unionByName(without.withColumn("side", F.lit("unfetched")))


@query("sql_functions", f"WITH {RESULTS} SELECT media_id, length(transcript) + len(regexp_extract_all(transcript, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS units, {cut16_sql('transcript', 500)} AS cut FROM results WHERE transcript IS NOT NULL")
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """SQL text over a view, with this library's functions by their names in SQL."""
    register(spark)
    return spark.sql("SELECT media_id, cuewright_units(transcript) AS units, cuewright_cut(transcript, 500) AS cut FROM {results} WHERE transcript IS NOT NULL", results=current_results(spark, folder))


@query("approximate_counts", "SELECT source, true AS close FROM documents GROUP BY 1")
def approximate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of distinct speakers and of the median length, beside the exact values: within three standard errors."""
    rows = table(spark, folder, "documents")
    n, exact = F.approx_count_distinct("doc_id", 0.02), F.count_distinct("doc_id")
    share = F.avg(F.when(F.col("n_chars") <= F.col("middle"), 1.0).otherwise(0.0))
    middle = rows.groupBy("source").agg((F.abs(n - exact) <= F.greatest(F.lit(1.0), 0.06 * exact)).alias("near"), F.percentile_approx("n_chars", 0.5, 1000).alias("middle"))
    both = rows.where("n_chars IS NOT NULL").join(middle.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(F.bool_and("near").alias("near"), share.alias("share"))
    return both.select("source", (F.col("near") & F.col("share").between(0.45, 0.6)).alias("close"))


@query("event_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS n_events FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session windows by event time: 30 minutes without an event end one."""
    rows = table(spark, folder, "events")
    sessions = rows.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_events"))
    return sessions.select("user_id", "started_at", "last_at", "n_events")
