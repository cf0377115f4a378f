"""The tools of the library as plans: whole analyses of many media at once, within a budget each."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.errors import ERROR
from cuewright.functions.text import CUT_MARK, _units, timestamp_label
from cuewright.operators import align
from cuewright.operators.budget import FRAME, base64_length, total_budget
from cuewright.plans import render

# Headings of the items, which clients tell apart by them.
TRANSCRIPT_HEADING = "\n--- TRANSCRIPT ---\n"
CHUNK_HEADING = "\n--- TRANSCRIPT {} ---\n"
GRID_HEADING = "\n--- FRAME GRID {} ---\n"
REST_HEADING = "\n--- TRANSCRIPT (remaining) ---\n"

CONTENT = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("grid_idx", T.IntegerType()), T.StructField("data_chars", T.LongType())]))


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


class Payload:
    """Items of one answer and their serialized length, kept as it grows."""

    def __init__(self, most: int) -> None:
        self.most, self.items, self.sizes, self.sum = most, [], [], 0

    @property
    def length(self) -> int:
        return FRAME + self.sum + max(len(self.sizes) - 1, 0)

    def _add(self, item: dict, size: int) -> None:
        self.items.append(item)
        self.sizes.append(size)
        self.sum += size

    @staticmethod
    def text_size(text: str) -> int:
        return units(json.dumps({"type": "text", "text": text}, ensure_ascii=False, separators=(",", ":")))

    @staticmethod
    def image_size(data_chars: int) -> int:
        return len('{"type":"image","data":"","mimeType":"image/jpeg"}') + data_chars

    def _fits(self, size: int) -> bool:
        return self.length + size + bool(self.items) <= self.most

    def text(self, text: str, force: bool = False) -> bool:
        size = self.text_size(text)
        if not force and not self._fits(size):
            return False
        self._add({"type": "text", "text": text, "grid_idx": None, "data_chars": None}, size)
        return True

    def image(self, grid: int | None, data_chars: int) -> bool:
        size = self.image_size(data_chars)
        if not self._fits(size):
            return False
        self._add({"type": "image", "text": None, "grid_idx": grid, "data_chars": data_chars}, size)
        return True

    def drop(self) -> None:
        self.items.pop()
        self.sum -= self.sizes.pop()

    def close(self) -> None:
        """Append the summary; it counts what is there before it."""
        images = sum(i["data_chars"] or 0 for i in self.items)
        self.text(f"Payload: {self.length} chars total, {images} base64 image chars.", force=True)

    def error(self, what: str, size: int | None = None) -> dict:
        return {"code": "BUDGET_EXCEEDED", "message": f"{what} (~{size if size is not None else self.length:,} chars at max_total_chars={self.most:,})."}


def cut(head: str, tail: str, n: int, most: int) -> str:
    """``truncate_middle`` in UTF-16 units, of a text given by head, tail and length."""
    if n <= most:
        return head
    keep = most * 6 // 10
    return _units(head, keep, None) + CUT_MARK + _units(tail, None, most - keep)


def pack(kind: str, block: str, chunks: dict, grids: list, most: int, n_grids: int | None = None) -> tuple[list[dict], int, dict | None]:
    """Fold a medium's block, transcript chunks and grids into items.

    A chunk is optional: it is cut to what is left, less a reserve, and dropped
    if it still doesn't fit.  A grid that doesn't fit is an error, so of
    ``n_grids`` only as many need to be there as may fit, and the next.
    """
    out = Payload(most)
    out.text(block, force=True)
    if out.length > most:
        return [], out.length, out.error("The metadata alone exceeds the budget")
    if kind == "image":
        size = grids[0]["data_chars"] if grids else 0
        if not out.image(None, size):
            return [], out.length, out.error("The image exceeds the budget", out.length + out.image_size(size))
    elif kind != "video" or not grids:
        if (chunk := chunks.get(None)) is not None:
            header = TRANSCRIPT_HEADING
            room = max(0, most - out.length - 256)
            if room > len(header) + 32:
                text = header + cut(*chunk, max(32, room - len(header)))
                if not out.text(text):
                    return [], out.length, out.error("The transcript exceeds the budget", out.length + out.text_size(text))
    else:
        grids = sorted(grids, key=lambda g: (g["start_sec"], g["grid_idx"]))
        n_grids = n_grids or len(grids)
        for k, grid in enumerate(grids):
            if (chunk := chunks.get(grid["grid_idx"])) is not None:
                out.text(CHUNK_HEADING.format(grid["span"]) + cut(*chunk, max(32, most - out.length - 1024)))
            label = GRID_HEADING.format(f"{k + 1}/{n_grids}") + f"Grid {k + 1}/{n_grids} {grid['label']}"
            fits = out.text(label)
            if not (fits and out.image(grid["grid_idx"], grid["data_chars"])):
                if fits:
                    out.drop()
                return [], out.length, out.error(f"Grid image {k + 1}/{n_grids} exceeds the budget", out.length + out.image_size(grid["data_chars"]))
        if (chunk := chunks.get(None)) is not None:
            out.text(REST_HEADING + cut(*chunk, max(32, most - out.length - 256)))
    out.close()
    if out.length > most:
        return [], out.length, out.error("The payload with its summary exceeds the budget")
    return out.items, out.length, None


def understand_content(media: DataFrame, segments: DataFrame, grids: DataFrame, most: int | None = None, image_bytes: Column | None = None, entity: str = "media_id") -> DataFrame:
    """Per medium the items of its analysis: a block, then transcript chunks between the grid images they belong to.

    Columns: entity, ``content`` (text items, and image items that name their
    ``grid_idx`` and base64 length: pixels join last), ``total_chars, error``.
    ``media`` has ``MEDIA_INFO`` columns, ``segments`` current rows, ``grids``
    windows with optional ``timestamps_sec``; ``image_bytes`` is a column of
    ``grids`` with the size of each JPEG (default: 3000 bytes).

    What comes together in the row of a medium is bounded by its budget: no more
    grids than images of no size would fit, and one, with their chunks, and lines
    of a chunk only as far as the budget reaches from either end.
    """
    most = total_budget(most)
    kept = [c for c in ("timestamps_sec",) if c in grids.columns]
    times = F.col("timestamps_sec") if kept else F.array((F.col("start_sec") + F.col("end_sec")) / 2)
    size = base64_length(image_bytes if image_bytes is not None else F.lit(3000))
    windows = grids.select(
        F.col(entity).alias("m"),
        F.struct(
            "grid_idx",
            "start_sec",
            F.concat(render.fixed1("start_sec"), F.lit("s–"), render.fixed1("end_sec"), F.lit("s")).alias("span"),
            F.concat(F.lit("covers "), render.to_fixed("start_sec", 3), F.lit("s-"), render.to_fixed("end_sec", 3), F.lit("s. Tile timestamps: "), F.array_join(F.transform(times, timestamp_label), ", ")).alias("label"),
            size.alias("data_chars"),
        ).alias("grid"),
    )
    # A window function over few rows: each task sends no more than the first so many grids of a medium on.
    first = Window.partitionBy("m").orderBy("grid.start_sec", "grid.grid_idx")
    counts = windows.groupBy("m").agg(F.count(F.lit(1)).alias("n_grids"))
    near = windows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most // Payload.image_size(0) + 1)
    per_medium = near.groupBy("m").agg(F.collect_list("grid").alias("grids")).join(counts, "m")
    assigned = align.assign_to_windows(segments.select(entity, "seg_idx", "start_ms", "end_ms", "text"), grids)
    lines = assigned.withColumn("_line", render.segment_line()).withColumn("_key", F.struct(F.col(entity).alias("m"), F.col("grid_idx").alias("g")))
    texts = render.join_lines(lines, "_key", "seg_idx", "_line", "\n", most, whole=False).select("_key.m", "_key.g", "a", "b", "n")
    placed = texts.join(near.select("m", F.col("grid.grid_idx").alias("g"), "rank"), ["m", "g"], "left").where("g IS NULL OR rank IS NOT NULL")
    tail = F.when(F.col("n") > most, F.col("b")).alias("b")  # else ``a`` is the whole chunk
    chunks = placed.select("m", "g", "a", tail, "n").groupBy("m").agg(F.collect_list(F.struct("g", "a", "b", "n")).alias("chunks"))
    rows = media.withColumn("k", F.col(entity)).withColumn("type", F.coalesce("type", F.lit("unknown")))
    blocks = rows.join(per_medium, F.col("k") == per_medium["m"], "left").drop("m").join(chunks, F.col("k") == chunks["m"], "left").drop("m")
    blocks = blocks.select("k", "type", render.understand_block(F.coalesce("n_grids", F.lit(0))).alias("block"), "grids", "chunks", F.coalesce("n_grids", F.lit(0)).alias("n_grids"))
    schema = T.StructType([T.StructField("k", media.schema[entity].dataType), T.StructField("content", CONTENT), T.StructField("total_chars", T.LongType()), T.StructField("error", ERROR)])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = {c["g"]: (c["a"], c["a"] if c["b"] is None else c["b"], c["n"]) for c in (row.chunks if row.chunks is not None else [])}
                out.append((row.k, *pack(row.type, row.block, own, list(row.grids) if row.grids is not None else [], most, row.n_grids)))
            yield pd.DataFrame(out, columns=["k", "content", "total_chars", "error"])

    return blocks.mapInPandas(fold, schema).withColumnRenamed("k", entity)
