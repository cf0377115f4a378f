"""Payload budgets: serialized lengths, prefixes that fit, folds, and what to say when nothing fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright import options as o
from cuewright.errors import error
from cuewright.functions.text import col, is_portrait, overage, utf16_length

#: Characters around the items of a payload: ``{"content":[`` and ``]}``.
FRAME = 14


def total_budget(most: int | None = None) -> int:
    return o.DEFAULT_TOTAL_CHARS if most is None else most


def text_item(text: Column | str) -> Column:
    return F.struct(F.lit("text").alias("type"), col(text).alias("text"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("mimeType"))


def image_item(data: Column | str, mime: str = "image/jpeg") -> Column:
    """An image item of base64 text."""
    return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), col(data).alias("data"), F.lit(mime).alias("mimeType"))


def item_length(item: Column | str) -> Column:
    """UTF-16 units of an item's JSON."""
    return utf16_length(F.to_json(col(item)))


def image_item_length(data_length: Column | str) -> Column:
    """The same for an image item of which only the base64 length is known: images needn't travel to be counted."""
    return col(data_length) + F.lit(len('{"type":"image","data":"","mimeType":"image/jpeg"}'))


def base64_length(n_bytes: Column | str) -> Column:
    return (4 * F.ceil(col(n_bytes) / 3)).cast("long")


def payload_length(content: Column | str) -> Column:
    """Length of ``{"content":[...]}``: lengths of items add up, with a comma between any two."""
    content = col(content)
    return F.aggregate(content, F.lit(FRAME).cast("long"), lambda n, item: n + item_length(item)) + F.greatest(F.size(content) - 1, F.lit(0))


def payload_summary(content: Column | str) -> Column:
    """``Payload: N chars total, M base64 image chars.``"""
    content = col(content)
    images = F.aggregate(F.filter(content, lambda i: i["type"] == "image"), F.lit(0).cast("long"), lambda n, i: n + utf16_length(i["data"]))
    return F.concat(F.lit("Payload: "), payload_length(content).cast("string"), F.lit(" chars total, "), images.cast("string"), F.lit(" base64 image chars."))


def append_if_fits(content: Column, item: Column, most: Column | int) -> Column:
    """``content`` with the item, or as it was if the payload would pass the budget."""
    grown = F.concat(content, F.array(item))
    return F.when(payload_length(grown) <= most, grown).otherwise(content)


def _placed(df: DataFrame, entity: str, order: str, length: str, used: int, most: int | None, block: int) -> DataFrame:
    """Running lengths in two levels: sums of blocks of positions, then inside each block.

    No task orders more than a block of an entity's items; blocks that begin
    beyond ``most`` aren't looked at.
    """
    first = 1 if used == FRAME else 0  # the first item of an empty payload has no comma
    keyed = df.withColumn("_k", F.floor(F.col(order) / block))
    by = Window.partitionBy(entity).orderBy("_k")
    sums = keyed.groupBy(entity, "_k").agg((F.sum(length) + F.count(F.lit(1))).alias("_sum"))
    before = sums.select(F.col(entity).alias("_e"), F.col("_k").alias("_b"), F.coalesce(F.sum("_sum").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    if most is not None:
        before = before.where(F.col("_before") + used - first <= most)
    joined = keyed.join(before, F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_k") == F.col("_b")))
    inside = Window.partitionBy(entity, "_k").orderBy(order)
    upto = F.sum(F.col(length) + 1).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("running", (F.col("_before") + upto + used - first).cast("long")).drop("_e", "_b", "_k", "_before")


def running_length(df: DataFrame, entity: str, order: str, length: str, used: int = FRAME, block: int = 4096) -> DataFrame:
    """Adds ``running``: the payload's length with the items of an entity up to this one (``used``: what is there before).

    ``order`` is a whole number; rows without one have no place and are left out.
    """
    return _placed(df, entity, order, length, used, None, block)


def prefix_that_fits(df: DataFrame, entity: str, order: str, length: str, most: int, used: int = FRAME, block: int = 4096) -> DataFrame:
    """Items up to the first that doesn't fit; lengths are positive, so this is a filter on the running sum."""
    return _placed(df, entity, order, length, used, most, block).where(F.col("running") <= most)


def all_or_error(df: DataFrame, entity: str, order: str, length: str, most: int, used: int = FRAME) -> DataFrame:
    """One row per entity: ``n, total, error``; the error is set if all its items together pass the budget."""
    totals = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), (F.lit(used) + F.sum(length) + F.count(F.lit(1)) - (1 if used == FRAME else 0)).alias("total"))
    return totals.withColumn("error", budget_error(F.lit("The payload exceeds the budget"), "total", most))


def budget_error(context: Column, actual: Column | str, most: Column | int) -> Column:
    """``BUDGET_EXCEEDED`` with sizes and the ratio where ``actual`` is above ``most``, else null."""
    most = F.lit(most) if isinstance(most, int) else most
    message = F.concat(context, F.lit(" (~"), F.format_number(col(actual), 0), F.lit(" chars, "), overage(col(actual), most), F.lit(" at max_total_chars="), F.format_number(most, 0), F.lit(")."))
    return error("BUDGET_EXCEEDED", F.when(col(actual) > most, message))


def hints(width: Column | str, height: Column | str, thumb_width: Column | None = None, mode: str = "grid") -> Column:
    """Lines of advice for a payload that doesn't fit: about grids, or about single frames."""
    what = "grid tile is tall and makes large images" if mode == "grid" else "frame image is large"
    tall = F.when(is_portrait(width, height), F.concat(F.lit("This video is portrait ("), col(width).cast("string"), F.lit("x"), col(height).cast("string"), F.lit(f"): each {what}.")))
    if mode == "grid":
        thumb = F.lit("- thumb_width=120 (smaller tiles)")
        smaller = thumb if thumb_width is None else F.when(thumb_width.isNull() | (thumb_width > 120), thumb)
        lines = [smaller, F.lit("- fewer tiles: cols=3, rows=3"), F.lit("- a shorter window: start_sec, end_sec"), F.lit("- a larger max_total_chars, if the client takes it")]
    else:
        lines = [F.lit("- fewer timestamps in a call"), F.lit("- a larger max_total_chars, if the client takes it")]
    return F.concat_ws("\n", tall, F.lit("Try:"), *lines)


def fold(items: Column, state: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Stateful packing of an entity's ordered items: each step sees what earlier ones have used."""
    return F.aggregate(items, state, step)


def assert_fits(content: Column | str, most: int, detail: str) -> Column:
    """Null, or the error that a whole payload is too long."""
    return budget_error(F.lit(detail), payload_length(content), most)
