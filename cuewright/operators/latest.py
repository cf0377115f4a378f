"""Current versions of keyed rows, in blocks that keep a hot entity from becoming one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per block. A block is what one task orders at a time, whatever the size of its entity.
BLOCK = 4096


def latest(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """Of the rows with equal ``keys``, the one with the greatest ``version``.

    A null version is the oldest; null keys are equal to each other; rows that
    tie on the version are ordered by ``ties`` (descending), else any of them is
    kept, which makes no difference where ties are identical rows.  The row
    limit is applied before the shuffle too, so a key with many versions sends
    one row per task.
    """
    order: list[Column] = [F.col(version).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties or [])]
    return _first(df, Window.partitionBy(*keys).orderBy(*order))


def latest_in_blocks(df: DataFrame, entity: str, position: str, version: str, block: int = BLOCK) -> DataFrame:
    """``latest`` by (entity, position), laid out for ordered scans: one shuffle serves both.

    Adds the column ``block`` (position div ``block``).  Rows of a block are in
    one partition, next to each other, ordered by position.  Rows without an
    entity or a position have no place in an order and are left out.
    """
    placed = df.where(F.col(entity).isNotNull() & F.col(position).isNotNull())
    placed = placed.withColumn("block", block_of(position, block))
    order = Window.partitionBy(entity, "block", position).orderBy(F.col(version).desc_nulls_last())
    return _first(placed.repartition(entity, "block"), order)


def block_of(position: str, block: int = BLOCK) -> Column:
    """The block that a position is in."""
    return F.floor(F.col(position) / F.lit(block)).cast("int")


def _first(df: DataFrame, order: object) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
