"""Row numbers and running sums over data too large for one window partition.

Rows are range-sorted once and staged.  ``monotonically_increasing_id`` then
names for every row the sorted block it sits in (upper bits) and its place
there (lower 33 bits).  Only one figure per block has to be summed up in one
place, so no task ever sees more than a block, however hot a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage

_BLOCK_BITS = 33


def sorted_blocks(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``df`` in global order with ``block`` and ``place`` (0-based) columns."""
    numbered = df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id())
    staged = stage(numbered, label)
    return staged.select(
        *df.columns,
        F.shiftright("_seq", _BLOCK_BITS).cast("int").alias("block"),
        F.col("_seq").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("place"),
    )


def dense_index(df: DataFrame, order: Sequence[Column], name: str, label: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in the global order.

    The offsets have one row per sorted block, a number bounded by the shuffle
    partitions of the sort, so broadcasting them is safe at any data size.
    """
    blocks = sorted_blocks(df, order, label)
    offsets = (
        blocks.groupBy("block")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("block", _before("rows", W.orderBy("block")).alias("offset"))
    )
    return blocks.join(F.broadcast(offsets), "block").select(
        *df.columns, (F.col("offset") + F.col("place")).alias(name)
    )


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    label: str,
) -> DataFrame:
    """Running sums within each group, the current row included.

    ``sums`` maps a new column to the expression it accumulates, nulls adding
    nothing; ``F.lit(1)`` gives a 1-based row number.  Groups may span any number of sorted blocks:
    the window inside runs per (group, block) and the total of the group's
    earlier blocks is added from a table with one row per (group, block).
    """
    group = list(group)
    wide = df.select("*", *[e.alias(f"_in_{n}") for n, e in sums.items()])
    blocks = sorted_blocks(wide, [F.col(g) for g in group] + list(order), label)
    totals = blocks.groupBy(*group, "block").agg(
        *[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums]
    )
    earlier = W.partitionBy(*group).orderBy("block")
    totals = totals.select(
        *group, "block", *[_before(f"_sum_{n}", earlier).alias(f"_base_{n}") for n in sums]
    )
    inside = (
        W.partitionBy(*group, "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    )
    local = blocks.select(
        "*",
        *[F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0)).alias(f"_run_{n}") for n in sums],
    )
    return local.join(totals, [*group, "block"]).select(
        *df.columns, *[(F.col(f"_base_{n}") + F.col(f"_run_{n}")).alias(n) for n in sums]
    )


def _before(column: str, window) -> Column:
    """Sum of ``column`` over the rows before the current one."""
    return F.coalesce(
        F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
