"""Surrogate keys 1..n in a given order, without moving the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import materialise

# monotonically_increasing_id() keeps the partition number above bit 33.
_SLOT_BITS = 33
_SLOT_MASK = (1 << _SLOT_BITS) - 1
DENSE_BLOCK = 16_384
BLOCK_IDS = 4096
# Blocks whose counts are summed up in one task.
_SUPERBLOCK = 65_536


def assign_keys(df: DataFrame, order_by: list, key: str, start: int | Column = 1) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in the total order ``order_by``.

    The frame is range-partitioned and sorted, written once with its slot numbers (so that
    both passes below see the same partitions even when tasks are retried), and every slot is
    shifted by the row count of the partitions before its own.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    slots = materialise(ordered.withColumn("__slot", F.monotonically_increasing_id()), f"keys-{key}")
    placed = slots.select(
        *df.columns,
        F.shiftright("__slot", _SLOT_BITS).alias("__block"),
        F.col("__slot").bitwiseAND(F.lit(_SLOT_MASK)).alias("__pos"),
    )
    return _shifted(placed, key, start)


def by_block(df: DataFrame, leading: str) -> DataFrame:
    """Rows with ``__block``, runs of `BLOCK_IDS` values of an INT column, one task per block.

    For tables in which a value of that column has a bounded number of rows. The 32 bits of the
    column bound the number of blocks.
    """
    return df.withColumn("__block", F.expr(f"{leading} div {BLOCK_IDS}")).repartition("__block")


def number_blocks(blocked: DataFrame, order_by: list[str], key: str) -> DataFrame:
    """`assign_keys` for a frame from `by_block` whose leading column comes first in the order.

    No sampling pass: the blocks are known beforehand. Windows within a value of the leading
    column can share the exchange.
    """
    in_block = Window.partitionBy("__block").orderBy(*order_by)
    placed = blocked.withColumn("__pos", F.row_number().over(in_block) - 1)
    return _shifted(materialise(placed, f"keys-{key}"), key, 1)


def assign_dense_keys(
    df: DataFrame, dense: str, key: str, start: int | Column = 1, then_by: list | None = None
) -> DataFrame:
    """`assign_keys` for frames ordered by an integer that is (nearly) gap-free and unique.

    Blocks of `DENSE_BLOCK` consecutive integers hold about that many rows, so the numbering needs
    one shuffle. The rows are written once, with their blocks, before they are counted and numbered.
    """
    blocked = materialise(df.withColumn("__block", F.expr(f"{dense} div {DENSE_BLOCK}")), f"keys-{key}")
    in_block = Window.partitionBy("__block").orderBy(dense, *(then_by or []))
    placed = blocked.withColumn("__pos", F.row_number().over(in_block) - 1)
    return _shifted(placed, key, start, blocked.select("__block"))


def _shifted(
    placed: DataFrame, key: str, start: int | Column, blocks: DataFrame | None = None
) -> DataFrame:
    """Positions within blocks to keys over all blocks.

    The offsets are written, so that the planner broadcasts them by their real size: planned from an
    estimate, the join would shuffle all rows, once for every reader of the result.
    """
    offsets = materialise(_offsets(placed.select("__block") if blocks is None else blocks), f"offsets-{key}")
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        placed.join(offsets, "__block")
        .withColumn(key, (F.col("__before") + F.col("__pos") + first).cast("long"))
        .drop("__block", "__pos", "__before")
    )


def _offsets(blocks: DataFrame) -> DataFrame:
    """Rows before each block, summed in two levels: within runs of blocks, and over the runs.

    Only the totals of runs, one row per `_SUPERBLOCK` blocks, meet in one task. The planner
    broadcasts the offsets or sorts and merges them, as their size decides.
    """
    counts = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__run", F.expr(f"__block div {_SUPERBLOCK}"))
    before = (Window.unboundedPreceding, -1)
    runs = counts.groupBy("__run").agg(F.sum("__n").alias("__total"))
    earlier_runs = F.sum("__total").over(Window.orderBy("__run").rowsBetween(*before))
    runs = runs.select("__run", F.coalesce(earlier_runs, F.lit(0)).alias("__base"))
    earlier = F.sum("__n").over(Window.partitionBy("__run").orderBy("__block").rowsBetween(*before))
    within = counts.withColumn("__within", F.coalesce(earlier, F.lit(0)))
    return within.join(runs, "__run").select("__block", (F.col("__base") + F.col("__within")).alias("__before"))


def next_key(df: DataFrame, key: str) -> int:
    """max + 1, or 1 for an empty table."""
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long")).first()[0]


def date_key(day: Column) -> Column:
    """YYYYMMDD as an integer."""
    return F.date_format(day, "yyyyMMdd").cast("int")
