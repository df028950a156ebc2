"""Per-key timelines that stay bounded when one key owns most of the rows.

Windows here only ever run over *distinct days* of a key, at most one row per calendar day.
The rows themselves meet the result again through an equi-join on (key, day), which adaptive
execution can split when one pair is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def open_end() -> Column:
    return F.lit(OPEN_END).cast("date")


def with_successor_day(
    df: DataFrame, key: str, day: str, tie_break: list[str], out: str
) -> DataFrame:
    """LEAD(day) per key in the order (day, tie_break...), NULL for the last row of the key.

    All rows of one (key, day) but the last are followed by a row of that same day; the last
    one by the next distinct day.
    """
    # A single column aggregates by hash, a struct only by sorting.
    order = F.struct(*tie_break) if len(tie_break) > 1 else F.col(tie_break[0])
    days = df.groupBy(key, day).agg(F.max(order).alias("__last"))
    by_day = Window.partitionBy(key).orderBy(day)
    days = days.withColumn("__next", F.lead(day).over(by_day))
    is_last = order == F.col("__last")
    return (
        df.join(days, [key, day])
        .withColumn(out, F.when(is_last, F.col("__next")).otherwise(F.col(day)))
        .drop("__last", "__next")
    )


def version_as_of(
    probes: DataFrame, versions: DataFrame, key: str, day: str, start: str, end: str, version: str
) -> DataFrame:
    """Left point-in-time join: the version with ``start <= day < end``, else NULL.

    Versions of positive length do not overlap, so a key has at most one per day. The distinct
    days asked for are put between them, the latest version is carried forward, and the answer
    returns to the probes by (key, day). Work is linear in both inputs; pairs of one key are
    never enumerated.
    """
    held = versions.filter(F.col(start) < F.col(end)).select(
        key,
        F.col(start).alias("__day"),
        F.col(version).alias("__version"),
        F.col(end).alias("__end"),
    )
    asked = probes.select(key, F.col(day).alias("__day")).filter(F.col("__day").isNotNull()).distinct()
    merged = held.withColumn("__asked", F.lit(False)).unionByName(
        asked.withColumn("__asked", F.lit(True)), allowMissingColumns=True
    )
    # A version that starts on the day asked for comes first.
    in_order = Window.partitionBy(key).orderBy("__day", "__asked", "__version")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.select(
        key,
        F.col("__day").alias(day),
        "__asked",
        F.last("__version", ignorenulls=True).over(so_far).alias("__version"),
        F.last("__end", ignorenulls=True).over(so_far).alias("__end"),
    )
    answers = carried.filter("__asked").select(
        key, day, F.when(F.col("__end") > F.col(day), F.col("__version")).alias(version)
    )
    return probes.join(answers, [key, day], "left")
