"""Keep-one dedup and snapshot merges (insert-ignore, upsert)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list, order_by: list) -> DataFrame:
    """First row per key. Catalyst puts a group limit in front of the shuffle, so a hot key
    sends one row per map task and never gathers in one place."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("__rn", rank).filter("__rn = 1").drop("__rn")


def top_n_per_group(df: DataFrame, keys: list[str], order_by: list, n: int, rank: str) -> DataFrame:
    """Rows ranked 1..n per group, in a total order, selected in two stages for every n.

    Each group is first cut to n rows within the parts of the input, one part a partition, and the
    survivors of the parts are ranked: no task sorts more of a group than a partition's rows, or n
    rows of every part.
    """
    in_part = Window.partitionBy(*keys, "__part").orderBy(*order_by)
    survivors = (
        df.withColumn("__part", F.spark_partition_id())
        .withColumn("__rn", F.row_number().over(in_part))
        .filter(F.col("__rn") <= n)
        .drop("__rn", "__part")
    )
    in_group = Window.partitionBy(*keys).orderBy(*order_by)
    return survivors.withColumn(rank, F.row_number().over(in_group)).filter(F.col(rank) <= n)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one per key, appended to ``existing``."""
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def split_known(df: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key exists, rows whose key does not)."""
    ids = known.select(key)
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")
