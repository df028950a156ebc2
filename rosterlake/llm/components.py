"""Connected components of a graph that no task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Alternating large and small stars: every round links the larger (large star) or the smaller
    (small star) neighbours of each node to the least one. The minimum of a node is aggregated
    before the shuffle and returns by a join, which adaptive execution splits for hot nodes. Each
    round is written, so that a lost executor costs one round at most.
    """
    distinct = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, before = materialise(distinct.distinct(), name), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return (
                current.select(F.col("a").alias("node"), F.col("b").alias("component"))
                .union(current.select("b", "b"))
                .distinct()
            )
        before = state
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialise(small.union(down.select("a", "m")).distinct(), name)
