"""Mixing sources to target weights, by sampling documents without replacement.

Every source has a weight, and the weights share out the size of the mix; a target stops at
`most_epochs` times its source's size, and the excess goes to the others by weight until none is
above. Within a source the order of documents is the one of Efraimidis and Spirakis: exponential
keys -ln(u) / quality, least first, u fixed by the id and the seed, so that better documents tend to
come earlier. A source's target is met by complete epochs, in which every document counts once, and
then by the prefix of the order that fills the rest; the document at the edge of the budget gives
the words that the budget still holds, so that the sizes meet the target to less than one word.

The order is global and range-partitioned, and prefix sums are taken within partitions and shifted
by the sums of the partitions before: a source may hold any share of the rows, and rows that repeat
an id are spread like others. The levels of the water-filling are one aggregation each over the
table of sources, which stays a table.

Null or blank text has size 0 and takes 0. A null source is a source of its own, the last one. Null
ids share one u and are ordered by size. Without documents the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.columns import words_of
from rosterlake.operators.keys import assign_keys
from rosterlake.session import materialise

_BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in the order of their names, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Size of the mix in percent of all sizes.
    percent: int = 100
    most_epochs: int = 3
    seed: str = "mix"
    #: Quality of a text without letters.
    least_quality: float = 0.05


def quality(text: Column, least: float) -> Column:
    """Share of letters among the characters that are no white space, `least` at least."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    signs = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(least), F.when(signs > 0, letters / signs).otherwise(0.0))


def sample_key(id_text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u in (0, 1) from 48 bits of the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def targets(sources: DataFrame, rule: Mix) -> DataFrame:
    """(source, source_size, target, epochs, rest) from (source, source_size); `rest` words are
    sampled after the epochs."""
    numbered = assign_keys(sources, [F.col("source").asc_nulls_last()], "nr")
    listed = F.array(*map(F.lit, rule.weights))
    weight = F.element_at(listed, ((F.col("nr") - 1) % len(rule.weights) + 1).cast("int")).cast("long")
    table = materialise(numbered.select("source", "source_size", weight.alias("weight")), "mix-sources")
    cap = F.col("source_size") * rule.most_epochs
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * rule.percent // 100
    rest, weights = total, table.agg(F.sum("weight")).first()[0] or 1
    while True:  # each round caps the sources above the level that the former round reached
        exact = [x.cast("decimal(19,0)") for x in (F.col("weight"), F.lit(rest), cap, F.lit(weights))]
        capped = exact[0] * exact[1] > exact[2] * exact[3]
        row = table.agg(
            F.sum(F.when(capped, cap).otherwise(0)).alias("full"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        left, still = total - (row["full"] or 0), row["open"] or 0
        if not still or (left, still) == (rest, weights):
            break
        rest, weights = left, still
    share = F.col("weight") * F.lit(rest) / F.lit(weights)
    target = F.when(capped, cap.cast("double")).otherwise(share.cast("double"))
    epochs = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("long")
    found = table.select("source", "source_size", target.alias("target"), epochs.alias("epochs"))
    budget = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    return found.withColumn("rest", budget)


def mix(
    docs: DataFrame, rule: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(id, source, size, source_size, target, taken, key) of every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        sample_key(F.col(id_col).cast("string"), quality(text, rule.least_quality), rule.seed).alias("key"),
    )
    order = [F.col("source").asc_nulls_last(), "key", F.col("id").asc_nulls_last(), "size", "row"]
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    ordered = sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "mix-order")
    pieces = ordered.groupBy("source", "part").agg(F.sum("size").alias("words"))
    pieces = materialise(pieces, "mix-pieces")
    sources = targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), rule)
    # Partitions that hold a source: few for each, at most the number of partitions for a hot one.
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(*_BEFORE))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    placed = (
        pieces.withColumn("before", F.coalesce(earlier, F.lit(0)))
        .alias("l")
        .join(sources.alias("r"), same)
        .select("l.source", "part", "before", "source_size", "target", "epochs", "rest")
    )
    within = F.sum("size").over(Window.partitionBy("part", "source").orderBy(*order[1:]).rowsBetween(*_BEFORE))
    rows = ordered.withColumn("within", F.coalesce(within, F.lit(0)))
    joined = rows.alias("l").join(placed.alias("r"), (F.col("l.part") == F.col("r.part")) & same)
    left = F.col("rest") - F.col("before") - F.col("within")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select(
        F.col("id").alias(id_col), "l.source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key"
    )
