"""Bulk input checks with quarantine, and integrity reports over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.operators.timeline import open_end
from rosterlake.schemas import TABLES


def with_errors(df: DataFrame, errors: Column) -> DataFrame:
    return df.withColumn("errors", errors)


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with their errors)."""
    checked = with_errors(df, errors)
    accepted = checked.filter(F.size("errors") == 0).drop("errors")
    return accepted, checked.filter(F.size("errors") > 0)


def validate_names(df: DataFrame, column: str, label: str) -> DataFrame:
    return with_errors(df, rules.name_errors(F.col(column), label))


def validate_phones(df: DataFrame, column: str = "phone_number") -> DataFrame:
    return with_errors(df, rules.phone_errors(F.col(column)))


def validate_emails(df: DataFrame, column: str = "email") -> DataFrame:
    return with_errors(df, rules.email_errors(F.col(column)))


def validate_onboarding(df: DataFrame, today: Column) -> DataFrame:
    return with_errors(df, rules.onboarding_errors(today))


def validate_assignments(df: DataFrame) -> DataFrame:
    return with_errors(df, rules.assignment_errors())


def validate_role_updates(df: DataFrame) -> DataFrame:
    return with_errors(df, rules.role_update_errors())


def validate_reviews(df: DataFrame) -> DataFrame:
    return with_errors(df, rules.review_errors())


def error_counts(checked: DataFrame) -> DataFrame:
    """Rows per message."""
    messages = checked.select(F.explode("errors").alias("error"))
    return messages.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# --- integrity of the stored tables ------------------------------------------------------


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counts(df: DataFrame, label: str, conditions: dict[str, Column]) -> DataFrame:
    """Rows per condition as (label, violations), all conditions in one pass."""
    counted = df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    names = [F.col(f"`{name}`") for name in conditions]
    return counted.unpivot([], names, label, "violations")


def _count_as(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(value).alias(name), "violations"
    )


def fk_violations(
    tables: dict[str, DataFrame], extra: dict[str, tuple[DataFrame, str, str, str]] | None = None
) -> DataFrame:
    """Violations per declared reference, and per reference of the incoming feeds in ``extra``.

    Keys are integers. Each child and each parent is read once for all its references. Parent keys
    are unique, or else a value that occurs n times in its parent counts n times where it is known,
    which adds nothing.
    """
    checks = [
        (f"{name}.{column}->{parent}", name, column, parent, key)
        for name, table in TABLES.items()
        for column, parent, key in table.references
    ]
    checks += [(f"{n}.{c}->{p}", n, c, p, k) for n, (_, c, p, k) in (extra or {}).items()]
    frames = {**tables, **{n: df for n, (df, *_) in (extra or {}).items()}}
    children: dict[str, list[tuple[str, str, str]]] = {}
    for label, child, column, parent, key in checks:
        children.setdefault(child, []).append((label, column, f"{parent}.{key}"))

    def reference(label: str, target: str, value: Column) -> Column:
        value = value.cast("long").alias("value")
        return F.struct(F.lit(label).alias("relation"), F.lit(target).alias("target"), value)

    # Every child is read once: its references as rows, counted per value before the join.
    values = []
    for name, references in children.items():
        rows = F.explode(F.array(*[reference(label, t, F.col(c)) for label, c, t in references]))
        given = frames[name].select(rows.alias("r")).select("r.*").filter("value IS NOT NULL")
        values.append(given.groupBy("relation", "target", "value").agg(F.count(F.lit(1)).alias("n")))
    targets = {(parent, key): None for _, _, _, parent, key in checks}
    keys = [
        tables[parent].select(
            F.lit(f"{parent}.{key}").alias("target"), F.col(key).cast("long").alias("value")
        )
        for parent, key in targets
    ]
    found = _union(keys).withColumn("known", F.lit(True))
    joined = _union(values).join(found, ["target", "value"], "left")
    broken = F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0))
    counted = joined.groupBy("relation").agg(broken.cast("long").alias("violations"))
    spark = tables[checks[0][1]].sparkSession
    labels = F.explode(F.array(*[F.lit(label) for label, *_ in checks])).alias("relation")
    none = spark.range(1).select(labels, F.lit(0).cast("long").alias("violations"))
    return none.unionByName(counted).groupBy("relation").agg(F.sum("violations").alias("violations"))


def unique_violations(
    tables: dict[str, DataFrame], extra: dict[str, tuple[DataFrame, list[str]]] | None = None
) -> DataFrame:
    """Number of key values that occur more than once, per primary and unique key."""
    checks = [
        (f"{name}({','.join(key)})", tables[name], list(key))
        for name, table in TABLES.items()
        for key in (table.primary_key, *table.unique)
    ]
    checks += [(f"{n}({','.join(k)})", df, k) for n, (df, k) in (extra or {}).items()]
    return _union(
        [
            _count_as(df.groupBy(*key).count().filter("count > 1"), "unique_key", label)
            for label, df, key in checks
        ]
    )


def null_violations(
    tables: dict[str, DataFrame], extra: dict[str, tuple[DataFrame, list[str]]] | None = None
) -> DataFrame:
    """NULLs per required column, one pass per table."""
    checks = [(name, tables[name], list(table.required)) for name, table in TABLES.items()]
    checks += [(n, df, columns) for n, (df, columns) in (extra or {}).items()]
    return _union(
        [
            _counts(df, "required_column", {f"{name}.{c}": F.col(c).isNull() for c in columns})
            for name, df, columns in checks
        ]
    )


def scd2_integrity(dim: DataFrame) -> DataFrame:
    """Violations of the type 2 contract, by kind.

    Per employee and day the number of versions that start minus those that end is summed; the
    running total over the days is the number of versions in force, which has to be one from
    the first start to the open end. The window sees at most one row per employee and day.
    """
    current = F.col("is_current") == 1
    per_employee = dim.groupBy("employee_id").agg(F.count_if(current).alias("__current"))
    start, end = F.col("effective_start_date"), F.col("effective_end_date")
    forward = dim.filter(start <= end)
    changes = forward.select("employee_id", start.alias("day"), F.lit(1).alias("step")).unionByName(
        forward.select("employee_id", end.alias("day"), F.lit(-1).alias("step"))
    )
    changes = changes.groupBy("employee_id", "day").agg(F.sum("step").alias("step"))
    by_day = Window.partitionBy("employee_id").orderBy("day")
    in_force = changes.withColumn("versions", F.sum("step").over(by_day)).filter(
        F.col("day") < open_end()
    )
    counts = F.col("__current")
    reports = [
        _counts(per_employee, "kind", {"no_current": counts == 0, "multiple_current": counts > 1}),
        _counts(
            dim,
            "kind",
            {
                "open_end_not_current": (end == open_end()) != current,
                "negative_length": start > end,
                "zero_length": start == end,
            },
        ),
        _counts(in_force, "kind", {"gap": F.expr("versions < 1"), "overlap": F.expr("versions > 1")}),
    ]
    return _union(reports)
