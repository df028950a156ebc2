"""Row replication, positional zips and version history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.labels import DEPARTMENTS
from rosterlake.operators.keys import assign_keys
from rosterlake.operators.timeline import open_end
from rosterlake.session import materialise

# Columns that carry no information in the raw file.
CONSTANT_COLUMNS = ("EmployeeCount", "StandardHours", "Over18")
FIRST_ID = 10001

# Fixed values of the history rules.
_MIN_CHANGE_DAYS = 180
_MAX_CHANGE_DAYS = 1095
_LONG_TENURE_DAYS = 365
_NOTICE_DAYS = 30
REASON_CURRENT = "Current Active State"
REASON_INITIAL = "Initial Onboarding"


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*CONSTANT_COLUMNS)


def replicate_to_target(
    base: DataFrame, order_by: list[str], target: int | float, key: str = "employee_id"
) -> DataFrame:
    """Repeat the base in its order until ``target`` rows (a float: that multiple of the base).

    Ids are first, first + 1, ... in (copy, position) order. The target rows are a range, so
    that work spreads whatever the size of the base; each meets the base row at its number
    modulo the base's size, by broadcast or sort as the size of the written base decides.
    """
    positioned = materialise(assign_keys(base, order_by, "__at", start=0), "replicate")
    size = positioned.count()
    rows = int(size * target) if isinstance(target, float) else target
    numbers = base.sparkSession.range(rows if size and rows > 0 else 0)
    numbers = numbers.select(F.col("id").alias("__id"), (F.col("id") % max(size, 1)).alias("__at"))
    id_ = (F.col("__id") + FIRST_ID).cast("long")
    return numbers.join(positioned, "__at").withColumn(key, id_).drop("__at", "__id")


def zip_rows(left: DataFrame, left_order: list, right: DataFrame, right_order: list) -> DataFrame:
    """Join two frames row by row, each in its own order."""
    return (
        assign_keys(left, left_order, "__row")
        .join(assign_keys(right, right_order, "__row"), "__row")
        .drop("__row")
    )


def change_date(hire_date: Column, today: Column, offset: Column) -> Column:
    """Day of the latest change: the wanted offset held inside the tenure, 180 days after the
    hire for short tenures."""
    tenure = F.datediff(today, hire_date)
    latest = F.least(tenure - _NOTICE_DAYS, F.lit(_MAX_CHANGE_DAYS))
    days = F.when(
        tenure > _LONG_TENURE_DAYS, F.least(F.greatest(offset, F.lit(_MIN_CHANGE_DAYS)), latest)
    ).otherwise(F.lit(_MIN_CHANGE_DAYS))
    return F.date_add(hire_date, days.cast("int"))


def expand_history(
    df: DataFrame,
    today: Column,
    has_history: Column,
    offset: Column,
    income_factor: Column,
    rotate: Column,
    reason: Column,
) -> DataFrame:
    """One current version per row, preceded by an expired one where there is history.

    The expired version has a reduced, truncated income, one level less (at least 1) and, where
    ``rotate`` holds, the next department.
    """
    change = change_date(F.col("hire_date"), today, offset)
    prior_income = F.floor(F.col("MonthlyIncome") * income_factor)
    prior_level = F.greatest(F.lit(1), F.col("JobLevel") - 1)
    next_department = F.col("department_id") % len(DEPARTMENTS) + 1

    def version(income, level, department, start, end, is_current, why) -> Column:
        return F.struct(
            income.cast("int").alias("MonthlyIncome"),
            level.cast("int").alias("JobLevel"),
            department.cast("int").alias("department_id"),
            start.alias("effective_start_date"),
            end.alias("effective_end_date"),
            F.lit(is_current).alias("is_current"),
            why.alias("change_reason"),
        )

    income, level, department = (F.col(c) for c in ("MonthlyIncome", "JobLevel", "department_id"))
    prior = version(
        prior_income, prior_level, F.when(rotate, next_department).otherwise(department),
        F.col("hire_date"), change, 0, reason,
    )
    latest = version(income, level, department, change, open_end(), 1, F.lit(REASON_CURRENT))
    only = version(
        income, level, department, F.col("hire_date"), open_end(), 1, F.lit(REASON_INITIAL)
    )
    versions = F.when(has_history, F.array(prior, latest)).otherwise(F.array(only))
    kept = [c for c in df.columns if c not in ("MonthlyIncome", "JobLevel", "department_id")]
    return df.withColumn("__version", F.explode(versions)).select(*kept, "__version.*")
