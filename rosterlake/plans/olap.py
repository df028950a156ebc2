"""Star schema: department, project, date and employee (type 2) dimensions, review facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import cleanse
from rosterlake.functions.labels import full_name
from rosterlake.operators.keys import (
    assign_dense_keys,
    assign_keys,
    by_block,
    date_key,
    number_blocks,
)
from rosterlake.operators.merge import insert_ignore, keep_one
from rosterlake.operators.timeline import open_end
from rosterlake.plans.oltp import prefer_current
from rosterlake.schemas import OLAP, SOURCE_KEY
from rosterlake.session import materialise
from rosterlake.sources.seeds import unknown_project

UNKNOWN_PROJECT_KEY = 1
_FACT = OLAP["fact_performance_reviews"].columns
_MEASURES = _FACT[5:]


def dim_department(departments: DataFrame) -> DataFrame:
    return assign_keys(departments, ["department_id"], "dept_key").select(
        *OLAP["dim_department"].columns
    )


def dim_project(projects: DataFrame, since: str = "2010-01-01") -> DataFrame:
    """Key 1 is the unknown member, the projects follow."""
    keyed = assign_keys(projects, ["project_id"], "project_key", start=UNKNOWN_PROJECT_KEY + 1)
    columns = OLAP["dim_project"].columns
    return unknown_project(projects.sparkSession, since).unionByName(keyed.select(*columns))


def extend_dim_date(existing: DataFrame, days: DataFrame) -> DataFrame:
    """Add the days the calendar does not have yet."""
    return insert_ignore(existing, days, ["date_key"])


def populate_dim_date(existing: DataFrame, days: DataFrame) -> DataFrame:
    """The calendar as it is, or all days where it is empty. The test is a scalar subquery of the
    plan: the days are generated only if it holds."""
    held = existing.agg(F.count(F.lit(1))).scalar()
    return existing.unionByName(days.filter(held == 0))


def dedup_staging(staging: DataFrame) -> DataFrame:
    """One row per employee and start date."""
    rows = staging.filter("employee_id IS NOT NULL AND effective_start_date IS NOT NULL")
    return keep_one(rows, ["employee_id", "effective_start_date"], prefer_current())


def employee_versions(staging: DataFrame) -> DataFrame:
    """Deduplicated, cleansed versions with recomputed end date, current flag and ``emp_key``.

    The review measures ride along, so that reviews and facts of the same load need no join
    back to the dimension. Dedup, LEAD and keys run over the columns they need; the chosen rows
    get the others by one hash join, so that whole rows are shuffled once and never sorted. One
    exchange and one sort serve the LEAD and the keys; after the dedup an employee has at most one
    row per day, which bounds the window and the blocks.
    """
    on_day = ["employee_id", "effective_start_date"]
    rows = dedup_staging(staging.select(*on_day, "is_current", SOURCE_KEY))
    by_start = Window.partitionBy("__block", "employee_id").orderBy("effective_start_date")
    following = F.lead("effective_start_date").over(by_start)
    versions = (
        by_block(rows, "employee_id")
        .withColumn("__following", following)
        .withColumn("effective_end_date", F.coalesce("__following", open_end()))
        .withColumn("is_current", F.when(F.col("__following").isNull(), 1).otherwise(0))
        .drop("__following")
    )
    keyed = number_blocks(versions, on_day, "emp_key")
    return _with_staged_columns(keyed, staging)


def _with_staged_columns(keyed: DataFrame, staging: DataFrame) -> DataFrame:
    """Keyed versions with the cleansed columns of their staged rows.

    A version is one row of staging by its employee, day and source row number, so neither side of
    the join is skewed. Where staging repeats a source row number, one of its rows stays.
    """
    chosen = keyed.select(
        F.col("employee_id").alias("__employee"),
        F.col("effective_start_date").alias("__start"),
        F.col(SOURCE_KEY).alias("__source"),
        "effective_end_date",
        "is_current",
        "emp_key",
    )
    staged = staging.select(
        "employee_id",
        "effective_start_date",
        *cleanse.aliased(cleanse.employee_columns()),
        *cleanse.aliased(cleanse.review_columns()),
        SOURCE_KEY,
    )
    same = (
        (F.col("employee_id") == F.col("__employee"))
        & (F.col("effective_start_date") == F.col("__start"))
        & F.col(SOURCE_KEY).eqNullSafe(F.col("__source"))
    )
    versions = staged.join(chosen.hint("shuffle_hash"), same).drop("__employee", "__start", "__source", SOURCE_KEY)
    versions = materialise(versions, "versions")
    if versions.count() > chosen.count():
        versions = keep_one(versions, ["emp_key"], [F.col(c) for c in versions.columns])
    return versions


def dim_employee(versions: DataFrame) -> DataFrame:
    return versions.select(*OLAP["dim_employee"].columns)


def dim_employee_v1(staging: DataFrame) -> DataFrame:
    """Staged rows as they are, staged end date and current flag included."""
    staged = {
        "full_name": full_name("first_name", "last_name"),
        "job_role": F.col("JobRole"),
        "job_level": F.col("JobLevel"),
        "monthly_income": F.col("MonthlyIncome"),
        "attrition": F.col("Attrition"),
    }
    rows = staging.select(
        *[staged.get(c, F.col(c)).alias(c) for c in OLAP["dim_employee"].columns if c != "emp_key"],
        SOURCE_KEY,
    )
    order = ["employee_id", "effective_start_date", SOURCE_KEY]
    return assign_keys(rows, order, "emp_key").select(*OLAP["dim_employee"].columns)


def primary_projects(assignments: DataFrame, dim_project: DataFrame) -> DataFrame:
    """Latest assignment per employee, as (employee_id, project_key)."""
    known = assignments.join(dim_project.select("project_id", "project_key"), "project_id")
    latest = keep_one(known, ["employee_id"], [F.desc("assigned_date"), F.desc("assignment_id")])
    return latest.select("employee_id", "project_key")


def _with_star_keys(rows: DataFrame, dim_department: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Department and date keys; rows without either are dropped."""
    return (
        rows.join(dim_department.select("department_id", "dept_key"), "department_id")
        .withColumn("review_date_key", date_key(F.col("effective_start_date")))
        .join(
            dim_date.select(F.col("date_key").alias("review_date_key")),
            "review_date_key",
            "left_semi",
        )
    )


def _or_unknown(project_key: Column) -> Column:
    return F.coalesce(project_key, F.lit(UNKNOWN_PROJECT_KEY).cast("long"))


def _finish_facts(keyed: DataFrame, primary: DataFrame) -> DataFrame:
    return (
        keyed.join(primary, "employee_id", "left")
        .withColumn("project_key", _or_unknown(F.col("project_key")))
        .select(*_FACT)
    )


def fact_reviews(
    staging: DataFrame,
    dim_employee: DataFrame,
    dim_department: DataFrame,
    dim_project: DataFrame,
    dim_date: DataFrame,
    assignments: DataFrame,
) -> DataFrame:
    """One fact per employee and start date, tied to the highest version key of that day."""
    reviews = dedup_staging(staging).select(
        "employee_id",
        "effective_start_date",
        "department_id",
        *cleanse.aliased(cleanse.review_columns()),
        cleanse.clean_income().alias("monthly_income"),
    )
    on_day = ["employee_id", "effective_start_date"]
    version = dim_employee.groupBy(*on_day).agg(F.max("emp_key").alias("emp_key"))
    rows = _with_star_keys(reviews, dim_department, dim_date).join(version, on_day)
    rows = rows.select(
        "employee_id", "emp_key", "dept_key", "review_date_key", *_MEASURES
    )
    keyed = assign_dense_keys(rows, "emp_key", "review_fact_id")
    return _finish_facts(keyed, primary_projects(assignments, dim_project))


def fact_reviews_of_versions(
    versions: DataFrame,
    dim_department: DataFrame,
    dim_project: DataFrame,
    dim_date: DataFrame,
    assignments: DataFrame,
) -> DataFrame:
    """`fact_reviews` when the dimension was built from these very versions: no version join."""
    rows = _with_star_keys(versions, dim_department, dim_date).select(
        "employee_id", "emp_key", "dept_key", "review_date_key", *_MEASURES
    )
    keyed = assign_dense_keys(rows, "emp_key", "review_fact_id")
    return _finish_facts(keyed, primary_projects(assignments, dim_project))


def reviews_of_versions(versions: DataFrame, employees: DataFrame) -> DataFrame:
    """PERFORMANCE_REVIEWS from the versions of the same load, in version order."""
    rows = versions.select("emp_key", "employee_id", "effective_start_date", *_MEASURES[:-1])
    known = rows.join(employees.select("employee_id"), "employee_id", "left_semi")
    keyed = assign_dense_keys(known, "emp_key", "review_id")
    return keyed.select(
        "review_id",
        "employee_id",
        F.col("effective_start_date").alias("review_date"),
        *_MEASURES[:-1],
    )


def fact_reviews_v1(
    staging: DataFrame,
    dim_employee: DataFrame,
    dim_department: DataFrame,
    dim_project: DataFrame,
    assignments: DataFrame,
) -> DataFrame:
    """The fanning-out load: one fact per staged row and assignment of its employee.

    The dimension holds one version per employee and day, so rows multiply by projects only.
    """
    version = dim_employee.select("employee_id", "effective_start_date", "emp_key")
    project = assignments.select("employee_id", "project_id").join(
        dim_project.select("project_id", "project_key"), "project_id", "left"
    ).select("employee_id", "project_key")
    # Versions fan out before they meet the staged rows, which are shuffled once and never sorted.
    version = version.join(project, "employee_id", "left")
    return (
        staging.join(version.hint("shuffle_hash"), ["employee_id", "effective_start_date"])
        .join(dim_department.select("department_id", "dept_key"), "department_id")
        .select(
            SOURCE_KEY,
            "emp_key",
            "dept_key",
            _or_unknown(F.col("project_key")).alias("project_key"),
            date_key(F.col("effective_start_date")).alias("review_date_key"),
            *cleanse.aliased(cleanse.raw_review_columns()),
            F.col("MonthlyIncome").alias("monthly_income"),
        )
    )
