"""Operational layer: departments, jobs, employees, projects, assignments, reviews.

Functions without a suffix are the deduplicating, cleansing load; ``*_v1`` the earlier one
that copies staging as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import cleanse
from rosterlake.functions.labels import department_location, department_name
from rosterlake.operators.keys import assign_dense_keys, assign_keys, by_block, number_blocks
from rosterlake.operators.merge import keep_one
from rosterlake.schemas import OLTP, SOURCE_KEY
from rosterlake.session import materialise
from rosterlake.sources.seeds import seed_projects


def prefer_current() -> list[Column]:
    """Which of several staged rows of one key wins."""
    return [F.desc("is_current"), F.desc(SOURCE_KEY)]


_COPIED = {
    "phone_number": "phone_number", "age": "Age", "gender": "Gender",
    "marital_status": "MaritalStatus", "education": "Education",
    "education_field": "EducationField", "hire_date": "hire_date",
    "department_id": "department_id", "job_id": "job_id",
    "distance_from_home": "DistanceFromHome", "total_working_years": "TotalWorkingYears",
}


def departments(staging: DataFrame) -> DataFrame:
    code = F.col("department_id")
    rows = staging.filter(code.isNotNull()).select("department_id", "Department", SOURCE_KEY)
    return keep_one(rows, ["department_id"], [F.col(SOURCE_KEY)]).select(
        "department_id",
        department_name(code, F.col("Department")).alias("department_name"),
        department_location(code).alias("location"),
    )


def departments_v1(staging: DataFrame) -> DataFrame:
    code = F.col("department_id")
    return staging.select("department_id").distinct().select(
        "department_id",
        department_name(code).alias("department_name"),
        department_location(code, default=False).alias("location"),
    )


def distinct_jobs(staging: DataFrame) -> DataFrame:
    role, level = F.col("JobRole"), F.col("JobLevel")
    rows = staging.filter(role.isNotNull() & level.isNotNull())
    return rows.select(F.trim(role).alias("job_role"), cleanse.job_level().alias("job_level")).distinct()


def distinct_jobs_v1(staging: DataFrame) -> DataFrame:
    return staging.select(
        F.col("JobRole").alias("job_role"), F.col("JobLevel").alias("job_level")
    ).distinct()


def with_job_ids(jobs: DataFrame) -> DataFrame:
    return assign_keys(jobs, ["job_role", "job_level"], "job_id").select(*OLTP["jobs"].columns)


def employees(staging: DataFrame, jobs: DataFrame, departments: DataFrame) -> DataFrame:
    """Latest current row per employee with a known job and department; managers are NULL."""
    rows = (
        staging.filter("is_current = 1")
        .withColumn("__role", cleanse.trimmed("JobRole"))
        .join(
            jobs,
            (F.col("__role") == jobs["job_role"]) & (F.col("JobLevel") == jobs["job_level"]),
        )
        .join(departments.select("department_id"), "department_id", "left_semi")
    )
    latest = keep_one(
        rows,
        ["employee_id"],
        [F.desc("is_current"), F.desc("effective_start_date"), F.desc(SOURCE_KEY)],
    )
    cleansed = {
        "first_name": cleanse.trimmed("first_name"),
        "last_name": cleanse.trimmed("last_name"),
        "email": cleanse.clean_email(),
        "monthly_income": cleanse.clean_income(),
        "attrition": cleanse.clean_attrition(),
    }
    return _employee_rows(latest, cleansed)


def employees_v1(staging: DataFrame, jobs: DataFrame) -> DataFrame:
    rows = staging.filter("is_current = 1").join(
        jobs,
        (F.col("JobRole") == jobs["job_role"]) & (F.col("JobLevel") == jobs["job_level"]),
    )
    names = ("first_name", "last_name", "email")
    as_staged = {name: F.col(name) for name in names}
    as_staged |= {"monthly_income": F.col("MonthlyIncome"), "attrition": F.col("Attrition")}
    return _employee_rows(rows, as_staged)


def _employee_rows(rows: DataFrame, own: dict) -> DataFrame:
    columns = {"employee_id": F.col("employee_id"), "manager_id": F.lit(None).cast("int"), **own}
    columns |= {target: F.col(source) for target, source in _COPIED.items()}
    return rows.select(*[columns[name].alias(name) for name in OLTP["employees"].columns])


def with_managers(employees: DataFrame) -> DataFrame:
    """Lowest id divisible by five manages those of its department that are not."""
    lowest = (
        employees.filter("employee_id % 5 = 0")
        .groupBy("department_id")
        .agg(F.min("employee_id").alias("__manager"))
    )
    # Written, so that the planner broadcasts it by its real size or not at all.
    managed = employees.join(materialise(lowest, "managers"), "department_id", "left")
    manager = F.when(F.col("employee_id") % 5 != 0, F.col("__manager"))
    return managed.withColumn("manager_id", manager).select(*employees.columns)


def with_managers_v1(employees: DataFrame) -> DataFrame:
    """Lowest other id of the department, again for ids not divisible by five."""
    ids = employees.select("department_id", "employee_id").filter("department_id IS NOT NULL")
    first = ids.groupBy("department_id").agg(F.min("employee_id").alias("__first"))
    first = materialise(first, "managers")
    second = (
        ids.join(first, "department_id")
        .filter("employee_id > __first")
        .groupBy("department_id")
        .agg(F.min("employee_id").alias("__second"))
    )
    two = materialise(first.join(second, "department_id", "left"), "managers")
    own = F.col("employee_id")
    other = F.when(own == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))
    return (
        employees.join(two, "department_id", "left")
        .withColumn("manager_id", F.when(own % 5 != 0, other))
        .select(*employees.columns)
    )


def projects(spark: SparkSession, departments: DataFrame) -> DataFrame:
    """Seed projects of the departments that exist."""
    return seed_projects(spark).join(departments.select("department_id"), "department_id", "left_semi")


def project_assignments(employees: DataFrame, projects: DataFrame) -> DataFrame:
    """Every third employee works on the department's latest project."""
    primary = keep_one(
        projects, ["department_id"], [F.desc("start_date"), F.desc("project_id")]
    ).select("department_id", "project_id")
    primary = materialise(primary, "primary-projects")
    return _assignments(employees, primary)


def project_assignments_v1(employees: DataFrame, projects: DataFrame) -> DataFrame:
    """Every third employee works on all projects of the department."""
    return _assignments(employees, projects.select("department_id", "project_id"))


def _assignments(employees: DataFrame, by_department: DataFrame) -> DataFrame:
    rows = (
        employees.filter("employee_id % 3 = 0")
        .join(by_department, "department_id")
        .select(
            "employee_id",
            "project_id",
            F.lit("Contributor").alias("role_in_project"),
            F.lit(100).alias("allocation_percentage"),
            F.col("hire_date").alias("assigned_date"),
        )
    )
    return assign_dense_keys(rows, "employee_id", "assignment_id", then_by=["project_id"]).select(
        *OLTP["project_assignments"].columns
    )


def performance_reviews(staging: DataFrame, employees: DataFrame) -> DataFrame:
    """One cleansed review per employee and start date, for known employees."""
    # Deduplicated first: the join then meets at most one row per employee and day.
    one = keep_one(staging, ["employee_id", "effective_start_date"], prefer_current())
    known = one.join(employees.select("employee_id"), "employee_id", "left_semi")
    reviews = _reviews(known, cleanse.review_columns())
    keyed = number_blocks(
        by_block(reviews, "employee_id"), ["employee_id", "review_date"], "review_id"
    )
    return keyed.select(*OLTP["performance_reviews"].columns)


def performance_reviews_v1(staging: DataFrame) -> DataFrame:
    """Every staged row."""
    reviews = _reviews(staging, cleanse.raw_review_columns())
    keyed = assign_keys(reviews, ["employee_id", "review_date", SOURCE_KEY], "review_id")
    return keyed.select(*OLTP["performance_reviews"].columns)


def _reviews(rows: DataFrame, measures: dict) -> DataFrame:
    review_date = F.col("effective_start_date").alias("review_date")
    return rows.select("employee_id", review_date, *cleanse.aliased(measures), SOURCE_KEY)
