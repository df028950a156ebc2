"""Cleansing expressions over staging columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions.labels import full_name

# What a missing staging value becomes.
DEFAULT_ATTRITION = "No"
DEFAULT_REASON = "Initial Onboarding"
DEFAULT_SCORE = 3
ZERO_MONEY = 0.00


def _or(column: str, default, type_name: str) -> Column:
    return F.coalesce(F.col(column), F.lit(default).cast(type_name))


def trimmed(column: str) -> Column:
    return F.trim(F.col(column))


def clean_email() -> Column:
    return F.lower(trimmed("email"))


def clean_income() -> Column:
    return _or("MonthlyIncome", ZERO_MONEY, "decimal(10,2)")


def clean_attrition() -> Column:
    return _or("Attrition", DEFAULT_ATTRITION, "string")


def job_level() -> Column:
    return F.col("JobLevel").try_cast("int")


def employee_columns() -> dict[str, Column]:
    """Cleansed columns of the employee dimension."""
    return {
        "full_name": full_name(trimmed("first_name"), trimmed("last_name")),
        "email": clean_email(),
        "job_role": trimmed("JobRole"),
        "job_level": job_level(),
        "monthly_income": clean_income(),
        "department_id": F.col("department_id"),
        "hire_date": F.col("hire_date"),
        "change_reason": _or("change_reason", DEFAULT_REASON, "string"),
        "attrition": clean_attrition(),
    }


def review_columns() -> dict[str, Column]:
    """Cleansed review measures."""
    return {
        "environment_satisfaction": _or("EnvironmentSatisfaction", DEFAULT_SCORE, "int"),
        "job_satisfaction": _or("JobSatisfaction", DEFAULT_SCORE, "int"),
        "relationship_satisfaction": _or("RelationshipSatisfaction", DEFAULT_SCORE, "int"),
        "job_involvement": _or("JobInvolvement", DEFAULT_SCORE, "int"),
        "performance_rating": _or("PerformanceRating", DEFAULT_SCORE, "int"),
        "percent_salary_hike": _or("PercentSalaryHike", ZERO_MONEY, "decimal(5,2)"),
    }


def raw_review_columns() -> dict[str, Column]:
    """Review measures as staged."""
    return {
        "environment_satisfaction": F.col("EnvironmentSatisfaction"),
        "job_satisfaction": F.col("JobSatisfaction"),
        "relationship_satisfaction": F.col("RelationshipSatisfaction"),
        "job_involvement": F.col("JobInvolvement"),
        "performance_rating": F.col("PerformanceRating"),
        "percent_salary_hike": F.col("PercentSalaryHike"),
    }


def aliased(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]
