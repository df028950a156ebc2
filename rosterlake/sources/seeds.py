"""Literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlake.schemas import OLAP, OLTP

# The five seed projects, in key order.
_PROJECTS = """
    (1, 'Cloud Infrastructure Modernization', 2, '2024-01-15', 500000.00),
    (2, 'Enterprise AI Assistant Upgrade', 2, '2024-06-01', 350000.00),
    (3, 'Global Sales ERP Integration', 1, '2025-02-10', 450000.00),
    (4, 'HR Payroll Automation & Analytics', 3, '2025-09-01', 200000.00),
    (5, 'Customer Portal 2.0 Redesign', 1, '2026-01-05', 150000.00)
"""
# Fixed value: the member for reviews without a project.
_UNKNOWN_PROJECT = "(1, 0, 'Unassigned / Operational Task', '{since}', '9999-12-31', 0.00)"


def seed_projects(spark: SparkSession) -> DataFrame:
    rows = spark.sql(
        f"SELECT *, NULL AS end_date FROM VALUES {_PROJECTS} "
        "AS p(project_id, project_name, department_id, start_date, budget)"
    )
    return _typed(rows, OLTP["projects"])


def unknown_project(spark: SparkSession, since: str = "2010-01-01") -> DataFrame:
    names = ", ".join(OLAP["dim_project"].columns)
    rows = spark.sql(f"SELECT * FROM VALUES {_UNKNOWN_PROJECT.format(since=since)} AS p({names})")
    return _typed(rows, OLAP["dim_project"])


def _typed(rows: DataFrame, table) -> DataFrame:
    return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in table.schema.fields])
