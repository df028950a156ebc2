"""Declared tables: columns, required columns, keys and references."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# Column order and names are the staging file format (fixed values). Pay and raise carry
# decimals so that averages stay exact.
STAGING_DDL = """
employee_id INT, Age INT, Attrition STRING, BusinessTravel STRING, DailyRate INT,
Department STRING, DistanceFromHome INT, Education INT, EducationField STRING,
EnvironmentSatisfaction INT, Gender STRING, HourlyRate INT, JobInvolvement INT,
JobLevel INT, JobRole STRING, JobSatisfaction INT, MaritalStatus STRING,
MonthlyIncome DECIMAL(10,2), MonthlyRate INT, NumCompaniesWorked INT, OverTime STRING,
PercentSalaryHike DECIMAL(5,2), PerformanceRating INT, RelationshipSatisfaction INT,
StockOptionLevel INT, TotalWorkingYears INT, TrainingTimesLastYear INT, WorkLifeBalance INT,
YearsAtCompany INT, YearsInCurrentRole INT, YearsSinceLastPromotion INT,
YearsWithCurrManager INT, first_name STRING, last_name STRING, email STRING,
phone_number STRING, department_id INT, hire_date DATE, effective_start_date DATE,
effective_end_date DATE, is_current INT, change_reason STRING
"""


_TYPES = {"INT": T.IntegerType, "LONG": T.LongType, "STRING": T.StringType, "DATE": T.DateType}


def struct(columns: str) -> T.StructType:
    """'name TYPE, ...' as a schema, without needing a session at import time."""
    fields = []
    for name, kind, digits, scale in re.findall(r"(\w+) (\w+)(?:\((\d+),(\d+)\))?", columns):
        data_type = T.DecimalType(int(digits), int(scale)) if digits else _TYPES[kind]()
        fields.append(T.StructField(name, data_type))
    return T.StructType(fields)


STAGING = struct(STAGING_DDL)
# Source row number: the stable tie-break of every keep-one step.
SOURCE_KEY = "src_key"
STAGING_WITH_KEY = T.StructType(STAGING.fields + [T.StructField(SOURCE_KEY, T.LongType())])


@dataclass(frozen=True)
class Table:
    ddl: str
    primary_key: tuple[str, ...]
    required: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()  # (column, table, column)
    # Folders of the stored table: a declared column, the block of employee ids, the writing batch.
    partition_by: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return struct(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


OLTP = {
    "departments": Table(
        "department_id INT, department_name STRING, location STRING",
        ("department_id",),
        ("department_id", "department_name"),
    ),
    "jobs": Table(
        "job_id LONG, job_role STRING, job_level INT",
        ("job_id",),
        ("job_id", "job_role", "job_level"),
        unique=(("job_role", "job_level"),),
    ),
    "employees": Table(
        """employee_id INT, first_name STRING, last_name STRING, email STRING,
        phone_number STRING, age INT, gender STRING, marital_status STRING, education INT,
        education_field STRING, hire_date DATE, department_id INT, job_id LONG,
        manager_id INT, monthly_income DECIMAL(10,2), attrition STRING,
        distance_from_home INT, total_working_years INT""",
        ("employee_id",),
        ("employee_id", "first_name", "last_name", "email", "hire_date", "department_id", "job_id"),
        references=(
            ("department_id", "departments", "department_id"),
            ("job_id", "jobs", "job_id"),
            ("manager_id", "employees", "employee_id"),
        ),
        partition_by=("id_block",),
    ),
    "projects": Table(
        """project_id LONG, project_name STRING, department_id INT, start_date DATE,
        end_date DATE, budget DECIMAL(12,2)""",
        ("project_id",),
        ("project_id", "project_name", "department_id", "start_date"),
        references=(("department_id", "departments", "department_id"),),
    ),
    "project_assignments": Table(
        """assignment_id LONG, employee_id INT, project_id LONG, role_in_project STRING,
        allocation_percentage INT, assigned_date DATE""",
        ("assignment_id",),
        ("assignment_id", "employee_id", "project_id", "assigned_date"),
        references=(
            ("employee_id", "employees", "employee_id"),
            ("project_id", "projects", "project_id"),
        ),
        partition_by=("id_block",),
    ),
    "performance_reviews": Table(
        """review_id LONG, employee_id INT, review_date DATE, environment_satisfaction INT,
        job_satisfaction INT, relationship_satisfaction INT, job_involvement INT,
        performance_rating INT, percent_salary_hike DECIMAL(5,2)""",
        ("review_id",),
        ("review_id", "employee_id", "review_date"),
        references=(("employee_id", "employees", "employee_id"),),
    ),
}

OLAP = {
    "dim_department": Table(
        "dept_key LONG, department_id INT, department_name STRING, location STRING",
        ("dept_key",),
        ("dept_key", "department_id", "department_name"),
    ),
    "dim_project": Table(
        """project_key LONG, project_id LONG, project_name STRING, start_date DATE,
        end_date DATE, budget DECIMAL(12,2)""",
        ("project_key",),
        ("project_key", "project_id", "project_name"),
    ),
    "dim_date": Table(
        """date_key INT, full_date DATE, year INT, quarter INT, month INT, month_name STRING,
        day_of_month INT, day_of_week STRING""",
        ("date_key",),
        (
            "date_key", "full_date", "year", "quarter", "month", "month_name",
            "day_of_month", "day_of_week",
        ),
    ),
    "dim_employee": Table(
        """emp_key LONG, employee_id INT, full_name STRING, email STRING, job_role STRING,
        job_level INT, monthly_income DECIMAL(10,2), department_id INT, hire_date DATE,
        effective_start_date DATE, effective_end_date DATE, is_current INT,
        change_reason STRING, attrition STRING""",
        ("emp_key",),
        (
            "emp_key", "employee_id", "full_name", "email", "effective_start_date",
            "effective_end_date", "is_current",
        ),
        partition_by=("is_current", "id_block", "written_by"),
    ),
    "fact_performance_reviews": Table(
        """review_fact_id LONG, emp_key LONG, dept_key LONG, project_key LONG,
        review_date_key INT, environment_satisfaction INT, job_satisfaction INT,
        relationship_satisfaction INT, job_involvement INT, performance_rating INT,
        percent_salary_hike DECIMAL(5,2), monthly_income DECIMAL(10,2)""",
        ("review_fact_id",),
        ("review_fact_id", "emp_key", "dept_key", "project_key", "review_date_key"),
        references=(
            ("emp_key", "dim_employee", "emp_key"),
            ("dept_key", "dim_department", "dept_key"),
            ("project_key", "dim_project", "project_key"),
            ("review_date_key", "dim_date", "date_key"),
        ),
    ),
}

TABLES = {**OLTP, **OLAP}
STAGING_TABLE = "staging_employees"
