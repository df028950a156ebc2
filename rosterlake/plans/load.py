"""The full load: staging -> operational layer -> star schema, in a folder of its own."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.plans import olap, oltp
from rosterlake.schemas import STAGING_TABLE
from rosterlake.session import materialise, scratch_scope
from rosterlake.sources.calendar import CALENDAR_V2, calendar
from rosterlake.sources.tables import Tables


@dataclass(frozen=True)
class LoadConfig:
    first_day: str = CALENDAR_V2[0]
    last_day: str = CALENDAR_V2[1]
    unknown_project_since: str = CALENDAR_V2[0]


@dataclass(frozen=True)
class LoadResult:
    folder: str
    status: str
    tables: dict[str, DataFrame] = field(repr=False)


def run_full_load(
    spark: SparkSession,
    staging: DataFrame,
    store: Tables,
    config: LoadConfig = LoadConfig(),
    previous: Tables | None = None,
) -> LoadResult:
    """Fill every table of the folder from staging, the calendar from the previous load as well.

    Give each load a new folder: readers of the previous one are not disturbed. The operational
    tables, the employee versions and the calendar depend only on staging, so their jobs are
    submitted side by side. Intermediate tables are removed at the end.
    """
    with scratch_scope(spark):
        return _full_load(spark, staging, store, config, previous)


def _full_load(
    spark: SparkSession, staging: DataFrame, store: Tables, config: LoadConfig, previous: Tables | None
) -> LoadResult:
    tables: dict[str, DataFrame] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        tables[name] = store.reload(name, df)
        return tables[name]

    staging = save(STAGING_TABLE, staging)

    def versions() -> DataFrame:
        keyed = olap.employee_versions(staging)
        save("dim_employee", olap.dim_employee(keyed))
        return keyed

    def small_dimensions() -> None:
        save("dim_department", olap.dim_department(departments))
        save("dim_project", olap.dim_project(projects, config.unknown_project_since))

    def reviews() -> None:
        save("performance_reviews", olap.reviews_of_versions(keyed.result(), employees))

    with ThreadPoolExecutor() as threads:
        pool = _Inheriting(threads, spark)
        keyed = pool.submit(versions)
        jobs = pool.submit(lambda: save("jobs", oltp.with_job_ids(oltp.distinct_jobs(staging))))
        dates = pool.submit(lambda: save("dim_date", _calendar(spark, previous, config)))
        departments = save("departments", oltp.departments(staging))
        projects = save("projects", oltp.projects(spark, departments))
        dimensions = pool.submit(small_dimensions)

        unmanaged = oltp.employees(staging, jobs.result(), departments)
        employees = save("employees", oltp.with_managers(materialise(unmanaged, "employees")))
        reviewed = pool.submit(reviews)
        assignments = save("project_assignments", oltp.project_assignments(employees, projects))
        dimensions.result()
        save(
            "fact_performance_reviews",
            olap.fact_reviews_of_versions(
                keyed.result(),
                tables["dim_department"],
                tables["dim_project"],
                dates.result(),
                assignments,
            ),
        )
        reviewed.result()
    return LoadResult(store.root, "SUCCESS: full load completed", tables)


class _Inheriting:
    """Submits jobs with the job group, tags, scheduler pool and scratch scope of the caller."""

    def __init__(self, threads: ThreadPoolExecutor, spark: SparkSession):
        self.threads, self.spark = threads, spark

    def submit(self, job):
        context = copy_context()
        return self.threads.submit(inheritable_thread_target(self.spark)(lambda: context.run(job)))


def _calendar(spark: SparkSession, previous: Tables | None, config: LoadConfig) -> DataFrame:
    """The previous calendar, extended by the days of the configured range it lacks."""
    days = calendar(spark, config.first_day, config.last_day)
    return olap.extend_dim_date(previous.read("dim_date"), days) if previous else days


def load_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Verification counts, among them the deduplicated versions that became no fact."""

    def one(check: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check_name"), "n")

    dim, fact = tables["dim_employee"], tables["fact_performance_reviews"]
    counts = (
        one("active_oltp_employees", tables["employees"])
        .unionByName(one("total_olap_dim_employees", dim))
        .unionByName(one("current_dim_employees", dim.filter("is_current = 1")))
        .unionByName(one("expired_dim_employees", dim.filter("is_current = 0")))
        .unionByName(one("total_performance_facts", fact))
    )
    without_fact = dim.join(fact.select("emp_key"), "emp_key", "left_anti")
    return counts.unionByName(one("versions_without_fact", without_fact))

