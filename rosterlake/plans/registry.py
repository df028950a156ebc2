"""Every query by name, as (spark, sf_dir) -> DataFrame over the driver's tables.

Load jobs run from staging, change jobs and analytics on the loaded warehouse. The warehouse of
a folder is loaded once per application and read from its stored tables after that.
Results carry money and measures as DOUBLE, dates as ISO text and message lists joined by '; ',
which reads the same in every engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import cleanse, labels
from rosterlake.operators import expand
from rosterlake.operators.keys import assign_keys
from rosterlake.operators.merge import split_known
from rosterlake.operators.timeline import version_as_of
from rosterlake.plans import adhoc, analytics, changes, olap, oltp, quality, routing
from rosterlake.plans.load import LoadConfig, load_row_counts, run_full_load
from rosterlake.plans.operations import Workforce
from rosterlake.schemas import SOURCE_KEY, STAGING_TABLE, STAGING_WITH_KEY, TABLES
from rosterlake.session import materialise, scratch_path
from rosterlake.sources import driver_tables as source
from rosterlake.sources.calendar import CALENDAR_V1, CALENDAR_V2, calendar, calendar_between
from rosterlake.sources.csv_staging import RAW_LINE, read_staging_csv, split_staging_csv, write_staging_csv
from rosterlake.sources.tables import Tables
from rosterlake.streaming.change_stream import apply_batch, follow_role_changes

# The driver's orders start in 1995, before the default calendar.
FIXTURE_LOAD = LoadConfig(first_day="1995-01-01", last_day="2035-12-31")
AS_OF = "2026-08-15"
ASK_EMPLOYEE = 10_101
ASK_DEPARTMENT = "Sales"

GUARDED_OLAP = (
    "SELECT d.department_name, e.job_role, COUNT(*) AS headcount "
    "FROM DIM_EMPLOYEE e JOIN DIM_DEPARTMENT d ON e.department_id = d.department_id "
    "WHERE e.is_current = 1 GROUP BY d.department_name, e.job_role "
    "ORDER BY headcount DESC, d.department_name, e.job_role;"
)
GUARDED_OLTP = (
    "SELECT e.employee_id, e.phone_number, e.manager_id, e.total_working_years "
    "FROM EMPLOYEES e WHERE e.manager_id IS NOT NULL "
    "ORDER BY e.total_working_years DESC, e.employee_id"
)

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    sf_dir: str
    store: Tables
    tables: dict[str, DataFrame]

    @property
    def staging(self) -> DataFrame:
        return self.tables[STAGING_TABLE]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


_loaded: dict[tuple[str, str], Warehouse] = {}


def load_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """A fresh load of the folder's tables."""
    store = Tables(spark, scratch_path(spark, "warehouse"))
    result = run_full_load(spark, source.staging_rows(spark, sf_dir), store, FIXTURE_LOAD)
    return Warehouse(spark, sf_dir, store, result.tables)


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The folder's warehouse, loaded on first use. Its tables are never rewritten."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        _loaded[key] = load_warehouse(spark, sf_dir)
    return _loaded[key]


def presented(df: DataFrame) -> DataFrame:
    """Result columns in engine-neutral types."""

    def show(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.concat_ws("; ", column)
        return column.alias(field.name)

    return df.select(*[show(f) for f in df.schema.fields])


QUERIES: dict[str, Query] = {}


def _query(function: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    """Register a query over the loaded warehouse under the function's name."""
    QUERIES[function.__name__] = lambda spark, sf_dir: presented(function(warehouse(spark, sf_dir)))
    return function


def _raw_query(function: Query) -> Query:
    """Register a query over the driver's own tables."""
    QUERIES[function.__name__] = lambda spark, sf_dir: presented(function(spark, sf_dir))
    return function


# --- sources, shaping, keys ---------------------------------------------------------------


@_raw_query
def staging_employees(spark, sf_dir):
    return source.staging_rows(spark, sf_dir, with_staged_end=True)


@_raw_query
def stage_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "staging-csv")
    write_staging_csv(source.staging_rows(spark, sf_dir, with_staged_end=True), path)
    return read_staging_csv(spark, path, STAGING_WITH_KEY)


@_query
def seed_projects(w):
    return w["projects"].join(w["departments"].select("department_id", "department_name"), "department_id")


@_raw_query
def drop_constant_columns(spark, sf_dir):
    raw = source.table(spark, sf_dir, "customer")
    constants = [F.lit(1).alias("EmployeeCount"), F.lit(80).alias("StandardHours")]
    return expand.drop_constant_columns(raw.select("*", *constants))


def _replicated(spark, sf_dir):
    base = source.table(spark, sf_dir, "customer").select("c_custkey")
    return expand.replicate_to_target(base, ["c_custkey"], 2.5)


@_raw_query
def replicate_to_target(spark, sf_dir):
    return _replicated(spark, sf_dir)


@_raw_query
def zip_rows_by_position(spark, sf_dir):
    orders = source.table(spark, sf_dir, "orders").select("o_orderkey")
    return expand.zip_rows(_replicated(spark, sf_dir), ["employee_id"], orders, ["o_orderkey"])


@_query
def department_lookup_default(w):
    code = F.col("department_id")
    name = labels.department_name(code, F.col("Department"))
    named = w.staging.select("src_key", F.when(code.isNotNull(), name).alias("department"))
    return named.withColumn("department_id", labels.department_code(F.col("department")))


@_raw_query
def scd2_history_expand(spark, sf_dir):
    key = F.col("c_custkey")
    today = F.lit(AS_OF).cast("date")
    base = source.table(spark, sf_dir, "customer").select(
        "c_custkey",
        (key * 37 % 19000 + 1000).cast("int").alias("MonthlyIncome"),
        (key % 5 + 1).cast("int").alias("JobLevel"),
        (key % 3 + 1).cast("int").alias("department_id"),
        F.date_sub(today, (key % 3400 + 200).cast("int")).alias("hire_date"),
    )
    reasons = F.array(*[F.lit(r) for r in (
        "Promotion & Salary Hike", "Department Transfer", "Annual Merit Increase",
    )])
    return expand.expand_history(
        base,
        today,
        has_history=key % 10 < 6,
        offset=key % 916 + 180,
        income_factor=(key % 16 + 75).cast("decimal(4,0)") / 100,
        rotate=key % 10 < 3,
        reason=F.element_at(reasons, (key % 3 + 1).cast("int")),
    )


@_raw_query
def email_derivation(spark, sf_dir):
    key = F.col("c_custkey")
    email = labels.email_address(F.substring("c_name", 1, 8), F.col("c_mktsegment"), key % 90 + 10)
    return source.table(spark, sf_dir, "customer").select("c_custkey", email.alias("email"))


@_query
def cleanse_staging(w):
    return w.staging.select(
        "src_key", "employee_id",
        *cleanse.aliased(cleanse.employee_columns()),
        *cleanse.aliased(cleanse.review_columns()),
    )


@_query
def surrogate_keys(w):
    rows = w.staging.select("src_key", "employee_id", "effective_start_date")
    return assign_keys(rows, ["employee_id", "effective_start_date", "src_key"], "row_key")


@_query
def next_employee_id(w):
    highest = w.store.highest("employees", "employee_id")
    return highest.select((F.coalesce("highest", F.lit(0)) + 1).cast("long").alias("next_id"))


@_query
def distinct_departments(w):
    return w.staging.select("department_id").distinct()


@_query
def dedup_staging(w):
    return olap.dedup_staging(w.staging).select(
        "employee_id", "effective_start_date", "src_key", "is_current", "MonthlyIncome"
    )


# --- operational layer --------------------------------------------------------------------


@_query
def oltp_departments(w):
    return oltp.departments(w.staging)


@_query
def oltp_departments_v1(w):
    return oltp.departments_v1(w.staging)


@_query
def oltp_jobs(w):
    return oltp.with_job_ids(oltp.distinct_jobs(w.staging))


@_query
def oltp_jobs_v1(w):
    return oltp.with_job_ids(oltp.distinct_jobs_v1(w.staging))


@_query
def oltp_employees(w):
    return oltp.employees(w.staging, w["jobs"], w["departments"])


@_query
def oltp_employees_v1(w):
    return oltp.employees_v1(w.staging, oltp.with_job_ids(oltp.distinct_jobs_v1(w.staging)))


@_query
def assign_managers(w):
    managed = oltp.with_managers(w["employees"])
    return managed.select("employee_id", "department_id", "manager_id")


@_query
def assign_managers_v1(w):
    managed = oltp.with_managers_v1(w["employees"])
    return managed.select("employee_id", "department_id", "manager_id")


@_query
def project_assignments(w):
    return oltp.project_assignments(w["employees"], w["projects"])


@_query
def project_assignments_v1(w):
    return oltp.project_assignments_v1(w["employees"], w["projects"])


@_query
def oltp_reviews(w):
    return oltp.performance_reviews(w.staging, w["employees"])


@_query
def oltp_reviews_v1(w):
    return oltp.performance_reviews_v1(w.staging)


# --- star schema --------------------------------------------------------------------------


@_query
def dim_department(w):
    return olap.dim_department(w["departments"])


@_query
def dim_project(w):
    return olap.dim_project(w["projects"], FIXTURE_LOAD.unknown_project_since)


def _calendar_since(w, column):
    first = w.staging.agg(F.min(column).alias("first"))
    last = F.lit(FIXTURE_LOAD.last_day).cast("date")
    return calendar_between(first, F.trunc("first", "year"), last)


@_query
def dim_date(w):
    """From the year of the first hire on."""
    return _calendar_since(w, "hire_date")


def _facts_per_day(w, bounds):
    """A calendar of fixed range with the number of facts of every day."""
    days = calendar(w.spark, *bounds)
    facts = w["fact_performance_reviews"].groupBy(F.col("review_date_key").alias("date_key"))
    counted = days.join(facts.agg(F.count(F.lit(1)).alias("n_facts")), "date_key", "left")
    return counted.withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))


@_query
def dim_date_v1(w):
    return _facts_per_day(w, CALENDAR_V1)


@_query
def dim_date_v2(w):
    return _facts_per_day(w, CALENDAR_V2)


@_query
def dashboard_bundle(w):
    return analytics.Dashboard(w.tables).bundle()


@_query
def dim_date_extend(w):
    """A calendar that starts with the latest employee's hire gains the earlier days."""
    latest = w.staging.agg(F.max("hire_date").alias("first"))
    last = F.lit(FIXTURE_LOAD.last_day).cast("date")
    existing = calendar_between(latest, F.trunc("first", "year"), last)
    return olap.extend_dim_date(existing, _calendar_since(w, "hire_date"))


@_query
def dim_date_populate(w):
    """The scalar-subquery branch, both ways: an empty calendar is filled, a filled one stays."""
    stored, days = w["dim_date"], _calendar_since(w, "hire_date")
    calendars = {"empty": stored.filter("year IS NULL"), "filled": stored.filter("year >= 2000")}
    found = [
        olap.populate_dim_date(existing, days).groupBy("year").agg(F.count(F.lit(1)).alias("n_days"))
        .select(F.lit(name).alias("calendar"), "year", "n_days")
        for name, existing in calendars.items()
    ]
    return found[0].unionByName(found[1])


@_query
def dim_employee_scd2(w):
    return olap.dim_employee(olap.employee_versions(w.staging))


@_raw_query
def dim_employee_v1(spark, sf_dir):
    return olap.dim_employee_v1(source.staging_rows(spark, sf_dir, with_staged_end=True))


@_query
def fact_reviews(w):
    return olap.fact_reviews(
        w.staging, w["dim_employee"], w["dim_department"], w["dim_project"], w["dim_date"],
        w["project_assignments"],
    )


@_query
def fact_reviews_v1_fanout(w):
    assignments = oltp.project_assignments_v1(w["employees"], w["projects"])
    return olap.fact_reviews_v1(
        w.staging, w["dim_employee"], w["dim_department"], w["dim_project"], assignments
    )


@_query
def employee_version_asof(w):
    versions = w["dim_employee"].select(
        "employee_id", "effective_start_date", "effective_end_date", "emp_key"
    )
    return version_as_of(
        source.version_probes(w.spark, w.sf_dir), versions, "employee_id", "probe_date",
        "effective_start_date", "effective_end_date", "emp_key",
    )


@_query
def load_counts(w):
    return load_row_counts(w.tables)


@_query
def pipeline_row_counts(w):
    return load_row_counts(w.tables)


# --- change jobs --------------------------------------------------------------------------


def _scd2(w):
    requests = source.role_changes(w.spark, w.sf_dir)
    described = changes.describe_changes(requests, w["jobs"], w["employees"])
    return changes.apply_scd2_changes(w["dim_employee"], described, first_key=_next(w, "dim_employee"))


def _next(w, table):
    """The next free id of a table, from the footers of its files."""
    return w.store.next_id(table, TABLES[table].primary_key[0])


def _role_update(w, requests=None, jobs=None):
    requests = source.role_changes(w.spark, w.sf_dir) if requests is None else requests
    return changes.update_employee_roles(
        requests, w["employees"], w["departments"], w["jobs"] if jobs is None else jobs,
        w["dim_employee"], _next(w, "dim_employee"),
    )


def _candidates(w):
    """Candidates whose manager numbers name employees."""
    candidates = source.onboarding_candidates(w.spark, w.sf_dir)
    manager = F.when(F.col("manager_id") > 0, F.col("manager_id") + 10_000)
    return candidates.withColumn("manager_id", F.coalesce(manager, F.lit(0)))


def _onboarding(w, candidates=None, jobs=None):
    today = F.lit(AS_OF).cast("date")
    return changes.onboard(
        _candidates(w) if candidates is None else candidates, w["employees"], w["departments"],
        w["jobs"] if jobs is None else jobs, w["dim_employee"], today,
        _next(w, "employees"), _next(w, "dim_employee"),
    )


def _submitted(w):
    return changes.submit_reviews(
        source.review_requests(w.spark, w.sf_dir), w.tables,
        _next(w, "performance_reviews"), _next(w, "fact_performance_reviews"),
    )


@_query
def scd2_apply_changes(w):
    return _scd2(w).snapshot


@_query
def scd2_apply_rejects(w):
    return _scd2(w).rejected.select("change_id", "employee_id", "change_date")


@_query
def reject_unknown_employees(w):
    requests = source.role_changes(w.spark, w.sf_dir)
    _, rejected = split_known(requests, w["employees"], "employee_id")
    return rejected.select("change_id", "employee_id")


@_query
def update_employee_roles(w):
    return _role_update(w).employees


@_query
def update_employee_roles_dim(w):
    return _role_update(w).dim_employee


@_query
def onboard_employees(w):
    return _onboarding(w).employees


@_query
def onboard_dim_rows(w):
    return _onboarding(w).dim_employee


@_query
def assign_projects_upsert(w):
    requests = source.assignment_requests(w.spark, w.sf_dir)
    return changes.assign_projects(
        requests, w["project_assignments"], w["employees"], w["projects"], _next(w, "project_assignments")
    ).snapshot


def _both_layers(employees, jobs, versions):
    """The job of every employee as either layer has it."""
    named = employees.join(jobs, "job_id").select(
        "employee_id", "job_id", F.col("job_role").alias("oltp_role"), F.col("job_level").alias("oltp_level")
    )
    latest = versions.filter("is_current = 1").select(
        "employee_id", F.col("job_role").alias("olap_role"), F.col("job_level").alias("olap_level")
    )
    return named.join(latest, "employee_id")


@_query
def onboard_unknown_jobs(w):
    """Hires for jobs that no table has get the fallback job in both layers."""
    candidates, jobs = changes.with_fallback_job(_candidates(w), w["jobs"], "job_id", changes.UNKNOWN_JOB_HIRE)
    hired = _onboarding(w, candidates, jobs)
    return _both_layers(hired.employees, jobs, hired.dim_employee)


@_query
def update_unknown_jobs(w):
    """Role changes to jobs that no table has get the fallback job in both layers."""
    asked = source.role_changes(w.spark, w.sf_dir).withColumn("new_job_id", F.col("change_id") % 29 + 1)
    requests, jobs = changes.with_fallback_job(asked, w["jobs"], "new_job_id", changes.UNKNOWN_JOB_UPDATE)
    updated = _role_update(w, requests, jobs)
    changed = updated.dim_employee.filter(F.col("change_reason") == changes.REASON_UPDATE).select("employee_id")
    found = _both_layers(updated.employees, jobs, updated.dim_employee)
    return found.join(changed, "employee_id", "left_semi")


# --- stored tables: reloaded, appended to, rewritten by blocks, followed by a stream ---------


def _copied(w, *names):
    """Some of the warehouse's tables in a folder of their own, for a query that changes them."""
    store = Tables(w.spark, scratch_path(w.spark, "changed"))
    for name in names:
        store.reload(name, w[name])
    return store


@_query
def reload_tables(w):
    """A second load into the same tables leaves the rows of the second only."""
    store = _copied(w, "departments", "jobs", "projects", "employees")
    kept = {
        "departments": w["departments"].filter("department_id <> 3"),
        "jobs": w["jobs"],
        "projects": w["projects"].filter("department_id <> 3"),
        "employees": w["employees"].filter("department_id <> 3"),
    }
    counts = [
        store.reload(name, rows).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, rows in kept.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@_query
def append_reviews_stored(w):
    """The fact table after a batch of reviews was appended, read back."""
    names = "employees departments dim_employee dim_department dim_date performance_reviews fact_performance_reviews"
    store = _copied(w, *names.split())
    Workforce(store).submit_reviews(source.review_requests(w.spark, w.sf_dir))
    return store.read("fact_performance_reviews")


_CHANGED = ("employees", "departments", "jobs", "dim_employee")


@_query
def update_employee_roles_stored(w):
    """The stored dimension after a batch rewrote the blocks of its employees."""
    store = _copied(w, *_CHANGED)
    Workforce(store).update_roles(source.role_changes(w.spark, w.sf_dir))
    return store.read("dim_employee")


@_query
def role_changes_stream(w):
    """The stored dimension after the changes came as files, period by period, and the last one twice."""
    store, feed = _copied(w, *_CHANGED), scratch_path(w.spark, "change-feed")
    requests = materialise(source.role_changes(w.spark, w.sf_dir), "change-feed-rows")
    edges = requests.agg(F.percentile_approx("change_date", [0.4, 0.7]).alias("e")).first()["e"] or []
    period = reduce(lambda n, edge: n + (F.col("change_date") > F.lit(edge)).cast("int"), edges, F.lit(0))
    checkpoint, batch = scratch_path(w.spark, "change-checkpoint"), requests
    for number in range(len(edges) + 1):
        batch = requests.filter(period == number)
        batch.write.mode("append").parquet(feed)
        follow_role_changes(w.spark, feed, store.root, checkpoint, once=True).awaitTermination()
    apply_batch(store, batch, len(edges))
    return store.read("dim_employee")


@_raw_query
def staging_quarantine(spark, sf_dir):
    """Good and bad lines of a damaged file, and what their keys add up to."""
    path = scratch_path(spark, "damaged-csv")
    write_staging_csv(source.damaged_staging(spark, sf_dir), path)
    staged = split_staging_csv(spark, path, STAGING_WITH_KEY)
    key = F.element_at(F.split(RAW_LINE, ","), -1).cast("long")
    kinds = {"loaded": staged.rows.select(SOURCE_KEY), "quarantined": staged.quarantine.select(key.alias(SOURCE_KEY))}
    counts = [
        rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(SOURCE_KEY).alias("key_sum"))
        for kind, rows in kinds.items()
    ]
    return counts[0].unionByName(counts[1])


@_query
def submit_reviews(w):
    return _submitted(w).facts


@_query
def submit_reviews_oltp(w):
    return _submitted(w).performance_reviews


def _raises(w):
    return changes.apply_raises(source.raise_requests(w.spark, w.sf_dir), w["employees"])


@_query
def give_raises(w):
    return _raises(w).employees.select("employee_id", "monthly_income")


@_query
def give_raises_rejects(w):
    return _raises(w).rejected.select("request_id", "employee_id", "percent", "reason")


def _raises_of_one(w):
    return changes.apply_raises(source.raises_of_one(w.spark, w.sf_dir, ASK_EMPLOYEE), w["employees"])


@_query
def give_raises_one_employee(w):
    return _raises_of_one(w).employees.select("employee_id", "monthly_income")


@_query
def give_raises_one_employee_rejects(w):
    return _raises_of_one(w).rejected.select("request_id", "percent", "reason")


def _late(w):
    requests = source.late_changes(w.spark, w.sf_dir)
    return changes.apply_scd2_changes(
        w["dim_employee"], changes.describe_changes(requests, w["jobs"], w["employees"])
    )


@_query
def scd2_apply_late_rejects(w):
    return _late(w).rejected.select("change_id", "reason")


@_query
def scd2_integrity_late(w):
    return quality.scd2_integrity(materialise(_late(w).snapshot, "late-dim"))


# --- data quality -------------------------------------------------------------------------


@_raw_query
def validate_names(spark, sf_dir):
    candidates = source.onboarding_candidates(spark, sf_dir).select("candidate_id", "first_name")
    return quality.validate_names(candidates, "first_name", "First Name")


@_raw_query
def validate_phones(spark, sf_dir):
    candidates = source.onboarding_candidates(spark, sf_dir).select("candidate_id", "phone_number")
    return quality.validate_phones(candidates)


@_raw_query
def validate_emails(spark, sf_dir):
    candidates = source.onboarding_candidates(spark, sf_dir).select("candidate_id", "email")
    return quality.validate_emails(candidates)


def _checked_candidates(spark, sf_dir):
    today = F.lit(AS_OF).cast("date")
    return quality.validate_onboarding(source.onboarding_candidates(spark, sf_dir), today)


@_raw_query
def validate_onboarding(spark, sf_dir):
    return _checked_candidates(spark, sf_dir).select("candidate_id", "errors")


@_raw_query
def onboarding_error_counts(spark, sf_dir):
    return quality.error_counts(_checked_candidates(spark, sf_dir))


@_raw_query
def validate_required(spark, sf_dir):
    candidates = source.incomplete_candidates(spark, sf_dir)
    checked = quality.validate_onboarding(candidates, F.lit(AS_OF).cast("date"))
    missing = F.filter("errors", lambda e: e.endswith("is required."))
    return checked.select("candidate_id", missing.alias("missing"))


@_raw_query
def validate_assignments(spark, sf_dir):
    requests = source.assignment_requests(spark, sf_dir)
    return quality.validate_assignments(requests).select("request_id", "errors")


@_raw_query
def validate_role_updates(spark, sf_dir):
    requests = source.role_changes(spark, sf_dir)
    return quality.validate_role_updates(requests).select("change_id", "errors")


@_raw_query
def validate_reviews(spark, sf_dir):
    requests = source.review_requests(spark, sf_dir)
    return quality.validate_reviews(requests).select("request_id", "errors")


@_query
def fk_violations(w):
    feeds = {
        "role_changes": (
            source.role_changes(w.spark, w.sf_dir), "employee_id", "employees", "employee_id"
        ),
        "assignment_requests": (
            source.assignment_requests(w.spark, w.sf_dir), "project_id", "projects", "project_id"
        ),
        "onboarding": (
            source.onboarding_candidates(w.spark, w.sf_dir), "manager_id", "employees", "employee_id"
        ),
    }
    return quality.fk_violations(w.tables, feeds)


@_query
def unique_violations(w):
    staged = {STAGING_TABLE: (w.staging, ["employee_id", "effective_start_date"])}
    return quality.unique_violations(w.tables, staged)


@_query
def null_violations(w):
    staged = {STAGING_TABLE: (w.staging, ["employee_id", "department_id", "hire_date"])}
    return quality.null_violations(w.tables, staged)


@_query
def scd2_integrity(w):
    return quality.scd2_integrity(materialise(_scd2(w).snapshot, "changed-dim"))


@_query
def scd2_integrity_loaded(w):
    return quality.scd2_integrity(w["dim_employee"])


@_raw_query
def sql_audit(spark, sf_dir):
    return adhoc.sql_audit(source.query_texts(spark, sf_dir))


@_raw_query
def routed_sql(spark, sf_dir):
    return routing.routed(source.routed_texts(spark, sf_dir))


# --- analytics ----------------------------------------------------------------------------


@_query
def combined_kpis(w):
    return analytics.combined_kpis(w["dim_employee"], w["fact_performance_reviews"])


@_query
def kpi_cards(w):
    return analytics.kpi_cards(combined_kpis(w))


@_query
def attrition_rate_by_department(w):
    return analytics.attrition_rate_by_department(w["dim_employee"], w["dim_department"])


@_query
def attrition_share(w):
    return analytics.attrition_share(attrition_rate_by_department(w))


@_query
def avg_income_by_role(w):
    return analytics.avg_income_by_role(w["dim_employee"])


@_query
def attrition_risk_flags(w):
    return analytics.attrition_risk_flags(
        w["fact_performance_reviews"], w["dim_employee"], w["dim_department"], w["dim_date"]
    )


@_query
def top_performers_by_department(w):
    return analytics.top_performers_by_department(
        w["fact_performance_reviews"], w["dim_employee"], w["dim_department"]
    )


@_query
def performer_labels(w):
    return analytics.performer_labels(top_performers_by_department(w))


@_query
def performers_by_hike(w):
    return analytics.performers_by_hike(top_performers_by_department(w))


@_query
def yearly_trends(w):
    return analytics.yearly_trends(w["fact_performance_reviews"], w["dim_date"])


@_query
def yearly_scores_long(w):
    return analytics.yearly_scores_long(yearly_trends(w))


@_query
def active_dim_employees(w):
    return analytics.active_dim_employees(w["dim_employee"])


@_query
def avg_performance_rating(w):
    return analytics.avg_performance_rating(w["fact_performance_reviews"])


@_query
def avg_income_current(w):
    return analytics.avg_income_current(w["dim_employee"])


@_query
def avg_job_satisfaction(w):
    return analytics.avg_job_satisfaction(w["fact_performance_reviews"])


@_query
def top_earners_with_rating(w):
    return analytics.top_earners_with_rating(
        w["fact_performance_reviews"], w["dim_employee"], w["dim_department"], ASK_DEPARTMENT
    )


@_query
def employee_directory(w):
    return analytics.employee_directory(w["employees"], w["departments"], w["jobs"])


@_query
def employee_by_id(w):
    return analytics.employee_by_id(employee_directory(w), ASK_EMPLOYEE)


@_query
def employees_in_department(w):
    return analytics.employees_in_department(employee_directory(w), ASK_DEPARTMENT)


@_query
def list_departments(w):
    return analytics.list_departments(w["departments"])


@_query
def list_jobs(w):
    return analytics.list_jobs(w["jobs"])


@_query
def lookup_labels(w):
    return analytics.lookup_labels(w["departments"], w["jobs"])


@_query
def top_performer_flag(w):
    return analytics.top_performer_flag(w["performance_reviews"])


@_query
def guarded_sql_olap(w):
    return adhoc.run_guarded(w.store, GUARDED_OLAP)


@_query
def guarded_sql_oltp(w):
    return adhoc.run_guarded(w.store, GUARDED_OLTP)
