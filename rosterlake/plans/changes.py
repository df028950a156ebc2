"""Batches of operational changes applied to both layers as snapshot merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.labels import full_name
from rosterlake.operators.keys import assign_keys, date_key, next_key
from rosterlake.operators.merge import keep_one
from rosterlake.operators.timeline import open_end, with_successor_day
from rosterlake.plans.olap import UNKNOWN_PROJECT_KEY
from rosterlake.schemas import OLAP, OLTP
from rosterlake.session import materialise

_DIM = OLAP["dim_employee"].columns
_FACT = OLAP["fact_performance_reviews"].columns

# Reasons and fallbacks of the change jobs.
REASON_NEW_HIRE = "New Hire"
REASON_UPDATE = "Department/Role Update"
UNKNOWN_JOB_HIRE = "Unassigned"
UNKNOWN_JOB_UPDATE = "Updated Role"
UNKNOWN_JOB_LEVEL = 1
NO_VERSION = "no current version of this employee"
NO_DATE = "change date is missing"
LATE_CHANGE = "change date lies before the current version"


def _no_errors(errors: Column) -> Column:
    return F.size(errors) == 0


def _with_job_text(df: DataFrame, jobs: DataFrame, job_id: str, unknown: str) -> DataFrame:
    text = jobs.select(F.col("job_id").alias(job_id), "job_role", "job_level")
    return (
        df.join(text, job_id, "left")
        .withColumn("job_role", F.coalesce("job_role", F.lit(unknown)))
        .withColumn("job_level", F.coalesce("job_level", F.lit(UNKNOWN_JOB_LEVEL)))
    )


def with_fallback_job(
    requests: DataFrame, jobs: DataFrame, job_id: str, role: str
) -> tuple[DataFrame, DataFrame]:
    """(requests, jobs) with one job for all ids that no job has, so that both layers name the same.

    The job carries the fallback text and level and the next free id; a job of that text and level
    serves again. Without unknown ids both stay as they are. Missing ids stay missing.
    """
    known = jobs.select(F.col("job_id").alias(job_id))
    unknown = requests.filter(F.col(job_id).isNotNull()).join(known, job_id, "left_anti")
    fallback = (F.col("job_role") == role) & (F.col("job_level") == UNKNOWN_JOB_LEVEL)
    found = jobs.agg(F.max(F.when(fallback, F.col("job_id"))).alias("is"), F.max("job_id").alias("last")).first()
    own = found["is"] or (found["last"] or 0) + 1
    row = jobs.sparkSession.range(1).select(
        F.lit(own).cast("long").alias("job_id"), F.lit(role).alias("job_role"),
        F.lit(UNKNOWN_JOB_LEVEL).cast("int").alias("job_level"),
    )
    extended = jobs
    if not found["is"] and not unknown.isEmpty():
        extended = jobs.unionByName(row)
    marked = requests.join(known.withColumn("__job", F.lit(True)), job_id, "left")
    kept = F.when(F.col(job_id).isNull() | F.col("__job").isNotNull(), F.col(job_id)).otherwise(F.lit(own))
    kind = requests.schema[job_id].dataType
    return marked.withColumn(job_id, kept.cast(kind)).select(*requests.columns), materialise(extended, "jobs")


def _existing(df: DataFrame, table: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(table.select(F.col(key).alias(column)), column, "left_semi")


# --- type 2 changes ---------------------------------------------------------------------


@dataclass(frozen=True)
class ScdChange:
    """``touched``: all versions that were current before, plus the new ones. ``accepted`` and
    ``rejected``: the changes; the rejected ones with a ``reason``."""

    snapshot: DataFrame
    touched: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def describe_changes(changes: DataFrame, jobs: DataFrame, employees: DataFrame) -> DataFrame:
    """Role-change requests with the job text and the attrition flag that is carried forward.

    Written, so that this join and the next one on the employee are planned, and split where
    one employee is hot, each on its own.
    """
    attrition = employees.select("employee_id", "attrition")
    described = (
        _with_job_text(changes, jobs, "new_job_id", UNKNOWN_JOB_UPDATE)
        .join(attrition, "employee_id", "left")
        .select(
            "change_id",
            "ts",
            "change_date",
            "employee_id",
            F.col("new_department_id").alias("department_id"),
            "job_role",
            "job_level",
            F.col("new_monthly_income").alias("monthly_income"),
            F.lit(REASON_UPDATE).alias("change_reason"),
            F.coalesce("attrition", F.lit("No")).alias("attrition"),
        )
    )
    return materialise(described, "described-changes")


def apply_scd2_changes(
    dim: DataFrame,
    changes: DataFrame,
    default_attrition: str | None = "No",
    first_key: int | None = None,
) -> ScdChange:
    """Expire the current version at the first change, add one version per change.

    ``change_date`` is the day of ``ts``; a missing attrition flag becomes the default, or
    stays missing without one. Equal to replaying the changes one by one in
    (ts, change_id) order: several changes of a day leave zero-length versions. A change
    without a date, or dated before the current version began, is rejected: it would give a
    version of negative length. Expired versions are passed through unread by any join.
    ``first_key`` is the next free ``emp_key``, where ``dim`` holds a part of the versions only.
    """
    current = dim.filter("is_current = 1")
    newest = current.groupBy("employee_id").agg(
        F.max(F.struct("emp_key", "effective_start_date")).alias("__newest")
    )
    newest = newest.select(
        "employee_id",
        F.col("__newest.emp_key").alias("__target"),
        F.col("__newest.effective_start_date").alias("__start"),
    )
    reason = (
        F.when(F.col("__target").isNull(), NO_VERSION)
        .when(F.col("change_date").isNull(), NO_DATE)
        .when(F.col("change_date") < F.col("__start"), LATE_CHANGE)
    )
    checked = changes.join(newest, "employee_id", "left").withColumn("reason", reason)
    checked = materialise(checked, "scd2-checked")
    accepted = checked.filter("reason IS NULL").select(*changes.columns)
    rejected = checked.filter("reason IS NOT NULL").select(*changes.columns, "reason")

    first = accepted.groupBy("employee_id").agg(F.min("change_date").alias("__first"))
    targets = first.join(newest.drop("__start"), "employee_id")
    marked = current.join(targets, "employee_id", "left")
    is_target = F.coalesce(F.col("emp_key") == F.col("__target"), F.lit(False))
    base = (
        marked.withColumn(
            "effective_end_date", F.when(is_target, F.col("__first")).otherwise(F.col("effective_end_date"))
        )
        .withColumn("is_current", F.when(is_target, 0).otherwise(F.col("is_current")))
        .select(*_DIM)
    )

    carried = marked.filter(is_target).select("employee_id", "full_name", "email", "hire_date")
    following = with_successor_day(
        accepted, "employee_id", "change_date", ["ts", "change_id"], "__end"
    )
    versions = following.join(carried, "employee_id").select(
        "change_id",
        "ts",
        "employee_id",
        "full_name",
        "email",
        "job_role",
        "job_level",
        "monthly_income",
        "department_id",
        "hire_date",
        F.col("change_date").alias("effective_start_date"),
        F.coalesce("__end", open_end()).alias("effective_end_date"),
        F.when(F.col("__end").isNull(), 1).otherwise(0).alias("is_current"),
        "change_reason",
        F.coalesce("attrition", F.lit(default_attrition)).alias("attrition"),
    )
    keyed = assign_keys(versions, ["ts", "change_id"], "emp_key", first_key or next_key(dim, "emp_key"))
    touched = base.unionByName(keyed.select(*_DIM))
    expired = dim.filter("is_current = 0").select(*_DIM)
    return ScdChange(expired.unionByName(touched), touched, accepted, rejected)


@dataclass(frozen=True)
class RoleUpdate:
    employees: DataFrame
    dim_employee: DataFrame
    touched: DataFrame
    rejected: DataFrame


def update_employee_roles(
    changes: DataFrame,
    employees: DataFrame,
    departments: DataFrame,
    jobs: DataFrame,
    dim_employee: DataFrame,
    first_key: int | None = None,
) -> RoleUpdate:
    """Valid changes of known employees to known departments and jobs, in both layers.

    The two tables of employees may be the blocks that the changes fall into; ``first_key`` is then
    the next free ``emp_key``.
    """
    valid = changes.filter(_no_errors(rules.role_update_errors()))
    valid = _existing(valid, employees, "employee_id", "employee_id")
    valid = _existing(valid, departments, "new_department_id", "department_id")
    valid = materialise(_existing(valid, jobs, "new_job_id", "job_id"), "role-updates")
    described = describe_changes(valid, jobs, employees)
    applied = apply_scd2_changes(dim_employee, described, first_key=first_key)
    done = applied.accepted.select("change_id")
    rejected = changes.join(done, "change_id", "left_anti")

    latest = keep_one(valid.join(done, "change_id", "left_semi"), ["employee_id"], [F.desc("ts"), F.desc("change_id")]).select(
        "employee_id", "new_department_id", "new_job_id", "new_monthly_income"
    )
    updated = employees.join(latest, "employee_id", "left")
    for column in ("department_id", "job_id", "monthly_income"):
        updated = updated.withColumn(column, F.coalesce(f"new_{column}", column))
    columns = OLTP["employees"].columns
    return RoleUpdate(updated.select(*columns), applied.snapshot, applied.touched, rejected)


# --- new hires --------------------------------------------------------------------------


@dataclass(frozen=True)
class Onboarding:
    employees: DataFrame
    dim_employee: DataFrame
    rejected: DataFrame


def onboard(
    candidates: DataFrame,
    employees: DataFrame,
    departments: DataFrame,
    jobs: DataFrame,
    dim_employee: DataFrame,
    today: Column,
    first_id: int | None = None,
    first_key: int | None = None,
) -> Onboarding:
    """New rows of both layers for valid candidates whose references exist."""
    valid = candidates.filter(_no_errors(rules.onboarding_errors(today)))
    valid = _existing(valid, departments, "department_id", "department_id")
    valid = _existing(valid, jobs, "job_id", "job_id")
    valid = materialise(_existing(valid, employees, "manager_id", "employee_id"), "onboarding")
    rejected = candidates.join(valid.select("candidate_id"), "candidate_id", "left_anti")

    normalised = {
        "first_name": rules.stripped(F.col("first_name")),
        "last_name": rules.stripped(F.col("last_name")),
        "email": F.lower(rules.stripped(F.col("email"))),
        "phone_number": F.when(
            F.col("phone_number").isNotNull(), rules.stripped(F.col("phone_number"))
        ),
        "attrition": F.lit("No"),
    }
    ids = assign_keys(valid, ["candidate_id"], "employee_id", first_id or next_key(employees, "employee_id"))
    hires = ids.select("candidate_id", *_row(OLTP["employees"], ids, normalised))
    hires = materialise(hires, "hires")

    described = {
        "full_name": full_name("first_name", "last_name"),
        "effective_start_date": F.col("hire_date"),
        "effective_end_date": open_end(),
        "is_current": F.lit(1),
        "change_reason": F.lit(REASON_NEW_HIRE),
    }
    texts = _with_job_text(hires, jobs, "job_id", UNKNOWN_JOB_HIRE)
    versions = assign_keys(texts, ["candidate_id"], "emp_key", first_key or next_key(dim_employee, "emp_key"))
    return Onboarding(
        hires.select(*OLTP["employees"].columns),
        versions.select(*_row(OLAP["dim_employee"], versions, described)),
        rejected,
    )


def _row(table, source: DataFrame, own: dict[str, Column]) -> list[Column]:
    """All columns of a table: the given ones, those of the source, NULL for the rest."""

    def value(name: str) -> Column:
        if name in own:
            return own[name]
        return F.col(name) if name in source.columns else F.lit(None)

    return [value(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]


# --- project assignments ----------------------------------------------------------------


@dataclass(frozen=True)
class ProjectAssignments:
    snapshot: DataFrame
    rejected: DataFrame


def assign_projects(
    requests: DataFrame,
    assignments: DataFrame,
    employees: DataFrame,
    projects: DataFrame,
    first_id: int | None = None,
) -> ProjectAssignments:
    """Insert or update per (employee, project): the last role and allocation win, the first
    date stays."""
    checked = requests.withColumn("__ok", _no_errors(rules.assignment_errors()))
    valid = checked.filter("__ok").withColumn(
        "role_in_project", rules.stripped(F.col("role_in_project"))
    )
    order = F.struct("ts", "request_id")
    pair = ["employee_id", "project_id"]
    # Reduced to pairs before any join: requests of a busy employee never meet in one task.
    wanted = valid.groupBy(*pair).agg(
        F.min(order).alias("__first"),
        F.min_by("assigned_date", order).alias("__date"),
        F.max_by("role_in_project", order).alias("__role"),
        F.max_by("allocation_percentage", order).alias("__allocation"),
    )
    wanted = _existing(wanted, employees, "employee_id", "employee_id")
    wanted = materialise(_existing(wanted, projects, "project_id", "project_id"), "assignments")
    columns = OLTP["project_assignments"].columns
    updated = (
        assignments.join(wanted, pair, "left")
        .withColumn("role_in_project", F.coalesce("__role", "role_in_project"))
        .withColumn("allocation_percentage", F.coalesce("__allocation", "allocation_percentage"))
        .select(*columns)
    )
    fresh = wanted.join(assignments.select(*pair), pair, "left_anti").select(
        *pair,
        "__first",
        F.col("__role").alias("role_in_project"),
        F.col("__allocation").alias("allocation_percentage"),
        F.col("__date").alias("assigned_date"),
    )
    keyed = assign_keys(
        fresh, ["__first"], "assignment_id", first_id or next_key(assignments, "assignment_id")
    )
    known = wanted.select(*pair, F.lit(True).alias("__known"))
    refused = checked.join(known, pair, "left").filter("NOT (__ok AND __known IS NOT NULL)")
    return ProjectAssignments(
        updated.unionByName(keyed.select(*columns)), refused.select(*requests.columns)
    )


# --- reviews ----------------------------------------------------------------------------


@dataclass(frozen=True)
class SubmittedReviews:
    performance_reviews: DataFrame
    facts: DataFrame
    rejected: DataFrame


def submit_reviews(
    requests: DataFrame,
    tables: dict[str, DataFrame],
    first_id: int | None = None,
    first_fact: int | None = None,
) -> SubmittedReviews:
    """New rows of both layers; a review without project carries the unknown member."""
    employees = tables["employees"].select("employee_id", "department_id")
    valid = requests.filter(_no_errors(rules.review_errors())).join(employees, "employee_id")
    valid = materialise(valid, "reviews")
    rejected = requests.join(valid.select("request_id"), "request_id", "left_anti")
    order = ["ts", "request_id"]

    own = {"performance_rating": F.col("rating")}
    start = first_id or next_key(tables["performance_reviews"], "review_id")
    reviews = assign_keys(valid, order, "review_id", start)

    current = tables["dim_employee"].filter("is_current = 1")
    version = current.groupBy("employee_id").agg(F.max("emp_key").alias("emp_key"))
    departments = tables["dim_department"].select("department_id", "dept_key")
    synced = (
        valid.join(version, "employee_id")
        .join(departments, "department_id")
        .withColumn("review_date_key", date_key(F.col("review_date")))
        .join(
            tables["dim_date"].select(F.col("date_key").alias("review_date_key")),
            "review_date_key",
            "left_semi",
        )
        .withColumn("project_key", F.lit(UNKNOWN_PROJECT_KEY))
    )
    start = first_fact or next_key(tables["fact_performance_reviews"], "review_fact_id")
    facts = assign_keys(synced, order, "review_fact_id", start)
    return SubmittedReviews(
        reviews.select(*_row(OLTP["performance_reviews"], reviews, own)),
        facts.select(*_row(OLAP["fact_performance_reviews"], facts, own)),
        rejected,
    )


# --- raises -----------------------------------------------------------------------------

# Fixed value: the largest income the column holds.
MAX_INCOME = "99999999.99"
NOT_POSITIVE = "percent must be positive"
NO_EMPLOYEE = "no employee with this id"
NO_PERCENT = "percent is missing"
NO_INCOME = "the employee has no income"
OUT_OF_RANGE = "income would leave the range of the column"


@dataclass(frozen=True)
class Raises:
    """EMPLOYEES after the raises, and the requests that were not applied with their reasons."""

    employees: DataFrame
    rejected: DataFrame


def apply_raises(requests: DataFrame, employees: DataFrame) -> Raises:
    """Positive raises, compounded and rounded one after the other in (ts, request_id) order.

    Rounding at every step makes the order count, so the raises of an employee are one sequence. One
    sorted pass over the requests carries the income on: the number of jobs does not depend on the
    number of raises, and a task holds one batch of rows, however many raises an employee gets.
    Every request is applied or rejected: a raise beyond the column's range changes nothing and is
    rejected.
    """
    income = employees.select("employee_id", "monthly_income", F.lit(True).alias("__known"))
    reason = (
        F.when(F.col("__known").isNull(), NO_EMPLOYEE)
        .when(F.col("percent").isNull(), NO_PERCENT)
        .when(F.col("percent") <= 0, NOT_POSITIVE)
        .when(F.col("monthly_income").isNull(), NO_INCOME)
    )
    # Written before the pass: the join may split a hot employee, the pass has to keep it together.
    checked = requests.join(income, "employee_id", "left").withColumn("reason", reason)
    checked = materialise(checked, "raise-requests")
    valid = checked.filter("reason IS NULL").select(
        "employee_id", "ts", "request_id",
        F.col("monthly_income").cast("decimal(10,2)").alias("income"),
        F.col("percent").try_cast("decimal(16,8)").alias("percent"),
    )
    sequences = valid.repartition("employee_id").sortWithinPartitions("employee_id", "ts", "request_id")
    folded = materialise(sequences.mapInArrow(_fold(), _FOLDED), "raise-fold")
    final = folded.filter("request_id IS NULL").select("employee_id", F.col("income").alias("__income"))
    beyond = checked.filter("reason IS NULL").join(folded.select("request_id"), "request_id", "left_semi")
    beyond = beyond.withColumn("reason", F.lit(OUT_OF_RANGE))
    columns = [*requests.columns, "reason"]
    rejected = checked.filter("reason IS NOT NULL").select(*columns)
    raised = employees.join(final, "employee_id", "left").withColumn(
        "monthly_income", F.coalesce("__income", "monthly_income")
    )
    return Raises(
        raised.select(*OLTP["employees"].columns), rejected.unionByName(beyond.select(*columns))
    )


_FOLDED = "employee_id INT, request_id LONG, income DECIMAL(10,2)"


def _fold():
    """A pass over rows sorted by employee: one row per employee with the income after all raises,
    and one per raise that would leave the range. Nested, so that workers need no package."""
    most = MAX_INCOME

    def fold(batches):
        from decimal import ROUND_HALF_EVEN, Context, Decimal

        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.decimal128(10, 2)]
        context, limit, cent = Context(prec=60, rounding=ROUND_HALF_EVEN), Decimal(most), Decimal("0.01")
        employee = income = None

        def rows(found):
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["employee_id", "request_id", "income"])

        for batch in batches:
            found = []
            columns = [batch.column(n).to_pylist() for n in ("employee_id", "request_id", "income", "percent")]
            for own, request, start, percent in zip(*columns):
                if own != employee:
                    if employee is not None:
                        found.append((employee, None, income))
                    employee, income = own, start
                if percent is not None:
                    raised = context.multiply(income, context.multiply(percent + 100, cent))
                    raised = raised.quantize(cent, context=context)
                if percent is None or raised > limit:
                    found.append((own, request, None))
                else:
                    income = raised
            if found:
                yield rows(found)
        if employee is not None:
            yield rows([(employee, None, income)])

    return fold
