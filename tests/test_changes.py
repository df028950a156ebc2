"""Change batches against one-by-one replays."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal

from conftest import day, moment, rows
from pyspark.sql import functions as F

from rosterlake.operators.timeline import OPEN_END
from rosterlake.plans import changes, quality
from rosterlake.schemas import OLAP, OLTP

DIM = OLAP["dim_employee"]
OPEN = day(OPEN_END)


def _version(key, employee, start, end=OPEN, current=1):
    return (
        key, employee, f"Name {employee}", f"e{employee}@x.com", "Dev", 1, Decimal("1000.00"), 1,
        day("2020-01-01"), day(start), end, current, "Initial Onboarding", "No",
    )


def _random_requests(n, employees, seed=11):
    rng = random.Random(seed)
    found = []
    for i in range(n):
        employee = 1 if rng.random() < 1 / 3 else rng.choice(employees)
        ts = moment(f"2024-01-{rng.randrange(1, 20):02d}T{rng.randrange(24):02d}:00:00")
        found.append((i, ts, ts.date(), employee, rng.randrange(1, 4), "Ops", 2, Decimal(rng.randrange(1000, 9000))))
    return found


def _replay(dim, requests):
    """Apply the requests one at a time."""
    table = [list(v) for v in dim]
    rejected = []
    for change_id, ts, date, employee, department, role, level, income in sorted(
        requests, key=lambda r: (r[1], r[0])
    ):
        current = [v for v in table if v[1] == employee and v[11] == 1]
        if not current:
            rejected.append(change_id)
            continue
        old = max(current, key=lambda v: v[0])
        old[10], old[11] = date, 0
        table.append(
            [max(v[0] for v in table) + 1, employee, old[2], old[3], role, level,
             income, department, old[8], date, OPEN, 1, "Department/Role Update", "No"]
        )
    return sorted(map(tuple, table), key=repr), sorted(rejected)


def _described(spark, requests):
    schema = (
        "change_id LONG, ts TIMESTAMP_NTZ, change_date DATE, employee_id INT, department_id INT, "
        "job_role STRING, job_level INT, monthly_income DECIMAL(10,2)"
    )
    return spark.createDataFrame(requests, schema).select(
        "*", F.lit("Department/Role Update").alias("change_reason"), F.lit(None).cast("string").alias("attrition")
    )


def test_scd2_batch_equals_a_replay(spark):
    dim = [_version(1, 1, "2020-01-01", day("2021-01-01"), 0), _version(2, 1, "2021-01-01")]
    dim += [_version(k, k, "2020-01-01") for k in range(3, 9)]
    requests = _random_requests(200, [3, 4, 5, 77])
    applied = changes.apply_scd2_changes(
        spark.createDataFrame(dim, DIM.schema), _described(spark, requests).repartition(7)
    )
    expected, rejected = _replay(dim, requests)
    assert rows(applied.snapshot) == expected
    assert sorted(r.change_id for r in applied.rejected.collect()) == rejected
    report = {r.kind: r.violations for r in quality.scd2_integrity(applied.snapshot).collect()}
    zero = report.pop("zero_length")
    assert zero > 0 and set(report.values()) == {0}


def test_scd2_expires_the_highest_of_several_current_rows(spark):
    dim = [_version(1, 1, "2020-01-01"), _version(2, 1, "2021-01-01")]
    request = [(0, moment("2024-01-01T00:00:00"), day("2024-01-01"), 1, 2, "Ops", 1, Decimal(5))]
    applied = changes.apply_scd2_changes(spark.createDataFrame(dim, DIM.schema), _described(spark, request))
    flags = {r.emp_key: (r.is_current, str(r.effective_end_date)) for r in applied.snapshot.collect()}
    assert flags == {1: (1, OPEN_END), 2: (0, "2024-01-01"), 3: (1, OPEN_END)}


def test_scd2_may_keep_a_missing_attrition_flag(spark):
    frame = spark.createDataFrame([_version(1, 1, "2020-01-01")], DIM.schema)
    request = [(0, moment("2024-01-01T00:00:00"), day("2024-01-01"), 1, 2, "Ops", 1, Decimal(5))]
    applied = changes.apply_scd2_changes(frame, _described(spark, request), default_attrition=None)
    assert rows(applied.snapshot, "emp_key", "attrition") == [(1, "No"), (2, None)]


def test_scd2_without_changes_is_the_same_table(spark):
    dim = [_version(1, 1, "2020-01-01")]
    frame = spark.createDataFrame(dim, DIM.schema)
    applied = changes.apply_scd2_changes(frame, _described(spark, _random_requests(1, [1])).limit(0))
    assert rows(applied.snapshot) == rows(frame)


def _employees(spark, incomes):
    columns = OLTP["employees"].schema
    return spark.createDataFrame(
        [(i, "A", "B", "a@b.co", None, 30, None, None, None, None, day("2020-01-01"), 1, 1, None,
          Decimal(v), "No", None, None) for i, v in incomes.items()],
        columns,
    )


def _raises(spark, requests):
    return spark.createDataFrame(
        [(i, moment("2024-01-01T00:00:00").replace(second=i % 60, minute=i // 60), e, Decimal(p))
         for i, (e, p) in enumerate(requests)],
        "request_id LONG, ts TIMESTAMP_NTZ, employee_id INT, percent DECIMAL(5,2)",
    )


def test_raises_compound_with_rounding_at_every_step(spark):
    rng = random.Random(4)
    incomes = {1: "1000.01", 2: "1234.55", 3: "99999999.00", 4: "0.10", 5: "700.00"}
    requests = [(1 if rng.random() < 1 / 3 else rng.choice([2, 3, 4, 9]), rng.choice(["5", "2.5", "0", "-1", "0.05"]))
                for _ in range(300)]
    expected = {i: Decimal(v) for i, v in incomes.items()}
    for employee, percent in requests:
        if employee in expected and Decimal(percent) > 0:
            raised = (expected[employee] * (100 + Decimal(percent)) / 100).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
            if raised <= Decimal("99999999.99"):
                expected[employee] = raised
    wanted = sorted(((i, v) for i, v in expected.items()), key=repr)
    employees = _employees(spark, incomes)
    for parts in (1, 5):
        raised = changes.apply_raises(_raises(spark, requests).repartition(parts), employees)
        assert rows(raised.employees, "employee_id", "monthly_income") == wanted
        reasons = {(r.employee_id, r.reason) for r in raised.rejected.collect()}
        assert (9, changes.NO_EMPLOYEE) in reasons and (1, changes.NOT_POSITIVE) in reasons
        assert (3, changes.OUT_OF_RANGE) in reasons


def test_every_raise_is_applied_or_rejected(spark):
    employees = _employees(spark, {1: "99999999.00", 2: "1000.00", 3: "10.00"})
    employees = employees.withColumn(
        "monthly_income", changes.F.when(changes.F.col("employee_id") != 3, changes.F.col("monthly_income"))
    )
    requests = spark.createDataFrame(
        [(0, 1, "50"), (1, 2, None), (2, 2, "1.005"), (3, 3, "5"), (4, 1, "0.0000001"), (5, 2, "123456789012")],
        "request_id LONG, employee_id INT, percent STRING",
    ).selectExpr("request_id", "employee_id", "CAST(percent AS DECIMAL(20,7)) AS percent",
                 "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts")
    raised = changes.apply_raises(requests, employees)
    assert rows(raised.employees, "employee_id", "monthly_income") == [
        (1, Decimal("99999999.10")), (2, Decimal("1010.05")), (3, None)]
    assert rows(raised.rejected, "request_id", "reason") == [
        (0, changes.OUT_OF_RANGE), (1, changes.NO_PERCENT), (3, changes.NO_INCOME), (5, changes.OUT_OF_RANGE)]


def test_changes_before_the_current_version_are_rejected(spark):
    frame = spark.createDataFrame([_version(1, 1, "2024-06-01")], DIM.schema)
    described = _described(spark, _random_requests(1, [1])).limit(1)
    late = described.withColumn("change_date", changes.F.lit("2024-03-01").cast("date"))
    undated = described.withColumn("change_date", changes.F.lit(None).cast("date"))
    for feed, reason in ((late, changes.LATE_CHANGE), (undated, changes.NO_DATE)):
        applied = changes.apply_scd2_changes(frame, feed)
        assert rows(applied.snapshot) == rows(frame)
        assert [r.reason for r in applied.rejected.collect()] == [reason]


def test_half_cents_round_to_even(spark):
    employees = _employees(spark, {1: "0.50", 2: "1.50"})
    for parts in (1, 3):
        raised = changes.apply_raises(_raises(spark, [(1, "1"), (2, "1")]).repartition(parts), employees)
        assert rows(raised.employees, "employee_id", "monthly_income") == [(1, Decimal("0.50")), (2, Decimal("1.52"))]


def test_assignments_keep_the_first_date_and_the_last_role(spark):
    employees = _employees(spark, {10001: "1", 10002: "1"})
    projects = spark.createDataFrame([(1, "P", 1, day("2024-01-01"), None, None), (2, "Q", 1, day("2024-01-01"), None, None)],
                                     OLTP["projects"].schema)
    existing = spark.createDataFrame([(7, 10001, 1, "Contributor", 100, day("2020-01-01"))],
                                     OLTP["project_assignments"].schema)
    requests = [
        (1, "2024-01-01", 10001, 1, " Lead ", 50),
        (2, "2024-01-02", 10001, 2, "Dev", 20),
        (3, "2024-01-03", 10001, 2, "Tester", 30),
        (4, "2024-01-01", 10002, 2, "Lead 2", 30),  # digit
        (5, "2024-01-01", 10003, 2, "Dev", 30),  # unknown employee
        (6, "2024-01-01", 10002, 9, "Dev", 30),  # unknown project
    ]
    df = spark.createDataFrame(
        [(i, moment(d + "T00:00:00"), e, p, r, a, day(d)) for i, d, e, p, r, a in requests],
        "request_id LONG, ts TIMESTAMP_NTZ, employee_id INT, project_id LONG, role_in_project STRING, "
        "allocation_percentage INT, assigned_date DATE",
    )
    result = changes.assign_projects(df, existing, employees, projects)
    assert rows(result.snapshot) == [
        (7, 10001, 1, "Lead", 50, day("2020-01-01")),
        (8, 10001, 2, "Tester", 30, day("2024-01-02")),
    ]
    assert rows(result.rejected, "request_id") == [(4,), (5,), (6,)]


def test_role_updates_change_both_layers_together(spark, loaded):
    employee = loaded["employees"].orderBy("employee_id").first()
    ts = moment("2030-01-01T10:00:00")
    requests = spark.createDataFrame(
        [
            (1, ts, ts.date(), employee.employee_id, 1, 1, Decimal("2000")),
            (2, ts.replace(hour=11), ts.date(), employee.employee_id, 2, 2, Decimal("3000")),
            (3, ts, ts.date(), employee.employee_id, 99, 1, Decimal("2000")),  # no such department
            (4, ts, ts.date(), employee.employee_id, 1, 9999, Decimal("2000")),  # no such job
            (5, ts, ts.date(), employee.employee_id, 1, 1, Decimal("1")),  # income out of range
            (6, ts, ts.date(), 9_999_999, 1, 1, Decimal("2000")),  # unknown
        ],
        "change_id LONG, ts TIMESTAMP_NTZ, change_date DATE, employee_id INT, new_department_id INT, "
        "new_job_id LONG, new_monthly_income DECIMAL(10,2)",
    )
    update = changes.update_employee_roles(
        requests, loaded["employees"], loaded["departments"], loaded["jobs"], loaded["dim_employee"]
    )
    assert rows(update.rejected, "change_id") == [(3,), (4,), (5,), (6,)]
    now = update.employees.filter(F.col("employee_id") == employee.employee_id).first()
    assert (now.department_id, now.job_id, now.monthly_income) == (2, 2, Decimal("3000.00"))
    current = update.dim_employee.filter(F.col("employee_id") == employee.employee_id).filter("is_current = 1")
    version = current.collect()
    job = loaded["jobs"].filter("job_id = 2").first()
    assert len(version) == 1 and version[0].job_role == job.job_role and version[0].department_id == 2
    assert version[0].attrition == employee.attrition


def test_a_million_raises_of_one_employee_take_no_more_jobs(spark):
    employees = _employees(spark, {1: "1000.00", 2: "2000.00"})

    def run(n):
        requests = spark.range(n).select(
            F.col("id").alias("request_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
            F.when(F.col("id") == 7, 2).otherwise(1).alias("employee_id"),
            ((F.col("id") % 3 + 1) / 1000).cast("decimal(6,3)").alias("percent"),
        )
        group = f"raises-{n}"
        spark.sparkContext.setJobGroup(group, group)
        found = dict(rows(changes.apply_raises(requests, employees).employees, "employee_id", "monthly_income"))
        spark.sparkContext.setJobGroup("", "")
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    income, cent = Decimal("1000.00"), Decimal("0.01")
    for i in range(1_000_000):
        if i != 7:
            raised = (income * (100 + Decimal(i % 3 + 1) / 1000) / 100).quantize(cent, ROUND_HALF_EVEN)
            income = raised if raised <= Decimal("99999999.99") else income
    (_, few), (found, many) = run(1000), run(1_000_000)
    assert found == {1: income, 2: Decimal("2000.04")}
    assert many <= few + 1
