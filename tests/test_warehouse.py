"""Loads, stored tables, operations, the stream and the file source."""

from __future__ import annotations

import os
import random
from decimal import Decimal

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from rosterlake.plans import analytics, changes, olap, oltp, quality
from rosterlake.plans.load import LoadConfig, run_full_load
from rosterlake.plans.operations import Workforce
from rosterlake.schemas import OLAP, OLTP, STAGING_TABLE, STAGING_WITH_KEY, TABLES
from rosterlake.session import scratch_root
from rosterlake.sources import driver_tables as source
from rosterlake.sources.csv_staging import (
    QUARANTINE,
    load_csv_to_staging,
    read_staging_csv,
    split_staging_csv,
    write_staging_csv,
)
from rosterlake.sources.tables import Tables
from rosterlake.streaming.change_stream import apply_batch, follow_role_changes


def test_load_from_versions_equals_the_separate_jobs(loaded):
    separate = olap.fact_reviews(
        loaded.staging, loaded["dim_employee"], loaded["dim_department"], loaded["dim_project"],
        loaded["dim_date"], loaded["project_assignments"],
    )
    assert rows(separate) == rows(loaded["fact_performance_reviews"])
    reviews = oltp.performance_reviews(loaded.staging, loaded["employees"])
    assert rows(reviews) == rows(loaded["performance_reviews"])


def test_declared_columns_and_types(loaded):
    for name, table in TABLES.items():
        assert [(f.name, f.dataType) for f in loaded[name].schema.fields] == [
            (f.name, f.dataType) for f in table.schema.fields
        ]


def test_loaded_tables_keep_all_constraints(loaded):
    for report in (
        quality.fk_violations(loaded.tables),
        quality.unique_violations(loaded.tables),
        quality.null_violations(loaded.tables),
        quality.scd2_integrity(loaded["dim_employee"]),
    ):
        assert report.filter("violations > 0").collect() == []


def test_facts_without_fan_out(loaded):
    fanned = olap.fact_reviews_v1(
        loaded.staging, loaded["dim_employee"], loaded["dim_department"], loaded["dim_project"],
        oltp.project_assignments_v1(loaded["employees"], loaded["projects"]),
    )
    assert loaded["fact_performance_reviews"].count() <= fanned.count()


def test_reload_extends_the_calendar_and_replaces_the_rest(spark, sf_dir, store_root):
    store, second = Tables(spark, f"{store_root}/load=1"), Tables(spark, f"{store_root}/load=2")
    staging = source.staging_rows(spark, sf_dir).limit(300)
    run_full_load(spark, staging, store, LoadConfig("1998-01-01", "2000-12-31"))
    before = rows(store.read("dim_date"))
    result = run_full_load(spark, staging, second, LoadConfig("1995-01-01", "2001-12-31"), previous=store)
    assert result.folder == second.root
    days = second.read("dim_date")
    assert days.count() == days.select("full_date").distinct().count() == 2557
    assert rows(store.read("dim_date")) == before  # readers of the first load are not disturbed
    assert rows(second.read("dim_employee")) == rows(store.read("dim_employee"))


def test_reload_and_append(spark, store_root):
    store = Tables(spark, store_root)
    one, two = (spark.createDataFrame([(n, "Dev", n)], OLTP["jobs"].schema) for n in (1, 2))
    assert rows(store.reload("jobs", one)) == [(1, "Dev", 1)]
    store.append("jobs", two)
    assert rows(store.read("jobs"), "job_id") == [(1,), (2,)]
    assert rows(store.reload("jobs", two)) == [(2, "Dev", 2)]
    assert store.changes == 3
    assert store.reload("jobs", two.limit(0)).count() == 0 and store.next_id("jobs", "job_id") == 1


def test_the_next_id_comes_from_the_footers(loaded):
    from test_scale import plan_of

    highest = loaded.store.highest("employees", "employee_id")
    assert "PushedAggregation: [MAX(employee_id)]" in plan_of(highest)
    assert highest.first()["highest"] == loaded["employees"].agg(F.max("employee_id")).first()[0]
    assert loaded.store.next_id("dim_employee", "emp_key") == loaded["dim_employee"].count() + 1


def test_no_intermediate_table_is_left(spark, sf_dir, store_root):
    folder = scratch_root(spark)

    def left():
        return {p for p in os.listdir(folder.removeprefix("file:"))} if os.path.isdir(folder) else set()

    os.makedirs(folder, exist_ok=True)
    before, store = left(), Tables(spark, store_root)
    run_full_load(spark, source.staging_rows(spark, sf_dir), store, LoadConfig("1995-01-01", "2035-12-31"))
    assert left() == before
    refused = Workforce(store).update_roles(source.role_changes(spark, sf_dir))
    refused.count()
    Workforce(store).give_raises(source.raise_requests(spark, sf_dir)).count()
    assert left() == before


@pytest.fixture
def company(spark, sf_dir, store_root):
    store = Tables(spark, store_root)
    run_full_load(spark, source.staging_rows(spark, sf_dir), store, LoadConfig("1995-01-01", "2035-12-31"))
    return store


def _files(store, table):
    """The table's files by folder."""
    found = {}
    for folder, _, names in os.walk(store.folder(table)):
        own = {n for n in names if n.endswith(".parquet")}
        if own:
            found[os.path.relpath(folder, store.folder(table))] = own
    return found


def test_one_change_rewrites_one_block(spark, sf_dir, loaded, store_root):
    store = Tables(spark, store_root, block_ids=20)
    for name in ("employees", "departments", "jobs", "dim_employee"):
        store.reload(name, loaded[name])
    before = {name: _files(store, name) for name in ("employees", "dim_employee")}
    assert len(before["employees"]) > 5
    versions = loaded["dim_employee"].count()
    staff = {r.employee_id for r in loaded["employees"].collect()}
    change = source.role_changes(spark, sf_dir).filter(F.col("employee_id").isin(sorted(staff)[:40:7])).limit(1)
    change = spark.createDataFrame(change.collect(), change.schema)
    (block,) = store.blocks(change)
    assert Workforce(store).update_roles(change).count() == 0
    after = {name: _files(store, name) for name in before}
    changed = {f for f in before["employees"] if after["employees"][f] != before["employees"][f]}
    assert changed == {f"id_block={block}"} and set(after["employees"]) == set(before["employees"])
    changed = {f for f in before["dim_employee"] if after["dim_employee"][f] != before["dim_employee"][f]}
    assert changed == {f"is_current=1/id_block={block}/written_by=current"}
    (added,) = set(after["dim_employee"]) - set(before["dim_employee"])
    assert added.startswith(f"is_current=0/id_block={block}/written_by=")
    expected = changes.update_employee_roles(
        change, loaded["employees"], loaded["departments"], loaded["jobs"], loaded["dim_employee"]
    )
    assert rows(store.read("dim_employee")) == rows(expected.dim_employee)
    assert store.read("dim_employee").count() == versions + 1
    assert rows(store.read("employees")) == rows(expected.employees)


def test_a_batch_that_comes_again_changes_nothing(spark, sf_dir, loaded, store_root):
    store = Tables(spark, store_root)
    for name in ("employees", "departments", "jobs", "dim_employee"):
        store.reload(name, loaded[name])
    work, requests = Workforce(store), source.role_changes(spark, sf_dir)
    early, late = requests.filter("change_id < 500"), requests.filter("change_id >= 500")
    work.update_roles(early, batch="one")
    once = rows(store.read("dim_employee"))
    # As if the driver had died after the outcome was written, and while it was put in place.
    real, store.reached = store.reached, lambda batch, step: step == "staged"
    work.update_roles(late, batch="one")
    assert rows(store.read("dim_employee")) == once
    store.reached = real
    work.update_roles(late, batch="two")
    twice = rows(store.read("dim_employee"))
    assert len(twice) > len(once)
    work.update_roles(early, batch="one")
    assert rows(store.read("dim_employee")) == twice


def test_operations_change_both_layers(spark, sf_dir, loaded, company):
    work = Workforce(company)
    before = loaded  # the same load, in another folder
    expired = {f: n for f, n in _files(company, "dim_employee").items() if f.startswith("is_current=0")}

    refused = work.update_roles(source.role_changes(spark, sf_dir))
    accepted = source.role_changes(spark, sf_dir).count() - refused.count()
    assert company.read("dim_employee").count() == before["dim_employee"].count() + accepted
    files = _files(company, "dim_employee")
    assert all(files[f] == names for f, names in expired.items())  # expired versions are not rewritten
    assert len([f for f in files if f.startswith("is_current=0")]) > len(expired)

    refused = work.submit_reviews(source.review_requests(spark, sf_dir))
    accepted = source.review_requests(spark, sf_dir).count() - refused.count()
    for table in ("performance_reviews", "fact_performance_reviews"):
        assert company.read(table).count() == before[table].count() + accepted

    work.assign_projects(source.assignment_requests(spark, sf_dir))
    assert company.read("project_assignments").count() > before["project_assignments"].count()
    work.give_raises(source.raise_requests(spark, sf_dir))

    manager = before["employees"].first().employee_id
    hires = source.onboarding_candidates(spark, sf_dir).limit(1).select(
        F.lit(1).alias("candidate_id"), F.lit(" Ann ").alias("first_name"), F.lit("Lee").alias("last_name"),
        F.lit(" Ann.Lee@X.com").alias("email"), F.lit(None).cast("string").alias("phone_number"),
        F.lit(30).alias("age"), F.lit("2020-01-01").cast("date").alias("hire_date"),
        F.lit(5).alias("total_working_years"), F.lit(5000).cast("decimal(10,2)").alias("monthly_income"),
        F.lit(manager).alias("manager_id"), F.lit(1).alias("department_id"), F.lit(1).alias("job_id"),
    )
    assert work.onboard(hires, F.lit("2026-08-15").cast("date")).count() == 0
    new_id = before["employees"].agg(F.max("employee_id")).first()[0] + 1
    person = company.read("employees").filter(F.col("employee_id") == new_id).first()
    assert (person.first_name, person.email, person.attrition) == ("Ann", "ann.lee@x.com", "No")
    version = company.read("dim_employee").filter(F.col("employee_id") == new_id).first()
    assert (version.full_name, version.change_reason, str(version.effective_end_date)) == (
        "Ann Lee", "New Hire", "9999-12-31",
    )

    tables = company.tables()
    for report in (quality.fk_violations(tables), quality.unique_violations(tables)):
        assert report.filter("violations > 0").collect() == []
    broken = quality.scd2_integrity(tables["dim_employee"]).filter("violations > 0")
    assert {r.kind for r in broken.collect()} <= {"zero_length"}


def test_stream_applies_every_file_once(spark, sf_dir, company, tmp_path):
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    requests = source.role_changes(spark, sf_dir)
    before = company.read("dim_employee").count()
    early = requests.filter("change_id < 500")
    early.write.mode("append").parquet(feed)
    follow_role_changes(spark, feed, company.root, checkpoint, once=True).awaitTermination()
    first = company.read("dim_employee").count()
    assert first > before
    requests.filter("change_id >= 500").write.mode("append").parquet(feed)
    follow_role_changes(spark, feed, company.root, checkpoint, once=True).awaitTermination()
    assert company.read("dim_employee").count() > first
    done = rows(company.read("dim_employee"))
    apply_batch(company, early, 0)  # delivered again after a failure
    assert rows(company.read("dim_employee")) == done
    broken = quality.scd2_integrity(company.read("dim_employee")).filter("violations > 0")
    assert {r.kind for r in broken.collect()} <= {"zero_length"}


def test_csv_staging(spark, sf_dir, tmp_path, store_root):
    path = str(tmp_path / "staging")
    staged = source.staging_rows(spark, sf_dir, with_staged_end=True).limit(200)
    staged = staged.withColumn("last_name", F.concat(F.lit('a "quoted", '), "last_name"))
    write_staging_csv(staged, path)
    assert rows(read_staging_csv(spark, path, STAGING_WITH_KEY)) == rows(staged)
    store = Tables(spark, store_root)
    assert load_csv_to_staging(spark, path, store, STAGING_WITH_KEY) is True
    assert store.read(STAGING_TABLE).count() == 200
    with pytest.raises(FileNotFoundError):
        load_csv_to_staging(spark, str(tmp_path / "absent"), store)
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(STAGING_WITH_KEY.fieldNames()) + "\n" + "x" + "," * 42 + "\n")
    assert load_csv_to_staging(spark, str(bad), store, STAGING_WITH_KEY) is False
    assert store.read(STAGING_TABLE).count() == 200


def test_bad_lines_go_to_quarantine(spark, sf_dir, tmp_path, store_root):
    path, store = str(tmp_path / "damaged"), Tables(spark, store_root)
    damaged = source.damaged_staging(spark, sf_dir)
    write_staging_csv(damaged, path)
    bad = damaged.filter("Age = 'forty' OR hire_date = '2020-02-31' OR MonthlyIncome LIKE '%.%.%'").count()
    assert 0 < bad < damaged.count()
    assert load_csv_to_staging(spark, path, store, STAGING_WITH_KEY) is False  # strict by default
    assert load_csv_to_staging(spark, path, store, STAGING_WITH_KEY, quarantine=True) is True
    assert store.read(STAGING_TABLE).count() == damaged.count() - bad
    kept = store.read(QUARANTINE).collect()
    assert len(kept) == bad and all(r.file_name and r.raw_line.count(",") >= 42 for r in kept)
    good = source.staging_rows(spark, sf_dir, with_staged_end=True)
    assert set(rows(store.read(STAGING_TABLE), *STAGING_WITH_KEY.fieldNames())) <= set(rows(good))


def test_lines_with_missing_or_extra_fields_are_bad(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.csv").write_text("employee_id,Age\n1,30\n2\n3,40,50\n\n4,\nx,1\n")
    from rosterlake.schemas import struct

    staged = split_staging_csv(spark, str(folder), struct("employee_id INT, Age INT"))
    assert rows(staged.rows) == [(1, 30), (4, None)]
    assert rows(staged.quarantine, "raw_line") == [("2",), ("3,40,50",), ("x,1",)]


def test_dashboard_frames_equal_the_single_queries(loaded):
    frames = analytics.Dashboard(loaded.tables).frames
    dim, fact = loaded["dim_employee"], loaded["fact_performance_reviews"]
    departments, dates = loaded["dim_department"], loaded["dim_date"]
    single = {
        "combined_kpis": analytics.combined_kpis(dim, fact),
        "top_performers_by_department": analytics.top_performers_by_department(fact, dim, departments),
        "attrition_rate_by_department": analytics.attrition_rate_by_department(dim, departments),
        "avg_income_by_role": analytics.avg_income_by_role(dim),
        "attrition_risk_flags": analytics.attrition_risk_flags(fact, dim, departments, dates),
        "yearly_trends": analytics.yearly_trends(fact, dates),
    }
    assert set(frames) == set(single)
    for name, frame in single.items():
        assert rows(frames[name], *frame.columns) == rows(frame), name


def test_dashboard_scans_each_table_once(spark, loaded, monkeypatch):
    from test_scale import plan_of

    plans, store = [], analytics.materialise
    monkeypatch.setattr(analytics, "materialise", lambda df, name: (plans.append(plan_of(df)), store(df, name))[1])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # paths in full
    plans.append(plan_of(analytics.Dashboard(loaded.tables).bundle()))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for name in ("dim_employee", "fact_performance_reviews", "dim_department", "dim_date"):
        assert sum(plan.count(f"/{name}]") for plan in plans) == 1, name


def test_dashboard_of_an_empty_star_schema(spark):
    tables = {name: spark.createDataFrame([], table.schema) for name, table in OLAP.items()}
    found = rows(analytics.Dashboard(tables).bundle())
    assert {r[0] for r in found} == {"combined_kpis"} and {r[2] for r in found} == {0.0}


def test_cached_bundle_expires_and_follows_changes(spark, loaded, store_root):
    store, now = Tables(spark, store_root), [0.0]
    for name in OLAP:
        store.reload(name, loaded[name])
    cached = analytics.CachedBundle(store, clock=lambda: now[0])
    first = cached.rows()
    now[0] = 299.0
    assert cached.rows() is first
    now[0] = 300.0
    second = cached.rows()
    assert second is not first and rows(second) == rows(first)
    store.reload("fact_performance_reviews", loaded["fact_performance_reviews"].limit(10))
    third = cached.rows()
    assert rows(third) != rows(first) and cached.rows() is third


def test_top_n_in_two_stages_equals_one(spark):
    from pyspark.sql import Window

    from rosterlake.operators.merge import top_n_per_group

    rng = random.Random(3)
    data = [(rng.choice("aaab"), rng.randrange(50), n) for n in range(5000)]
    df = spark.createDataFrame(data, "k STRING, v INT, id INT").repartition(7)
    order = [F.desc("v"), F.col("id")]
    whole = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    for n in (1, 1000, 1001):
        assert rows(top_n_per_group(df, ["k"], order, n, "r")) == rows(whole.filter(F.col("r") <= n))


def test_calendar_is_filled_only_when_empty(spark):
    from rosterlake.sources.calendar import calendar

    days = calendar(spark, "2020-01-01", "2020-01-31")
    assert olap.populate_dim_date(days.limit(0), days).count() == 31
    assert olap.populate_dim_date(days.limit(3), days).count() == 3


def test_unknown_jobs_get_one_fallback_in_both_layers(spark):
    jobs = spark.createDataFrame([(1, "Dev", 1), (2, "Ops", 2)], OLTP["jobs"].schema)
    asked = spark.createDataFrame([(10, 1), (11, 7), (12, 8), (13, None)], "candidate_id INT, job_id LONG")
    requests, extended = changes.with_fallback_job(asked, jobs, "job_id", changes.UNKNOWN_JOB_HIRE)
    assert rows(requests) == [(10, 1), (11, 3), (12, 3), (13, None)]
    assert rows(extended) == [(1, "Dev", 1), (2, "Ops", 2), (3, "Unassigned", 1)]
    again, same = changes.with_fallback_job(asked, extended, "job_id", changes.UNKNOWN_JOB_HIRE)
    assert rows(again) == rows(requests) and rows(same) == rows(extended)
    _, unchanged = changes.with_fallback_job(asked.filter("job_id = 1"), jobs, "job_id", changes.UNKNOWN_JOB_HIRE)
    assert rows(unchanged) == rows(jobs)


def test_department_filter_with_and_without_collation(loaded):
    directory = analytics.employee_directory(loaded["employees"], loaded["departments"], loaded["jobs"])
    sales = analytics.employees_in_department(directory, "Sales").count()
    assert sales > 0
    assert analytics.employees_in_department(directory, "sALES").count() == 0
    assert analytics.employees_in_department(directory, "sALES", "UTF8_LCASE").count() == sales
    assert analytics.employees_in_department(directory).count() == directory.count()


def test_empty_warehouse_gives_zero_indicators(spark):
    dim = spark.createDataFrame([], OLAP["dim_employee"].schema)
    fact = spark.createDataFrame([], OLAP["fact_performance_reviews"].schema)
    assert tuple(analytics.combined_kpis(dim, fact).first()) == (0, 0.0, 0.0, 0.0)
    assert analytics.avg_performance_rating(fact).first()[0] == 0.0


def test_averages_round_half_up_on_decimals(spark):
    from rosterlake.functions.measures import exact_avg

    df = spark.createDataFrame([(Decimal("1.00"),), (Decimal("1.01"),)], "x DECIMAL(10,2)")
    assert df.agg(exact_avg("x")).first()[0] == 1.01
    assert df.limit(0).agg(exact_avg("x")).first()[0] is None


def test_integrity_report_names_the_violations(spark):
    def version(key, employee, start, end, current):
        return (key, employee, "n", "e", None, None, None, None, None, day(start), day(end), current, None, None)

    dim = spark.createDataFrame(
        [
            version(1, 1, "2020-01-01", "2020-02-01", 0),  # gap until March
            version(2, 1, "2020-03-01", "9999-12-31", 1),
            version(3, 2, "2020-01-01", "2020-04-01", 0),  # overlaps the next
            version(4, 2, "2020-03-01", "9999-12-31", 1),
            version(5, 3, "2020-01-01", "9999-12-31", 0),  # open but not current
            version(6, 4, "2020-01-01", "9999-12-31", 1),  # two current
            version(7, 4, "2020-02-01", "9999-12-31", 1),
            version(8, 5, "2020-05-01", "2020-01-01", 0),  # ends before it starts
            version(9, 6, "2020-01-01", "2020-01-01", 0),  # zero length
            version(10, 6, "2020-01-01", "9999-12-31", 1),
        ],
        OLAP["dim_employee"].schema,
    )
    report = {r.kind: r.violations for r in quality.scd2_integrity(dim).collect()}
    assert report == {
        "no_current": 2, "multiple_current": 1, "open_end_not_current": 1, "negative_length": 1,
        "zero_length": 1, "gap": 1, "overlap": 2,
    }


def test_reference_report_finds_orphans(spark, loaded):
    orphan = spark.createDataFrame([(1, 42, 1, "x", 10, day("2020-01-01"))], OLTP["project_assignments"].schema)
    report = quality.fk_violations({**loaded.tables, "project_assignments": orphan})
    found = {r.relation for r in report.filter("violations > 0").collect()}
    assert found == {"project_assignments.employee_id->employees"}


def test_accepted_and_quarantined_rows_cover_the_input(spark, sf_dir):
    from rosterlake.functions import rules

    requests = source.assignment_requests(spark, sf_dir)
    accepted, quarantined = quality.split_valid(requests, rules.assignment_errors())
    assert accepted.count() + quarantined.count() == requests.count()
    assert accepted.columns == requests.columns


