"""Plans and hot keys: what has to hold when the tables are a million times larger."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rosterlake.operators import keys
from rosterlake.operators.merge import keep_one
from rosterlake.plans import olap, oltp, quality, registry
from rosterlake.plans.load import LoadConfig, run_full_load
from rosterlake.sources import driver_tables as source
from rosterlake.sources.tables import Tables


def plan_of(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for inputs too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    return {name: plan_of(query(spark, sf_dir)) for name, query in registry.QUERIES.items()}


def test_no_query_multiplies_rows_or_loops(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_no_query_runs_python_over_its_rows(plans):
    for name, plan in plans.items():
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan), name


def test_single_partition_exchanges_only_carry_aggregates(plans):
    """Everything gathered in one task is the output of an aggregate or a limit."""
    for name, plan in plans.items():
        lines = plan.splitlines()
        for number, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert re.search(r"Aggregate|Limit|Union", lines[number + 1]), (name, lines[number + 1])


def test_dashboards_read_only_current_versions_and_used_columns(plans):
    for name in ("top_performers_by_department", "avg_income_by_role", "attrition_risk_flags"):
        assert re.search(r"PartitionFilters: \[[^\]]*is_current", plans[name].replace("\n", " ")) or (
            "isnotnull(is_current" in plans[name]
        ), name
        assert "change_reason" not in plans[name], name


def test_filters_reach_the_scan(plans):
    assert "LessThanOrEqual(job_satisfaction,2)" in plans["attrition_risk_flags"]


def test_top_n_and_dedup_limit_before_the_shuffle(plans):
    for name in ("top_performers_by_department", "dedup_staging", "oltp_departments"):
        assert re.search(r"WindowGroupLimit.*Partial", plans[name]), name


def test_versions_take_two_exchanges(loaded, no_broadcast, monkeypatch):
    """Dedup shuffles by (employee, day); LEAD and keys share one exchange and one sort."""
    stored = {}
    monkeypatch.setattr(keys, "materialise", lambda df, name: stored.setdefault(name, df))
    olap.employee_versions(loaded.staging)
    plan = plan_of(stored["keys-emp_key"])
    assert plan.count("Exchange") == 2
    assert plan[: plan.index("Exchange")].count("Sort [") == 1


def test_whole_staged_rows_are_never_sorted_for_versions(loaded, no_broadcast, monkeypatch):
    """Dedup, LEAD and keys carry narrow rows; one hash join brings the other columns."""
    stored = {}
    monkeypatch.setattr(keys, "materialise", lambda df, name: stored.setdefault(name, df))
    monkeypatch.setattr(olap, "materialise", lambda df, name: stored.setdefault(name, df))
    olap.employee_versions(loaded.staging)
    assert "email" not in plan_of(stored["keys-emp_key"])
    assert "ShuffledHashJoin" in plan_of(stored["versions"])


def test_repeated_source_rows_give_one_version(loaded):
    once, twice = (olap.employee_versions(s) for s in (loaded.staging, loaded.staging.unionByName(loaded.staging)))
    assert rows(olap.dim_employee(twice)) == rows(olap.dim_employee(once))


def test_offsets_are_broadcast_by_their_real_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        numbered = keys.assign_dense_keys(spark.range(200_000).withColumnRenamed("id", "n"), "n", "key")
        assert "SortMergeJoin" not in plan_of(numbered)
        assert numbered.filter("key <> n + 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_partitions_keep_the_order_of_their_key(loaded):
    """Alike rows stand together, so that a copy of the table shuffles no more than the load did."""
    stored = loaded.spark.read.parquet(loaded.store.folder("dim_employee")).select(
        F.input_file_name().alias("f"), "emp_key"
    )
    for file, found in stored.groupBy("f").agg(F.collect_list("emp_key")).collect():
        assert found == sorted(found), file


def test_fanning_facts_shuffle_staged_rows_once(loaded, no_broadcast):
    plan = plan_of(registry.fact_reviews_v1_fanout(loaded))
    assert "ShuffledHashJoin" in plan
    staged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("effective_start_date" in line for line in staged) == 2  # both sides of one join


def test_joins_beyond_broadcast_size_are_sort_merge(loaded, no_broadcast):
    plan = plan_of(registry.top_performers_by_department(loaded))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.fixture(scope="module")
def hot_staging(spark, sf_dir):
    """Employee 10001 owns a third of all rows, many of them on one day."""
    staging = source.staging_rows(spark, sf_dir)
    extra = staging.sparkSession.range(750).crossJoin(staging.filter("employee_id = 10001").limit(1))
    key = F.col("id")
    hot = extra.select(
        *[F.col(c) for c in staging.columns if c not in ("effective_start_date", "is_current", "src_key")],
        F.when(key % 2 == 0, F.lit("1994-06-01").cast("date"))
        .otherwise(F.date_add(F.lit("1993-01-01").cast("date"), (key % 300).cast("int")))
        .alias("effective_start_date"),
        F.lit(0).alias("is_current"),
        (key + 1_000_000).alias("src_key"),
    )
    return staging.unionByName(hot).repartition(16).persist()


def test_hot_employee_loads_whole(spark, hot_staging, store_root):
    store = Tables(spark, store_root)
    tables = run_full_load(spark, hot_staging, store, LoadConfig("1990-01-01", "2035-12-31")).tables
    days = hot_staging.select("employee_id", "effective_start_date").distinct()
    assert tables["dim_employee"].count() == days.count()
    found = tables["dim_employee"].agg(F.min("emp_key"), F.max("emp_key"), F.countDistinct("emp_key")).first()
    assert tuple(found) == (1, days.count(), days.count())
    broken = quality.scd2_integrity(tables["dim_employee"]).filter("violations > 0")
    assert broken.collect() == []
    separate = olap.fact_reviews(
        hot_staging, tables["dim_employee"], tables["dim_department"], tables["dim_project"],
        tables["dim_date"], tables["project_assignments"],
    )
    assert rows(separate) == rows(tables["fact_performance_reviews"])
    reviews = oltp.performance_reviews(hot_staging, tables["employees"])
    assert rows(reviews) == rows(tables["performance_reviews"])


def test_hot_key_sends_one_row_per_map_task(spark):
    df = spark.range(30_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    one = keep_one(df, ["k"], [F.desc("v")])
    assert one.count() == 20_001
    assert one.filter("k = 0").first().v == 29_997
    plan = plan_of(one)
    partial, exchange = plan.index("Partial"), plan.index("Exchange hashpartitioning")
    assert partial > exchange  # children come below: the limit runs before the shuffle
