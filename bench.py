"""Headline timings at one scale: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from rosterlake.plans.registry import QUERIES, load_warehouse, warehouse
from rosterlake.session import tuned

HEADLINE = (
    "top_performers_by_department",
    "attrition_rate_by_department",
    "avg_income_by_role",
    "attrition_risk_flags",
    "yearly_trends",
    "combined_kpis",
    "employee_directory",
    "employee_version_asof",
    "dedup_staging",
    "surrogate_keys",
    "dim_employee_scd2",
    "fact_reviews",
    "oltp_employees",
    "oltp_reviews",
    "scd2_apply_changes",
    "update_employee_roles",
    "assign_projects_upsert",
    "submit_reviews",
    "give_raises",
    "scd2_integrity_loaded",
    "fk_violations",
    "sql_audit",
    "replicate_to_target",
    "stage_csv_roundtrip",
)
RUNS = 3


def drain(df: DataFrame) -> None:
    """Compute every row and column, keep none."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rosterlake-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    spark = tuned(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    warehouse(spark, sf_dir)  # JVM warm-up and the tables the queries read
    seconds = {"full_load": min(timed(lambda: load_warehouse(spark, sf_dir)) for _ in range(RUNS))}
    for name in HEADLINE:
        query = QUERIES[name]
        seconds[name] = min(timed(lambda: drain(query(spark, sf_dir))) for _ in range(RUNS))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
