"""Audit of query texts and guarded execution."""

from __future__ import annotations

import pytest
from conftest import rows

from rosterlake.plans import adhoc, routing

MULTI, START, VALID = adhoc.MULTI, adhoc.START, adhoc.VALID

TEXTS = {
    "SELECT 1": VALID,
    "SELECT 1;": VALID,
    "  select 1 ;  ": VALID,
    "SELECT 1;;": MULTI,
    "select * from t; drop table t": MULTI,
    "UPDATE t SET a=1": START,
    "WITH a AS (SELECT 1) SELECT * FROM a": VALID,
    "SELECT 'please UPDATE me'": "Forbidden keyword detected: 'UPDATE'.",
    "SELECT updated_at FROM t": VALID,
    "SELECT * FROM (SELECT * FROM t LIMIT 5) x": VALID,
    "SELECT * FROM t INTO OUTFILE 'x'": "Forbidden keyword detected: 'INTO OUTFILE'.",
    "EXECUTE p": START,
    "SELECT EXECUTE FROM t": VALID,
    "SELECT CALL FROM t WHERE DROP": "Forbidden keyword detected: 'DROP'.",
    "": START,
    ";": START,
    "SELECT ÜDROP FROM t": VALID,
    "SELECT a FROM t WHERE x = 'EXEC' AND y = 'call'": "Forbidden keyword detected: 'EXEC'.",
}


def test_audit(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "sql_text STRING")
    found = adhoc.sql_audit(df).collect()
    assert {r.sql_text: r.reason for r in found} == TEXTS
    limited = {r.sql_text: r.limited_sql for r in found}
    assert limited["SELECT 1;"] == "SELECT 1 LIMIT 100;"
    assert limited["SELECT * FROM (SELECT * FROM t LIMIT 5) x"].endswith("x")
    assert limited["EXECUTE p"] is None


def test_guarded_query_sees_one_layer(loaded):
    found = adhoc.run_guarded(loaded.store, "SELECT COUNT(*) AS n FROM Fact_PerformanceReviews;")
    assert rows(found) == [(loaded["fact_performance_reviews"].count(),)]
    found = adhoc.run_guarded(loaded.store, "SELECT phone_number FROM EMPLOYEES", layer="OLTP")
    assert found.count() == min(100, loaded["employees"].count())
    with pytest.raises(adhoc.RejectedQuery, match="table EMPLOYEES"):
        adhoc.run_guarded(loaded.store, "SELECT * FROM EMPLOYEES", layer="OLAP")


ROUTES = {
    "SELECT full_name FROM DIM_EMPLOYEE": ("OLAP", "default"),
    "SELECT e.Phone_Number, e.AGE FROM employees e": ("OLTP", "needs age, phone_number"),
    "SELECT email FROM employees": ("OLTP", "reads employees"),
    "SELECT count(*) FROM (SELECT 1 FROM jobs j JOIN departments d ON true) x": ("OLTP", "reads departments, jobs"),
    "SELECT full_name AS phone_number FROM dim_employee": ("OLAP", "default"),
    "SELECT 'phone_number', full_name FROM dim_employee -- manager_id": ("OLAP", "default"),
    "SELECT full_name /* of all\n employees */ FROM dim_employee": ("OLAP", "default"),
    "WITH employees AS (SELECT full_name FROM dim_employee) SELECT * FROM employees": ("OLAP", "default"),
    "WITH a AS (SELECT manager_id FROM employees) SELECT * FROM a": ("OLTP", "needs manager_id"),
    "SELECT full_name FROM dim_employee WHERE employee_id IN (SELECT employee_id FROM employees WHERE age > 40)":
        ("OLTP", "needs age"),
    "SELECT max(`marital_status`) OVER (PARTITION BY department_id) FROM employees ORDER BY gender;":
        ("OLTP", "needs gender, marital_status"),
    "SELECT 1": ("OLAP", "default"),
}


def test_texts_and_plans_route_alike(spark):
    df = spark.createDataFrame([(t,) for t in [*ROUTES, "", None]], "sql_text STRING")
    found = {r.sql_text: (r.layer, r.reason) for r in routing.routed(df).collect()}
    assert found == {**ROUTES, "": ("OLAP", "default"), None: ("OLAP", "default")}
    assert {text: adhoc.route(spark, text) for text in ROUTES} == ROUTES


def test_guarded_query_finds_its_layer(loaded):
    found = adhoc.run_guarded(loaded.store, "SELECT employee_id, total_working_years FROM EMPLOYEES LIMIT 7")
    assert found.count() == 7
    assert adhoc.run_guarded(loaded.store, "SELECT COUNT(*) AS n FROM DIM_EMPLOYEE").first().n > 0
    with pytest.raises(adhoc.RejectedQuery):  # needs both layers at once
        adhoc.run_guarded(loaded.store, "SELECT e.age FROM employees e JOIN dim_employee d ON true")


def test_guarded_query_leaves_no_views_behind(spark, loaded):
    adhoc.run_guarded(loaded.store, "SELECT 1")
    assert "dim_employee" not in {t.name for t in spark.catalog.listTables()}


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE employees",
        "SELECT 1; SELECT 2",
        "SELECT reflect('java.lang.System', 'exit', 1)",
    ],
)
def test_refused_texts(loaded, text):
    with pytest.raises(adhoc.RejectedQuery):
        adhoc.run_guarded(loaded.store, text)


def test_files_cannot_be_read_by_path(loaded, sf_dir):
    with pytest.raises(adhoc.RejectedQuery, match="table parquet"):
        adhoc.run_guarded(loaded.store, f"SELECT * FROM parquet.`{sf_dir}/orders.parquet`").collect()


REFUSED = [
    "SELECT TRANSFORM(department_id) USING 'sed s/^/ran-/' AS (x) FROM departments",
    "WITH a AS (SELECT TRANSFORM(department_id) USING 'cat' AS (x) FROM departments) SELECT * FROM a",
    "SELECT * FROM departments WHERE department_id IN (SELECT TRANSFORM(1) USING 'cat' AS (x))",
    "SELECT (SELECT max(x) FROM (SELECT TRANSFORM(1) USING 'cat' AS (x))) AS y",
    "SELECT * FROM (MAP department_id USING 'cat' AS x FROM departments)",
    "SELECT * FROM (REDUCE department_id USING 'cat' AS x FROM departments)",
    "SELECT * FROM default.outside_t",
    "SELECT * FROM spark_catalog.default.outside_t",
    "SELECT * FROM outside_t",
    "SELECT * FROM global_temp.outside_v",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM range(10)",
    "SELECT * FROM departments WHERE EXISTS (SELECT 1 FROM default.outside_t)",
    "SELECT reflect('java.lang.System', 'exit', 0)",
    "SELECT `java_method`('java.lang.System', 'exit', 0)",
    "SELECT max(try_reflect('java.lang.System', 'getenv', 'HOME')) OVER () FROM departments",
    "SELECT sleep(1)",
    "SELECT input_file_name() FROM departments",
    "WITH a AS (SELECT 1",
]


@pytest.mark.parametrize("text", REFUSED)
def test_guard_refuses_what_is_no_query_over_the_layer(spark, loaded, text):
    spark.range(1).write.mode("overwrite").saveAsTable("outside_t")
    spark.range(1).createOrReplaceGlobalTempView("outside_v")
    with pytest.raises(adhoc.RejectedQuery):
        adhoc.run_guarded(loaded.store, text, layer="OLTP")


def test_guard_passes_plain_queries(loaded):
    text = """WITH big AS (SELECT department_id, COUNT(*) AS n FROM employees GROUP BY department_id HAVING COUNT(*) > 0)
        SELECT d.department_name, b.n, RANK() OVER (ORDER BY b.n DESC) AS r FROM big b JOIN departments d
        ON b.department_id = d.department_id WHERE d.department_id IN (SELECT department_id FROM employees)
        ORDER BY r, upper(d.department_name) LIMIT 3"""
    assert 0 < adhoc.run_guarded(loaded.store, text, layer="OLTP").count() <= 3
