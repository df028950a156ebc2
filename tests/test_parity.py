"""Every registered query against its DuckDB statement on the same parquet files."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from rosterlake.plans.parity_sql import parity_sql
from rosterlake.plans.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# The warehouse's own queries; those on text are tested in tests/llm.
STATEMENTS = parity_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(driver.queries()) and set(STATEMENTS) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_equal_to_duckdb(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(STATEMENTS[name])
    expected_columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(expected_columns)
    order = sorted(result.columns)

    def normal(found, columns):
        positions = [columns.index(c) for c in order]
        return sorted(tuple(repr(row[i]) for i in positions) for row in found)

    assert normal(result.collect(), result.columns) == normal(cursor.fetchall(), expected_columns)


def test_entry_is_the_flagship(spark):
    result = driver.entry(spark)
    assert result.columns == [
        "department_name", "full_name", "employee_id", "performance_rating",
        "percent_salary_hike", "rnk",
    ]
    assert 0 < result.count() <= 25
