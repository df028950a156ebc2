"""Input rules: messages, their order and the early exits."""

from __future__ import annotations

import pytest
from conftest import day
from pyspark.sql import functions as F

from rosterlake.functions import rules

REQUIRED = "**First Name** is required."
DIGITS = "**First Name** cannot contain numbers or digits."
LETTERS = "**First Name** can only contain letters, spaces, hyphens, and apostrophes (2–50 characters)."
REPEATED = "**First Name** cannot consist of a single repeated character."


def _errors(spark, values, schema, errors):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r.errors for r in df.select(errors.alias("errors")).collect()]


def test_names(spark):
    cases = {
        "Anne-Marie O'Neil": [],
        "  Jo  ": [],
        None: [REQUIRED],
        "": [REQUIRED],
        " \t \x1f": [REQUIRED],
        "J": [LETTERS, REPEATED],
        "Aa aA": [REPEATED],
        "J4ne": [DIGITS, LETTERS],
        "Jane²": [DIGITS, LETTERS],
        "Jane٣": [DIGITS, LETTERS],
        "José": [LETTERS],
        "x" * 30 + "y" * 21: [LETTERS],
        "7": [DIGITS, LETTERS, REPEATED],
        "Ann Lee": [],
    }
    found = _errors(spark, list(cases), "n STRING", rules.name_errors(F.col("n"), "First Name"))
    assert dict(zip(cases, found)) == cases


def test_emails_report_the_first_broken_rule(spark):
    cases = {
        "jane.doe@company.com": [],
        "  jane+x@a.co  ": [],
        None: [rules.EMAIL_REQUIRED],
        "   ": [rules.EMAIL_REQUIRED],
        "jane doe@x": [rules.EMAIL_SPACES],
        "bad@host": [rules.EMAIL_INVALID],
        "jane @x.com": [rules.EMAIL_INVALID],
        "jane@x.c": [rules.EMAIL_INVALID],
    }
    assert dict(zip(cases, _errors(spark, list(cases), "e STRING", rules.email_errors(F.col("e"))))) == cases


def test_phones(spark):
    cases = {
        None: [],
        "  ": [],
        "555-0199-1": [],
        "+1 (555) 010-9999": [],
        "555-01": [rules.PHONE_DIGITS, rules.PHONE_FORMAT],
        "555-0199-1 x2": [rules.PHONE_LETTERS, rules.PHONE_FORMAT],
        "call": [rules.PHONE_DIGITS, rules.PHONE_LETTERS, rules.PHONE_FORMAT],
        "12345678901234567890123": [rules.PHONE_FORMAT],
        "٠١٢٣٤٥٦٧": [],
    }
    assert dict(zip(cases, _errors(spark, list(cases), "p STRING", rules.phone_errors(F.col("p"))))) == cases


def test_timeline(spark):
    today = F.lit("2026-08-15").cast("date")
    cases = [
        ((30, day("2020-01-01"), 5), []),
        ((17, day("2026-01-01"), 0), [rules.AGE]),
        ((76, day("2020-01-01"), 0), [rules.AGE]),
        ((18, day("2026-08-16"), 0), [rules.HIRE_FUTURE]),
        ((18, day("2024-01-01"), 0), []),
        (
            (18, day("2023-12-31"), 3),
            [
                "Hire date (2023) implies employee was hired before age 16 (Age: 18).",
                "Total working years (3) exceeds maximum possible career span for age 18 (max allowed: 2 years).",
            ],
        ),
    ]
    errors = rules.timeline_errors(F.col("a"), F.col("h"), F.col("w"), today)
    found = _errors(spark, [c for c, _ in cases], "a INT, h DATE, w INT", errors)
    assert found == [e for _, e in cases]


def test_assignment_requests(spark):
    schema = "employee_id INT, project_id LONG, role_in_project STRING, allocation_percentage INT"
    cases = [
        ((10001, 1, " Lead Dev_1".replace("_1", ""), 10), []),
        ((10000, 0, "Lead 2", 9), [rules.EMPLOYEE_ID, rules.PROJECT_ID, rules.ROLE, rules.ALLOCATION]),
        ((10001, 1, "  ", 100), [rules.ROLE]),
        ((10001, 1, "x", 101), [rules.ROLE, rules.ALLOCATION]),
        ((10001, 1, "Q.A._Lead's", 50), []),
    ]
    assert _errors(spark, [c for c, _ in cases], schema, rules.assignment_errors()) == [e for _, e in cases]


@pytest.mark.parametrize("income,ok", [("999.99", False), ("1000.00", True), ("500000.00", True), ("500000.01", False)])
def test_role_updates(spark, income, ok):
    df = spark.range(1).select(
        F.lit(10001).alias("employee_id"),
        F.lit(income).cast("decimal(10,2)").alias("new_monthly_income"),
    )
    found = df.select(rules.role_update_errors().alias("e")).first().e
    assert found == ([] if ok else [rules.UPDATED_INCOME])


def test_reviews(spark):
    cases = [((10001, 1), []), ((10001, 5), [rules.RATING]), ((9, 0), [rules.EMPLOYEE_ID, rules.RATING]),
             ((10001, None), [rules.RATING])]
    found = _errors(spark, [c for c, _ in cases], "employee_id INT, rating INT", rules.review_errors())
    assert found == [e for _, e in cases]
