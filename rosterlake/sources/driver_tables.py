"""Mapping of the driver's parquet tables to staging rows and change feeds (see FIXTURES.md).

One customer is one employee, one order is one version of that employee.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators.timeline import open_end, with_successor_day
from rosterlake.schemas import SOURCE_KEY, STAGING

FIRST_EMPLOYEE_ID = 10001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def employee_id(custkey: str | Column) -> Column:
    return (F.col(custkey) if isinstance(custkey, str) else custkey) + F.lit(FIRST_EMPLOYEE_ID)


def _pick(index: Column, *labels: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (index + 1).cast("int"))


def staging_rows(spark: SparkSession, sf_dir: str, with_staged_end: bool = False) -> DataFrame:
    """The 42 staging columns plus ``src_key``.

    ``effective_end_date`` is only read by the trusting load and the file round trip; it is
    NULL unless asked for.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.to_date("o_orderdate").alias("start"),
    )
    # First and latest version per employee, aggregated map-side instead of windowed.
    spans = orders.groupBy("o_custkey").agg(
        F.min("start").alias("hired"), F.max(F.struct("start", "o_orderkey")).alias("latest")
    )
    if with_staged_end:
        orders = with_successor_day(orders, "o_custkey", "start", ["o_orderkey"], "next_start")
    else:
        orders = orders.withColumn("next_start", F.lit(None).cast("date"))

    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    moved = F.when(key % 10 < 3, 1).otherwise(0)
    # One row per customer on the right, so a busy customer skews a single, splittable join.
    people = spans.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    rows = (
        orders.join(people, "o_custkey")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("r_regionkey") == (F.col("n_regionkey") + moved) % 5)
    )

    def score(null_every: int) -> Column:
        return F.when(key % null_every != 0, key % 4 + 1)

    is_latest = F.struct("start", "o_orderkey") == F.col("latest")
    columns = {
        "employee_id": employee_id("o_custkey"),
        "Age": cust % 50 + 18,
        "Attrition": F.when(
            key % 13 != 0, F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")
        ),
        "BusinessTravel": _pick(key % 3, "Travel_Rarely", "Travel_Frequently", "Non-Travel"),
        "DailyRate": key % 1400 + 100,
        "Department": F.col("r_name"),
        "DistanceFromHome": cust % 29 + 1,
        "Education": cust % 5 + 1,
        "EducationField": F.concat(F.lit("Field "), (cust % 6).cast("string")),
        "EnvironmentSatisfaction": score(19),
        "Gender": _pick(cust % 2, "Female", "Male"),
        "HourlyRate": key % 70 + 30,
        "JobInvolvement": score(29),
        "JobLevel": F.substring("o_orderpriority", 1, 1),
        "JobRole": F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")),
        "JobSatisfaction": score(11),
        "MaritalStatus": _pick(cust % 3, "Single", "Married", "Divorced"),
        "MonthlyIncome": F.col("o_totalprice"),
        "MonthlyRate": key % 25000 + 2000,
        "NumCompaniesWorked": cust % 10,
        "OverTime": _pick(key % 2, "No", "Yes"),
        "PercentSalaryHike": key % 15 + 11,
        "PerformanceRating": F.when(key % 17 != 0, F.when(key % 6 == 0, 4).otherwise(3)),
        "RelationshipSatisfaction": score(31),
        "StockOptionLevel": cust % 4,
        "TotalWorkingYears": cust % 40,
        "TrainingTimesLastYear": key % 7,
        "WorkLifeBalance": key % 4 + 1,
        "YearsAtCompany": cust % 20,
        "YearsInCurrentRole": cust % 15,
        "YearsSinceLastPromotion": cust % 10,
        "YearsWithCurrManager": cust % 12,
        "first_name": F.concat(F.lit(" "), F.substring("c_name", 1, 8)),
        "last_name": F.concat(F.expr("substring(c_name, 10)"), F.lit("  ")),
        "email": F.concat(F.lit(" "), F.col("c_name"), F.lit("@Company.COM")),
        "phone_number": F.concat(
            F.lit("555-"), F.lpad((cust % 10000).cast("string"), 4, "0")
        ),
        "department_id": F.when(key % 100 != 0, F.col("r_regionkey") + 1),
        "hire_date": F.col("hired"),
        "effective_start_date": F.col("start"),
        "effective_end_date": F.coalesce("next_start", F.when(is_latest, open_end()))
        if with_staged_end
        else F.col("next_start"),
        "is_current": F.when(is_latest, 1).otherwise(0),
        "change_reason": F.when(
            key % 23 != 0,
            _pick(
                key % 4, "Promotion & Salary Hike", "Department Transfer",
                "Annual Merit Increase", "Annual Merit Increase",
            ),
        ),
    }
    typed = [columns[f.name].cast(f.dataType).alias(f.name) for f in STAGING.fields]
    return rows.select(*typed, key.cast("long").alias(SOURCE_KEY))


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return events.withColumn("day", F.to_date("ts"))


def role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role, department and income changes; every fiftieth names an unknown employee."""
    event = F.col("event_id")
    unknown = event + 9_000_000
    return _events(spark, sf_dir, "purchase").select(
        event.alias("change_id"),
        "ts",
        F.col("day").alias("change_date"),
        F.when(event % 50 == 0, unknown)
        .otherwise(employee_id("user_id")).cast("int").alias("employee_id"),
        (event % 5 + 1).cast("int").alias("new_department_id"),
        (event % 25 + 1).cast("long").alias("new_job_id"),
        (F.col("value").cast("decimal(10,2)") + 1000).cast("decimal(10,2)")
        .alias("new_monthly_income"),
    )


def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings 0 and 5 are out of range."""
    return _events(spark, sf_dir, "click").select(
        F.col("event_id").alias("request_id"),
        "ts",
        employee_id("user_id").cast("int").alias("employee_id"),
        F.col("day").alias("review_date"),
        (F.col("event_id") % 6).cast("int").alias("rating"),
    )


def assignment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project 0, roles with a digit and allocations 0 and 110 are invalid."""
    event = F.col("event_id")
    return _events(spark, sf_dir, "view").select(
        event.alias("request_id"),
        "ts",
        employee_id("user_id").cast("int").alias("employee_id"),
        (event % 6).cast("long").alias("project_id"),
        F.when(event % 9 == 0, "Lead 2").otherwise("Contributor").alias("role_in_project"),
        (event % 12 * 10).cast("int").alias("allocation_percentage"),
        F.col("day").alias("assigned_date"),
    )


def raise_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent -1 and 0 are invalid."""
    return _events(spark, sf_dir, "signup").select(
        F.col("event_id").alias("request_id"),
        "ts",
        employee_id("user_id").cast("int").alias("employee_id"),
        (F.col("event_id") % 12 - 1).cast("decimal(5,2)").alias("percent"),
    )


def raises_of_one(spark: SparkSession, sf_dir: str, employee: int) -> DataFrame:
    """Every event as a small raise of one employee: more than one run of the fold holds. Percents
    have three decimals; every fiftieth is missing, every seventh zero."""
    event = F.col("event_id")
    percent = ((event % 7).cast("decimal(10,3)") / 1000).cast("decimal(6,3)")
    return table(spark, sf_dir, "events").select(
        event.alias("request_id"),
        "ts",
        F.lit(employee).cast("int").alias("employee_id"),
        F.when(event % 50 != 49, percent).alias("percent"),
    )


def late_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role changes, a third of them moved before the versions and some without a date."""
    changes = role_changes(spark, sf_dir)
    moved = F.when(F.col("change_id") % 3 == 1, F.date_sub("change_date", 15_000)).otherwise(F.col("change_date"))
    dated = F.when(F.col("change_id") % 40 != 7, moved)
    early = F.when(F.col("change_id") % 3 == 1, F.col("ts") - F.expr("INTERVAL 15000 DAY")).otherwise(F.col("ts"))
    return changes.withColumn("change_date", dated).withColumn("ts", early)


def incomplete_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates, each without one of the fields that must be there, or complete."""
    names = ("first_name", "email", "age", "hire_date", "total_working_years", "monthly_income", "manager_id")
    gaps = {
        name: F.when(F.col("candidate_id") % 8 != n, F.col(name)) for n, name in enumerate(names)
    }
    return onboarding_candidates(spark, sf_dir).withColumns(gaps)


def onboarding_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per supplier, in supplier order."""
    key = F.col("s_suppkey")
    letters = F.translate(F.expr("substring(s_name, 10)"), "0123456789", "abcdefghij")
    nation = F.translate(F.col("s_nationkey").cast("string"), "0123456789", "klmnopqrst")
    mailbox = F.concat(
        F.lower(F.substring("s_name", 1, 8)), key.cast("string"), F.lit("@company.com")
    )
    return table(spark, sf_dir, "supplier").select(
        key.alias("candidate_id"),
        F.when(key % 4 == 3, F.col("s_name")).otherwise(letters).alias("first_name"),
        F.when(key % 10 == 9, " ").otherwise(F.concat(F.lit("O'Neil-"), nation)).alias("last_name"),
        F.when(key % 7 == 0, "no at sign")
        .when(key % 7 == 1, "bad@host")
        .otherwise(mailbox).alias("email"),
        F.when(key % 5 == 0, F.lit(None))
        .when(key % 5 == 1, "555-01")
        .when(key % 5 == 2, "+1 (555) 010-9999 x2")
        .otherwise(F.concat(F.lit("555-0199-"), key.cast("string"))).alias("phone_number"),
        (key % 64 + 16).cast("int").alias("age"),
        F.lit("2020-01-01").cast("date").alias("hire_date"),
        (key % 45).cast("int").alias("total_working_years"),
        F.col("s_acctbal").cast("decimal(10,2)").alias("monthly_income"),
        (key % 8).cast("int").alias("manager_id"),
        (key % 5 + 1).cast("int").alias("department_id"),
        (key % 27 + 1).cast("long").alias("job_id"),
    )


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query text per event: the audit templates with the event's own values inside."""
    event = F.col("event_id").cast("string")
    kind = F.col("event_type")
    templates = [
        F.concat(F.lit("SELECT "), event),
        F.concat(F.lit("  SELECT "), event, F.lit(";  ")),
        F.concat(F.lit("select * from "), kind, F.lit("; drop table "), kind),
        F.concat(F.lit("UPDATE "), kind, F.lit(" SET a="), event),
        F.concat(F.lit("WITH a AS (SELECT "), event, F.lit(") SELECT * FROM a")),
        F.concat(F.lit("SELECT 'please UPDATE "), kind, F.lit("'")),
        F.concat(F.lit("SELECT updated_at FROM "), kind),
        F.concat(F.lit("SELECT * FROM (SELECT * FROM "), kind, F.lit(" limit  5) x")),
        F.concat(F.lit("SELECT * FROM "), kind, F.lit(" INTO OUTFILE '"), event, F.lit("'")),
        F.concat(F.lit("EXECUTE p"), event),
        F.concat(F.lit("SELECT EXECUTE FROM "), kind, F.lit(";;")),
    ]
    text = F
    for number, template in enumerate(templates):
        text = text.when(F.col("event_id") % 12 == number, template)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), text.otherwise("").alias("sql_text")
    )


def routed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per event over either layer, with the event's own values."""
    number = F.col("event_id").cast("string")
    person = employee_id("user_id").cast("string")
    templates = [
        ("SELECT full_name, monthly_income FROM DIM_EMPLOYEE WHERE employee_id = ", person, ""),
        ("SELECT phone_number FROM EMPLOYEES WHERE employee_id = ", person, ";"),
        ("select e.Manager_ID, e.total_working_years from employees e where e.employee_id = ", person, ""),
        ("SELECT 'the phone_number of ", person, "' AS note, full_name FROM dim_employee"),
        ("SELECT department_name FROM departments WHERE department_id = ", number, " % 5"),
        ("WITH a AS (SELECT allocation_percentage FROM project_assignments WHERE employee_id = ", person,
         ") SELECT max(allocation_percentage) FROM a"),
        ("SELECT full_name AS phone_number FROM DIM_EMPLOYEE -- not the manager_id of ", number, ""),
        ("SELECT ", number, ""),
        ("WITH projects AS (SELECT project_name FROM dim_project WHERE project_key = ", number,
         ") SELECT * FROM projects"),
        ("SELECT f.performance_rating /* no age */ FROM fact_performance_reviews f WHERE f.emp_key = ", number, ""),
    ]
    text = F
    for nth, (before, value, after) in enumerate(templates):
        text = text.when(F.col("event_id") % 11 == nth, F.concat(F.lit(before), value, F.lit(after)))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), text.otherwise("").alias("sql_text")
    )


def damaged_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows as text: some with a word for a number, some with a day that does not exist, some
    with a decimal point too many."""
    rows = staging_rows(spark, sf_dir, with_staged_end=True)
    key = F.col(SOURCE_KEY)
    damage = {
        "Age": F.when(key % 97 == 5, "forty"),
        "hire_date": F.when(key % 89 == 7, "2020-02-31"),
        "MonthlyIncome": F.when(key % 101 == 3, "1.000.50"),
    }
    text = {name: F.col(name).cast("string") for name in rows.columns}
    return rows.select(*[F.coalesce(damage.get(n, F.lit(None)), t).alias(n) for n, t in text.items()])


def version_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(employee, day) pairs that fall before, inside and after the known versions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("probe_id"),
        employee_id("o_custkey").cast("int").alias("employee_id"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400 - 30).cast("int"))
        .alias("probe_date"),
    )
