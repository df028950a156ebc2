"""Dashboard and directory queries over the two layers."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import labels
from rosterlake.functions.measures import exact_avg, or_zero
from rosterlake.operators.merge import top_n_per_group
from rosterlake.session import materialise
from rosterlake.sources.tables import LAYERS, Tables

TOP_RATING = 4
# Fixed value: how long a bundle of results is kept.
CACHE_SECONDS = 300


def current(dim_employee: DataFrame) -> DataFrame:
    """Current versions; the dimension is stored by this flag, so old versions are not read."""
    return dim_employee.filter("is_current = 1")


# --- executive indicators ---------------------------------------------------------------


def active_dim_employees(dim_employee: DataFrame) -> DataFrame:
    return current(dim_employee).agg(F.count(F.lit(1)).alias("active_count"))


def avg_income_current(dim_employee: DataFrame) -> DataFrame:
    return current(dim_employee).agg(or_zero(exact_avg("monthly_income")).alias("avg_income"))


def avg_performance_rating(fact: DataFrame) -> DataFrame:
    return fact.agg(or_zero(exact_avg("performance_rating")).alias("avg_rating"))


def avg_job_satisfaction(fact: DataFrame) -> DataFrame:
    return fact.agg(or_zero(exact_avg("job_satisfaction")).alias("avg_satisfaction"))


def combined_kpis(dim_employee: DataFrame, fact: DataFrame) -> DataFrame:
    """One row: headcount and pay of current versions, scores over all facts."""
    staff = current(dim_employee).agg(
        F.count(F.lit(1)).alias("active_count"),
        exact_avg("monthly_income").alias("avg_income"),
    )
    scores = fact.agg(
        exact_avg("performance_rating").alias("avg_rating"),
        exact_avg("job_satisfaction").alias("avg_satisfaction"),
    )
    return _kpis_of(staff, scores)


def _kpis_of(staff: DataFrame, scores: DataFrame) -> DataFrame:
    """One row from a row of staff and a row of scores, either of which may be missing."""
    staff, scores = staff.select("active_count", "avg_income"), scores.select("avg_rating", "avg_satisfaction")
    both = staff.unionByName(scores, allowMissingColumns=True)
    return both.agg(
        F.coalesce(F.max("active_count"), F.lit(0)).alias("active_count"),
        *[or_zero(F.max(c)).alias(c) for c in ("avg_income", "avg_rating", "avg_satisfaction")],
    )


def kpi_cards(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        labels.count_display(F.col("active_count")).alias("active_employees"),
        labels.score_display(F.col("avg_rating")).alias("avg_performance_rating"),
        labels.money_display(F.col("avg_income")).alias("avg_monthly_income"),
        labels.score_display(F.col("avg_satisfaction")).alias("avg_job_satisfaction"),
    )


# --- attrition --------------------------------------------------------------------------


def attrition_rate_by_department(dim_employee: DataFrame, dim_department: DataFrame) -> DataFrame:
    # Counted per id first: the join then sees one row per department.
    left = F.col("attrition") == "Yes"
    per_id = (
        current(dim_employee)
        .groupBy("department_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(left).alias("yes"))
    )
    names = dim_department.select("department_id", "department_name")
    rate = F.lit(100) * F.sum("yes").cast("decimal(20,0)") / F.sum("n")
    return (
        per_id.join(names, "department_id")
        .groupBy("department_name")
        .agg(F.round(rate, 2).cast("double").alias("attrition_rate_pct"))
    )


def attrition_share(rates: DataFrame) -> DataFrame:
    """Each department's part of the sum of rates, in percent."""
    total = rates.agg(F.sum("attrition_rate_pct")).scalar()
    share = F.round(F.lit(100) * F.col("attrition_rate_pct") / F.nullif(total, F.lit(0.0)), 4)
    return rates.select("department_name", "attrition_rate_pct", share.alias("share_pct"))


def attrition_risk_flags(
    fact: DataFrame,
    dim_employee: DataFrame,
    dim_department: DataFrame,
    dim_date: DataFrame,
    threshold: int = 2,
    limit: int = 50,
) -> DataFrame:
    """Least satisfied current employees, latest reviews first."""
    low = fact.filter(F.col("job_satisfaction") <= threshold).select(
        "review_fact_id", "emp_key", "dept_key", "review_date_key", "job_satisfaction"
    )
    staff = current(dim_employee).select("emp_key", "employee_id", "job_role")
    people = (
        low.join(staff, "emp_key")
        .join(dim_department.select("dept_key", "department_name"), "dept_key")
        .join(
            dim_date.select(
                F.col("date_key").alias("review_date_key"), F.col("full_date").alias("review_date")
            ),
            "review_date_key",
        )
    )
    return least_satisfied(people, limit)


def least_satisfied(people: DataFrame, limit: int) -> DataFrame:
    """The first of the reviews joined with their employees and departments."""
    return (
        people.orderBy("job_satisfaction", F.desc("review_date"), "employee_id", "review_fact_id")
        .limit(limit)
        .select("employee_id", "department_name", "job_role", "job_satisfaction", "review_date")
    )


# --- performance ------------------------------------------------------------------------


def _current_reviews(fact: DataFrame, dim_employee: DataFrame, dim_department: DataFrame) -> DataFrame:
    staff = current(dim_employee).select("emp_key", "full_name", "employee_id")
    return (
        fact.select(
            "review_fact_id", "emp_key", "dept_key", "performance_rating",
            "percent_salary_hike", "monthly_income",
        )
        .join(staff, "emp_key")
        .join(dim_department.select("dept_key", "department_name"), "dept_key")
    )


def top_performers_by_department(
    fact: DataFrame, dim_employee: DataFrame, dim_department: DataFrame, top_n: int = 5
) -> DataFrame:
    return ranked_performers(_current_reviews(fact, dim_employee, dim_department), top_n)


def ranked_performers(people: DataFrame, top_n: int) -> DataFrame:
    """The best of every department, of the reviews joined with their employees and departments."""
    best_first = [
        F.desc_nulls_last("performance_rating"),
        F.desc_nulls_last("percent_salary_hike"),
        F.desc_nulls_last("monthly_income"),
        F.col("emp_key"),
        F.col("review_fact_id"),
    ]
    ranked = top_n_per_group(people, ["department_name"], best_first, top_n, "rnk")
    return ranked.select(
        "department_name", "full_name", "employee_id", "performance_rating",
        "percent_salary_hike", "rnk",
    ).orderBy("department_name", "rnk")


def performer_labels(performers: DataFrame) -> DataFrame:
    label = labels.performer_label(F.col("rnk"), F.col("full_name"), F.col("department_name"))
    return performers.select(
        label.alias("emp_label"), "percent_salary_hike", "department_name", "performance_rating"
    )


def performers_by_hike(performers: DataFrame) -> DataFrame:
    """Labels in ascending order of their total hike, as the chart stacks them."""
    bars = performer_labels(performers).groupBy("emp_label")
    return bars.agg(F.sum("percent_salary_hike").alias("total_hike")).orderBy(
        "total_hike", "emp_label"
    )


def top_performer_flag(reviews: DataFrame) -> DataFrame:
    rating: Column = F.col("performance_rating")
    return reviews.select(
        "review_id", "employee_id", "performance_rating",
        (rating >= TOP_RATING).alias("is_top_performer"),
    )


# --- pay and trends ---------------------------------------------------------------------


def avg_income_by_role(dim_employee: DataFrame) -> DataFrame:
    by_role = current(dim_employee).groupBy("job_role")
    return by_role.agg(exact_avg("monthly_income").alias("avg_income")).orderBy(
        F.desc_nulls_last("avg_income"), "job_role"
    )


def yearly_trends(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    years = dim_date.select(F.col("date_key").alias("review_date_key"), "year")
    return (
        fact.join(years, "review_date_key")
        .groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            exact_avg("performance_rating").alias("avg_rating"),
            exact_avg("job_satisfaction").alias("avg_satisfaction"),
            exact_avg("monthly_income").alias("avg_income"),
            exact_avg("percent_salary_hike").alias("avg_salary_hike"),
        )
        .orderBy("year")
    )


def yearly_scores_long(trends: DataFrame) -> DataFrame:
    """Two score columns as (year, metric, value)."""
    scores = ["avg_rating", "avg_satisfaction"]
    year = F.col("year").cast("string").alias("year_str")
    return trends.select(year, *scores).unpivot("year_str", scores, "metric", "value")


def top_earners_with_rating(
    fact: DataFrame,
    dim_employee: DataFrame,
    dim_department: DataFrame,
    department: str = "Sales",
    limit: int = 5,
) -> DataFrame:
    """Best paid current employees of a department with their review rating."""
    members = dim_department.filter(F.col("department_name") == department).select("department_id")
    staff = current(dim_employee).join(members, "department_id").select(
        "emp_key", "employee_id", "full_name", "monthly_income"
    )
    ratings = fact.select("emp_key", "review_fact_id", "performance_rating")
    return (
        staff.join(ratings, "emp_key")
        .orderBy(F.desc_nulls_last("monthly_income"), "emp_key", "review_fact_id")
        .limit(limit)
        .select("employee_id", "full_name", "monthly_income", "performance_rating")
    )


# --- directory --------------------------------------------------------------------------


def employee_directory(employees: DataFrame, departments: DataFrame, jobs: DataFrame) -> DataFrame:
    return (
        employees.join(departments.select("department_id", "department_name"), "department_id")
        .join(jobs.select("job_id", "job_role"), "job_id")
        .select(
            "employee_id", "first_name", "last_name",
            labels.full_name("first_name", "last_name").alias("full_name"),
            "email", "monthly_income", "attrition", "hire_date", "department_name", "job_role",
        )
    )


def employee_by_id(directory: DataFrame, employee_id: int) -> DataFrame:
    return directory.filter(F.col("employee_id") == employee_id)


def employees_in_department(
    directory: DataFrame, department_name: str | None = None, collation: str | None = None
) -> DataFrame:
    """Members of a department, or everyone. Names compare byte by byte unless a collation is
    given, such as UTF8_LCASE or UNICODE_CI_AI."""
    if not department_name:
        return directory
    name = F.col("department_name")
    return directory.filter((F.collate(name, collation) if collation else name) == department_name)


def list_departments(departments: DataFrame) -> DataFrame:
    return departments.select("department_id", "department_name")


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "job_role", "job_level")


def lookup_labels(departments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Options of the two pickers."""
    department = labels.department_option(F.col("department_id"), F.col("department_name"))
    job = labels.job_option(F.col("job_id"), F.col("job_role"), F.col("job_level"))
    return departments.select(
        F.lit("department").alias("kind"), F.col("department_id").cast("long").alias("id"),
        department.alias("label"),
    ).unionByName(
        jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), job.alias("label"))
    )


# --- bundle -----------------------------------------------------------------------------


class Dashboard:
    """All dashboard frames over one star schema, from one scan of each of its tables.

    The scans leave slim copies, of which the frames are made: indicators that share a table come from
    one aggregation with grouping sets, the two lists of people from one join of the copies.
    """

    def __init__(self, tables: dict[str, DataFrame], top_n: int = 5, threshold: int = 2, limit: int = 50):
        self.departments = materialise(
            tables["dim_department"].select("dept_key", "department_id", "department_name"), "dashboard-departments"
        )
        staff = current(tables["dim_employee"]).select(
            "emp_key", "employee_id", "full_name", "job_role", "department_id", "attrition", "monthly_income"
        )
        self.staff = materialise(staff, "dashboard-staff")
        dates = tables["dim_date"].select(
            F.col("date_key").alias("review_date_key"), "year", F.col("full_date").alias("review_date")
        )
        fact = tables["fact_performance_reviews"].select(
            "review_fact_id", "emp_key", "dept_key", "review_date_key", "performance_rating", "job_satisfaction",
            "percent_salary_hike", "monthly_income",
        )
        self.reviews = materialise(fact.join(dates, "review_date_key", "left"), "dashboard-reviews")
        by_staff, by_review = self._staff_groups(), self._review_groups()
        people = self.reviews.join(self.staff.drop("monthly_income", "department_id", "attrition"), "emp_key")
        people = people.join(self.departments.drop("department_id"), "dept_key")
        self.frames = {
            "combined_kpis": _kpis_of(by_staff.filter("kind = 'all'"), by_review.filter("kind = 'all'")),
            "top_performers_by_department": ranked_performers(people, top_n),
            "attrition_rate_by_department": by_staff.filter("kind = 'department'").select(
                "department_name", "attrition_rate_pct"
            ),
            "avg_income_by_role": by_staff.filter("kind = 'role'")
            .select("job_role", "avg_income")
            .orderBy(F.desc_nulls_last("avg_income"), "job_role"),
            "attrition_risk_flags": least_satisfied(
                people.filter((F.col("job_satisfaction") <= threshold) & F.col("review_date").isNotNull()), limit
            ),
            "yearly_trends": by_review.filter("kind = 'year'")
            .select("year", "review_count", "avg_rating", "avg_satisfaction", "avg_income", "avg_salary_hike")
            .orderBy("year"),
        }

    def _staff_groups(self) -> DataFrame:
        """Headcount, pay and attrition over all current versions, by department and by role."""
        names = self.departments.select("department_id", "department_name", F.lit(True).alias("named"))
        keys = [F.col("department_name"), F.col("job_role")]
        leaves = F.count_if(F.col("attrition") == "Yes").cast("decimal(20,0)")
        groups = (
            self.staff.join(names, "department_id", "left")
            .groupingSets([[], [keys[0]], [keys[1]]], *keys)
            .agg(
                _kind(F.grouping("department_name"), F.grouping("job_role"), "department", "role"),
                F.count(F.lit(1)).alias("active_count"),
                F.count_if(F.col("named")).alias("named"),
                exact_avg("monthly_income").alias("avg_income"),
                F.round(F.lit(100) * leaves / F.count(F.lit(1)), 2).cast("double").alias("attrition_rate_pct"),
            )
        )
        return materialise(groups.filter("kind <> 'department' OR named > 0"), "dashboard-staff-groups")

    def _review_groups(self) -> DataFrame:
        """Scores over all reviews and by year."""
        groups = self.reviews.groupingSets([[], [F.col("year")]], F.col("year")).agg(
            F.when(F.grouping("year") == 1, "all").otherwise("year").alias("kind"),
            F.count(F.lit(1)).alias("review_count"),
            exact_avg("performance_rating").alias("avg_rating"),
            exact_avg("job_satisfaction").alias("avg_satisfaction"),
            exact_avg("monthly_income").alias("avg_income"),
            exact_avg("percent_salary_hike").alias("avg_salary_hike"),
        )
        return materialise(groups.filter("kind = 'all' OR year IS NOT NULL"), "dashboard-review-groups")

    def bundle(self) -> DataFrame:
        """All frames as one: (metric, key, value)."""
        frames = self.frames

        def rows(name: str, key: Column, value: str) -> DataFrame:
            return frames[name].select(
                F.lit(name).alias("metric"), key.alias("key"), F.col(value).cast("double").alias("value")
            )

        kpis = frames["combined_kpis"]
        kpis = kpis.select(*[F.col(c).cast("double").alias(c) for c in kpis.columns])
        parts = [
            kpis.unpivot([], kpis.columns, "key", "value").select(
                F.lit("combined_kpis").alias("metric"), "key", "value"
            ),
            rows(
                "top_performers_by_department",
                F.concat_ws(" #", "department_name", "rnk"),
                "percent_salary_hike",
            ),
            rows("attrition_rate_by_department", F.col("department_name"), "attrition_rate_pct"),
            rows("avg_income_by_role", F.col("job_role"), "avg_income"),
            rows("yearly_trends", F.col("year").cast("string"), "avg_rating"),
        ]
        flags = frames["attrition_risk_flags"].groupBy("department_name").count()
        parts.append(
            flags.select(
                F.lit("attrition_risk_flags").alias("metric"),
                F.col("department_name").alias("key"),
                F.col("count").cast("double").alias("value"),
            )
        )
        return reduce(DataFrame.unionByName, parts)


def _kind(first: Column, second: Column, if_first: str, if_second: str) -> Column:
    """Which grouping set a row belongs to: all rows, the first key or the second."""
    both = (first == 1) & (second == 1)
    return F.when(both, "all").when(first == 0, if_first).otherwise(if_second).alias("kind")


class CachedBundle:
    """The bundle of a store's star schema, kept until it is too old or the store has changed.

    Changes made through the same store are seen at once, those of other sessions when the bundle
    is too old.
    """

    def __init__(self, store: Tables, seconds: float = CACHE_SECONDS, clock=time.monotonic):
        self.store, self.seconds, self._clock = store, seconds, clock
        self._kept: tuple[float, int, DataFrame] | None = None

    def rows(self) -> DataFrame:
        now = self._clock()
        if not self._kept or now - self._kept[0] >= self.seconds or self._kept[1] != self.store.changes:
            found = Dashboard(self.store.tables(LAYERS["OLAP"])).bundle()
            self._kept = (now, self.store.changes, materialise(found, "dashboard-bundle"))
        return self._kept[2]
