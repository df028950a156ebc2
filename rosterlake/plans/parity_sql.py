"""The same results in DuckDB SQL, from the driver's tables, as plain window-and-join queries.

Each statement is written against named steps (staging, operational tables, star schema, feeds);
only the steps it needs are put in front of it.
"""

from __future__ import annotations

import re

from rosterlake.functions import rules
from rosterlake.plans import registry
from rosterlake.schemas import STAGING_WITH_KEY, TABLES

_OPEN = "DATE '9999-12-31'"


def _pick(expr: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {cases} END"


def _score(null_every: int) -> str:
    return f"CASE WHEN o_orderkey % {null_every} <> 0 THEN CAST(o_orderkey % 4 + 1 AS INTEGER) END"


def _avg(x: str) -> str:
    """Exact AVG to two digits, half up, for non-negative x."""
    cents = f"CAST({x} * 100 AS BIGINT)"
    return f"((sum({cents}) * 2 + count({x})) // nullif(2 * count({x}), 0)) / 100.0"


_INTS = {
    "employee_id": "o_custkey + 10001",
    "Age": "18 + o_custkey % 50",
    "DailyRate": "o_orderkey % 1400 + 100",
    "DistanceFromHome": "o_custkey % 29 + 1",
    "Education": "o_custkey % 5 + 1",
    "HourlyRate": "o_orderkey % 70 + 30",
    "JobLevel": "substr(o_orderpriority, 1, 1)",
    "MonthlyRate": "o_orderkey % 25000 + 2000",
    "NumCompaniesWorked": "o_custkey % 10",
    "StockOptionLevel": "o_custkey % 4",
    "TotalWorkingYears": "o_custkey % 40",
    "TrainingTimesLastYear": "o_orderkey % 7",
    "WorkLifeBalance": "o_orderkey % 4 + 1",
    "YearsAtCompany": "o_custkey % 20",
    "YearsInCurrentRole": "o_custkey % 15",
    "YearsSinceLastPromotion": "o_custkey % 10",
    "YearsWithCurrManager": "o_custkey % 12",
}
_OTHERS = {
    "Attrition": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END",
    "BusinessTravel": _pick("o_orderkey % 3", "Travel_Rarely", "Travel_Frequently", "Non-Travel"),
    "Department": "r_name",
    "EducationField": "'Field ' || CAST(o_custkey % 6 AS VARCHAR)",
    "EnvironmentSatisfaction": _score(19),
    "Gender": _pick("o_custkey % 2", "Female", "Male"),
    "JobInvolvement": _score(29),
    "JobRole": "'  ' || c_mktsegment || ' '",
    "JobSatisfaction": _score(11),
    "MaritalStatus": _pick("o_custkey % 3", "Single", "Married", "Divorced"),
    "MonthlyIncome": "CAST(o_totalprice AS DECIMAL(10,2))",
    "OverTime": _pick("o_orderkey % 2", "No", "Yes"),
    "PercentSalaryHike": "CAST(11 + o_orderkey % 15 AS DECIMAL(5,2))",
    "PerformanceRating": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 4 ELSE 3 END",
    "RelationshipSatisfaction": _score(31),
    "first_name": "' ' || substr(c_name, 1, 8)",
    "last_name": "substr(c_name, 10) || '  '",
    "email": "' ' || c_name || '@Company.COM'",
    "phone_number": "'555-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')",
    "department_id": "CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE r_regionkey + 1 END",
    "hire_date": "CAST(min(o_orderdate) OVER (PARTITION BY o_custkey) AS DATE)",
    "effective_start_date": "CAST(o_orderdate AS DATE)",
    "effective_end_date": f"coalesce(CAST(lead(o_orderdate) OVER versions AS DATE), {_OPEN})",
    "is_current": "CASE WHEN lead(o_orderkey) OVER versions IS NULL THEN 1 ELSE 0 END",
    "change_reason": "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'Promotion & Salary Hike' "
    "WHEN o_orderkey % 4 = 1 THEN 'Department Transfer' ELSE 'Annual Merit Increase' END",
    "src_key": "o_orderkey",
}


def _staging() -> str:
    parts = []
    for name in STAGING_WITH_KEY.fieldNames():
        expr = f"CAST({_INTS[name]} AS INTEGER)" if name in _INTS else _OTHERS[name]
        parts.append(f'{expr} AS "{name}"')
    return (
        "SELECT " + ", ".join(parts) + " FROM orders JOIN customer ON o_custkey = c_custkey "
        "JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = "
        "(n_regionkey + CASE WHEN o_orderkey % 10 < 3 THEN 1 ELSE 0 END) % 5 "
        "WINDOW versions AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
    )


_CLEAN_DIM = """trim(first_name) || ' ' || trim(last_name) AS full_name, lower(trim(email)) AS email,
  trim("JobRole") AS job_role, "JobLevel" AS job_level, coalesce("MonthlyIncome", 0) AS monthly_income,
  department_id, hire_date, coalesce(change_reason, 'Initial Onboarding') AS change_reason,
  coalesce("Attrition", 'No') AS attrition"""
_CLEAN_SCORES = """coalesce("EnvironmentSatisfaction", 3) AS environment_satisfaction,
  coalesce("JobSatisfaction", 3) AS job_satisfaction,
  coalesce("RelationshipSatisfaction", 3) AS relationship_satisfaction,
  coalesce("JobInvolvement", 3) AS job_involvement, coalesce("PerformanceRating", 3) AS performance_rating,
  coalesce("PercentSalaryHike", 0) AS percent_salary_hike"""
_RAW_SCORES = """"EnvironmentSatisfaction" AS environment_satisfaction, "JobSatisfaction" AS job_satisfaction,
  "RelationshipSatisfaction" AS relationship_satisfaction, "JobInvolvement" AS job_involvement,
  "PerformanceRating" AS performance_rating, "PercentSalaryHike" AS percent_salary_hike"""
_SCORES = (
    "environment_satisfaction, job_satisfaction, relationship_satisfaction, job_involvement, "
    "performance_rating"
)
_NAME_CASE = """CASE department_id WHEN 1 THEN 'Sales' WHEN 2 THEN 'Research & Development'
  WHEN 3 THEN 'Human Resources' {rest} END"""
_PLACE_CASE = """CASE department_id WHEN 1 THEN 'New York - Tech Hub' WHEN 2 THEN 'San Francisco - R&D Center'
  WHEN 3 THEN 'Chicago - HQ' {rest} END"""
_EMPLOYEE_COPY = """phone_number, "Age" AS age, "Gender" AS gender, "MaritalStatus" AS marital_status,
  "Education" AS education, "EducationField" AS education_field, hire_date, department_id, job_id"""
_DATE_COLUMNS = """CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date,
  CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
  monthname(d) AS month_name, CAST(day(d) AS INTEGER) AS day_of_month, dayname(d) AS day_of_week"""


def _calendar(first: str) -> str:
    return (
        f"SELECT {_DATE_COLUMNS} FROM (SELECT unnest(generate_series({first}, "
        "TIMESTAMP '2035-12-31', INTERVAL 1 DAY)) AS d)"
    )


def _facts_per_day(first: str, last: str) -> str:
    return (
        f"SELECT c.* REPLACE (CAST(c.full_date AS VARCHAR) AS full_date), coalesce(n, 0) AS n_facts FROM "
        f"(SELECT {_DATE_COLUMNS} FROM (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', "
        "INTERVAL 1 DAY)) AS d)) c LEFT JOIN (SELECT review_date_key, count(*) AS n FROM fact_performance_reviews "
        "GROUP BY review_date_key) f ON f.review_date_key = c.date_key"
    )


def _first_of_year(expr: str) -> str:
    return f"(SELECT CAST(date_trunc('year', {expr}) AS TIMESTAMP) FROM staging)"


def _name_errors(column: str, label: str) -> str:
    t = f"regexp_replace(coalesce({column}, ''), '^\\s+|\\s+$', '', 'g')"
    return f"""CASE WHEN {t} = '' THEN ['**{label}** is required.'] ELSE list_filter([
      CASE WHEN regexp_matches({t}, '\\d') THEN '**{label}** cannot contain numbers or digits.' END,
      CASE WHEN NOT regexp_full_match({t}, '[A-Za-z\\s\\-'']{{2,50}}') THEN '**{label}** can only contain letters, spaces, hyphens, and apostrophes (2–50 characters).' END,
      CASE WHEN len(list_distinct(string_split(replace(lower({t}), ' ', ''), ''))) <= 1 THEN '**{label}** cannot consist of a single repeated character.' END
    ], lambda m: m IS NOT NULL) END"""


def _found(*pairs: tuple[str, str]) -> str:
    cases = ", ".join(
        f"CASE WHEN {c} THEN {m if m.startswith('(') else _quoted(m)} END" for c, m in pairs
    )
    return f"list_filter([{cases}], lambda m: m IS NOT NULL)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EMAIL = "regexp_replace(coalesce(email, ''), '^\\s+|\\s+$', '', 'g')"
_PHONE = "regexp_replace(coalesce(phone_number, ''), '^\\s+|\\s+$', '', 'g')"
_EMAIL_ERRORS = f"""list_filter([CASE WHEN {_EMAIL} = '' THEN {_quoted(rules.EMAIL_REQUIRED)}
  WHEN contains({_EMAIL}, ' ') THEN {_quoted(rules.EMAIL_SPACES)}
  WHEN NOT regexp_full_match({_EMAIL}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')
  THEN {_quoted(rules.EMAIL_INVALID)} END], lambda m: m IS NOT NULL)"""
_PHONE_ERRORS = _found(
    (f"{_PHONE} <> '' AND len(regexp_replace({_PHONE}, '[^0-9]', '', 'g')) < 7", rules.PHONE_DIGITS),
    (f"{_PHONE} <> '' AND regexp_matches({_PHONE}, '\\pL')", rules.PHONE_LETTERS),
    (
        f"{_PHONE} <> '' AND NOT regexp_full_match({_PHONE}, '\\+?[\\d\\s\\-\\(\\)\\.]{{7,20}}')",
        rules.PHONE_FORMAT,
    ),
)
_LATE_ERRORS = _found(
    ("age < 18 OR age > 75", rules.AGE),
    ("hire_date > DATE '2026-08-15'", rules.HIRE_FUTURE),
    (
        "year(hire_date) < 2026 - age + 16",
        "('Hire date (' || year(hire_date) || ') implies employee was hired before age 16 (Age: ' || age || ').')",
    ),
    (
        "total_working_years > greatest(0, age - 16)",
        "('Total working years (' || total_working_years || ') exceeds maximum possible career span for age ' "
        "|| age || ' (max allowed: ' || greatest(0, age - 16) || ' years).')",
    ),
    ("monthly_income < 1000 OR monthly_income > 500000", rules.INCOME),
    ("manager_id <= 0", rules.MANAGER),
)
_ONBOARDING_ERRORS = (
    f"list_concat(list_concat({_name_errors('first_name', 'First Name')}, "
    f"{_name_errors('last_name', 'Last Name')}), list_concat(list_concat({_EMAIL_ERRORS}, "
    f"{_PHONE_ERRORS}), {_LATE_ERRORS}))"
)
_ASSIGNMENT_ERRORS = _found(
    ("employee_id < 10001", rules.EMPLOYEE_ID),
    ("project_id < 1", rules.PROJECT_ID),
    (
        "trim(role_in_project) = '' OR regexp_matches(role_in_project, '\\d') OR NOT "
        "regexp_full_match(trim(role_in_project), '[A-Za-z\\s\\-\\._'']{2,50}')",
        rules.ROLE,
    ),
    ("allocation_percentage < 10 OR allocation_percentage > 100", rules.ALLOCATION),
)

_CANDIDATE = """s_suppkey AS candidate_id,
  CASE WHEN s_suppkey % 4 = 3 THEN s_name ELSE translate(substr(s_name, 10), '0123456789', 'abcdefghij') END AS first_name,
  CASE WHEN s_suppkey % 10 = 9 THEN ' ' ELSE 'O''Neil-' || translate(CAST(s_nationkey AS VARCHAR), '0123456789', 'klmnopqrst') END AS last_name,
  CASE s_suppkey % 7 WHEN 0 THEN 'no at sign' WHEN 1 THEN 'bad@host'
    ELSE lower(substr(s_name, 1, 8)) || CAST(s_suppkey AS VARCHAR) || '@company.com' END AS email,
  CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '555-01' WHEN 2 THEN '+1 (555) 010-9999 x2'
    ELSE '555-0199-' || CAST(s_suppkey AS VARCHAR) END AS phone_number,
  CAST(16 + s_suppkey % 64 AS INTEGER) AS age, DATE '2020-01-01' AS hire_date,
  CAST(s_suppkey % 45 AS INTEGER) AS total_working_years, CAST(s_acctbal AS DECIMAL(10,2)) AS monthly_income,
  CAST(s_suppkey % 8 AS INTEGER) AS manager_id, CAST(s_suppkey % 5 + 1 AS INTEGER) AS department_id,
  s_suppkey % 27 + 1 AS job_id"""

_DIM_COLUMNS = ", ".join(TABLES["dim_employee"].columns)
_EMPLOYEE_COLUMNS = ", ".join(TABLES["employees"].columns)

# Every step: name -> SELECT.
_STEPS = {
    "staging": _staging(),
    "deduped": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY employee_id, effective_start_date ORDER BY is_current DESC, src_key DESC) AS rn
        FROM staging WHERE employee_id IS NOT NULL AND effective_start_date IS NOT NULL) WHERE rn = 1""",
    "departments": f"""SELECT department_id, {_NAME_CASE.format(rest='ELSE coalesce("Department", ' + "'General')")} AS department_name,
        {_PLACE_CASE.format(rest="ELSE 'Headquarters'")} AS location FROM (SELECT *, row_number() OVER (
        PARTITION BY department_id ORDER BY src_key) AS rn FROM staging WHERE department_id IS NOT NULL) WHERE rn = 1""",
    "jobs": """SELECT row_number() OVER (ORDER BY job_role, job_level) AS job_id, job_role, job_level FROM (
        SELECT DISTINCT trim("JobRole") AS job_role, "JobLevel" AS job_level FROM staging
        WHERE "JobRole" IS NOT NULL AND "JobLevel" IS NOT NULL)""",
    "unmanaged": f"""SELECT employee_id, trim(first_name) AS first_name, trim(last_name) AS last_name,
        lower(trim(email)) AS email, {_EMPLOYEE_COPY}, coalesce("MonthlyIncome", 0) AS monthly_income,
        coalesce("Attrition", 'No') AS attrition, "DistanceFromHome" AS distance_from_home,
        "TotalWorkingYears" AS total_working_years FROM (SELECT s.*, j.job_id, row_number() OVER (
        PARTITION BY s.employee_id ORDER BY is_current DESC, effective_start_date DESC, src_key DESC) AS rn
        FROM staging s JOIN jobs j ON trim(s."JobRole") = j.job_role AND s."JobLevel" = j.job_level
        JOIN departments d ON s.department_id = d.department_id WHERE s.is_current = 1) WHERE rn = 1""",
    "managers": """SELECT department_id, min(employee_id) AS manager_id FROM unmanaged
        WHERE employee_id % 5 = 0 GROUP BY department_id""",
    "employees": """SELECT u.*, CASE WHEN u.employee_id % 5 <> 0 THEN m.manager_id END AS manager_id
        FROM unmanaged u LEFT JOIN managers m ON u.department_id = m.department_id""",
    "projects": """SELECT p.project_id, project_name, p.department_id, start_date, CAST(NULL AS DATE) AS end_date, budget FROM (
        SELECT CAST(project_id AS BIGINT) AS project_id, project_name, department_id, CAST(start_date AS DATE) AS start_date,
        CAST(budget AS DECIMAL(12,2)) AS budget FROM (VALUES
        (1, 'Cloud Infrastructure Modernization', 2, '2024-01-15', 500000.00),
        (2, 'Enterprise AI Assistant Upgrade', 2, '2024-06-01', 350000.00),
        (3, 'Global Sales ERP Integration', 1, '2025-02-10', 450000.00),
        (4, 'HR Payroll Automation & Analytics', 3, '2025-09-01', 200000.00),
        (5, 'Customer Portal 2.0 Redesign', 1, '2026-01-05', 150000.00)
        ) AS v(project_id, project_name, department_id, start_date, budget)) p
        WHERE p.department_id IN (SELECT department_id FROM departments)""",
    "project_assignments": """SELECT row_number() OVER (ORDER BY employee_id) AS assignment_id, employee_id, project_id,
        'Contributor' AS role_in_project, 100 AS allocation_percentage, hire_date AS assigned_date FROM (
        SELECT e.employee_id, p.project_id, e.hire_date, row_number() OVER (PARTITION BY e.employee_id
        ORDER BY p.start_date DESC, p.project_id DESC) AS rn FROM employees e JOIN projects p
        ON e.department_id = p.department_id WHERE e.employee_id % 3 = 0) WHERE rn = 1""",
    "assignments_v1": """SELECT row_number() OVER (ORDER BY e.employee_id, p.project_id) AS assignment_id, e.employee_id,
        p.project_id, 'Contributor' AS role_in_project, 100 AS allocation_percentage, e.hire_date AS assigned_date
        FROM employees e JOIN projects p ON e.department_id = p.department_id WHERE e.employee_id % 3 = 0""",
    "performance_reviews": f"""SELECT row_number() OVER (ORDER BY employee_id, effective_start_date) AS review_id, employee_id,
        effective_start_date AS review_date, {_CLEAN_SCORES} FROM (SELECT s.*, row_number() OVER (
        PARTITION BY s.employee_id, effective_start_date ORDER BY is_current DESC, src_key DESC) AS rn
        FROM staging s JOIN employees e ON s.employee_id = e.employee_id) WHERE rn = 1""",
    "dim_department": """SELECT row_number() OVER (ORDER BY department_id) AS dept_key, department_id, department_name,
        location FROM departments""",
    "dim_project": """SELECT CAST(1 AS BIGINT) AS project_key, CAST(0 AS BIGINT) AS project_id, 'Unassigned / Operational Task' AS project_name,
        DATE '2010-01-01' AS start_date, DATE '9999-12-31' AS end_date, CAST(0 AS DECIMAL(12,2)) AS budget
        UNION ALL SELECT 1 + row_number() OVER (ORDER BY project_id), project_id, project_name, start_date, end_date, budget FROM projects""",
    "dim_date": _calendar("TIMESTAMP '1995-01-01'"),
    "cleaned": f"SELECT employee_id, effective_start_date, {_CLEAN_DIM} FROM deduped",
    "dim_employee": f"""SELECT row_number() OVER (ORDER BY employee_id, effective_start_date) AS emp_key, employee_id, full_name,
        email, job_role, job_level, monthly_income, department_id, hire_date, effective_start_date,
        coalesce(lead(effective_start_date) OVER w, {_OPEN}) AS effective_end_date,
        CASE WHEN lead(effective_start_date) OVER w IS NULL THEN 1 ELSE 0 END AS is_current, change_reason, attrition
        FROM cleaned WINDOW w AS (PARTITION BY employee_id ORDER BY effective_start_date)""",
    "dim_employee_v1": """SELECT row_number() OVER (ORDER BY employee_id, effective_start_date, src_key) AS emp_key, employee_id,
        first_name || ' ' || last_name AS full_name, email, "JobRole" AS job_role, "JobLevel" AS job_level,
        "MonthlyIncome" AS monthly_income, department_id, hire_date, effective_start_date, effective_end_date,
        is_current, change_reason, "Attrition" AS attrition FROM staging""",
    "primary_projects": """SELECT employee_id, project_key FROM (SELECT pa.employee_id, p.project_key, row_number() OVER (
        PARTITION BY pa.employee_id ORDER BY pa.assigned_date DESC, pa.assignment_id DESC) AS rn
        FROM project_assignments pa JOIN dim_project p ON pa.project_id = p.project_id) WHERE rn = 1""",
    "fact_performance_reviews": f"""SELECT row_number() OVER (ORDER BY emp_key) AS review_fact_id, emp_key, dept_key, project_key,
        review_date_key, {_SCORES}, percent_salary_hike, monthly_income FROM (
        SELECT e.emp_key, d.dept_key, coalesce(pp.project_key, 1) AS project_key, dt.date_key AS review_date_key,
        {_CLEAN_SCORES}, coalesce(s."MonthlyIncome", 0) AS monthly_income, row_number() OVER (
        PARTITION BY s.employee_id, s.effective_start_date ORDER BY e.emp_key DESC) AS rn
        FROM deduped s JOIN dim_employee e ON s.employee_id = e.employee_id AND s.effective_start_date = e.effective_start_date
        JOIN dim_department d ON s.department_id = d.department_id
        JOIN dim_date dt ON CAST(strftime(s.effective_start_date, '%Y%m%d') AS INTEGER) = dt.date_key
        LEFT JOIN primary_projects pp ON s.employee_id = pp.employee_id) WHERE rn = 1""",
    "role_changes": """SELECT event_id AS change_id, ts, CAST(ts AS DATE) AS change_date,
        CAST(CASE WHEN event_id % 50 = 0 THEN 9000000 + event_id ELSE user_id + 10001 END AS INTEGER) AS employee_id,
        CAST(event_id % 5 + 1 AS INTEGER) AS new_department_id, event_id % 25 + 1 AS new_job_id,
        CAST(1000 + CAST(value AS DECIMAL(10,2)) AS DECIMAL(10,2)) AS new_monthly_income
        FROM events WHERE event_type = 'purchase'""",
    "described": """SELECT c.change_id, c.ts, c.change_date, c.employee_id, c.new_department_id, c.new_job_id, c.new_monthly_income,
        coalesce(j.job_role, 'Updated Role') AS job_role, coalesce(j.job_level, 1) AS job_level,
        coalesce(e.attrition, 'No') AS attrition FROM role_changes c LEFT JOIN jobs j ON c.new_job_id = j.job_id
        LEFT JOIN employees e ON c.employee_id = e.employee_id""",
    "valid_changes": """SELECT * FROM described WHERE new_monthly_income BETWEEN 1000 AND 500000 AND employee_id >= 10001
        AND employee_id IN (SELECT employee_id FROM employees)
        AND new_department_id IN (SELECT department_id FROM departments) AND new_job_id IN (SELECT job_id FROM jobs)""",
    "review_requests": """SELECT event_id AS request_id, ts, CAST(user_id + 10001 AS INTEGER) AS employee_id,
        CAST(ts AS DATE) AS review_date, CAST(event_id % 6 AS INTEGER) AS rating FROM events WHERE event_type = 'click'""",
    "assignment_requests": """SELECT event_id AS request_id, ts, CAST(user_id + 10001 AS INTEGER) AS employee_id,
        event_id % 6 AS project_id, CASE WHEN event_id % 9 = 0 THEN 'Lead 2' ELSE 'Contributor' END AS role_in_project,
        CAST(event_id % 12 * 10 AS INTEGER) AS allocation_percentage, CAST(ts AS DATE) AS assigned_date
        FROM events WHERE event_type = 'view'""",
    "raise_requests": """SELECT event_id AS request_id, ts, CAST(user_id + 10001 AS INTEGER) AS employee_id,
        event_id % 12 - 1 AS percent FROM events WHERE event_type = 'signup'""",
    "candidates": f"SELECT {_CANDIDATE} FROM supplier",
    "checked_candidates": f"SELECT candidate_id, {_ONBOARDING_ERRORS} AS errors FROM candidates",
    "hireable": """SELECT * REPLACE (CASE WHEN manager_id > 0 THEN manager_id + 10000 ELSE 0 END AS manager_id) FROM candidates""",
    "hires": f"""SELECT row_number() OVER (ORDER BY candidate_id) + (SELECT max(employee_id) FROM employees) AS employee_id, *
        FROM (SELECT * FROM hireable WHERE len({_ONBOARDING_ERRORS}) = 0
        AND department_id IN (SELECT department_id FROM departments) AND job_id IN (SELECT job_id FROM jobs)
        AND manager_id IN (SELECT employee_id FROM employees))""",
}


def _scd2(changes: str) -> dict[str, str]:
    """Steps that apply a set of described changes to the dimension."""
    return {
        "accepted": f"""SELECT c.*, row_number() OVER (ORDER BY c.ts, c.change_id) AS n,
            lead(c.change_date) OVER (PARTITION BY c.employee_id ORDER BY c.ts, c.change_id) AS next_date
            FROM {changes} c WHERE c.employee_id IN (SELECT employee_id FROM dim_employee WHERE is_current = 1)""",
        "changed_dim": f"""SELECT emp_key, d.employee_id, full_name, email, job_role, job_level, monthly_income, department_id,
            hire_date, effective_start_date,
            CASE WHEN is_current = 1 AND f.first_date IS NOT NULL THEN f.first_date ELSE effective_end_date END AS effective_end_date,
            CASE WHEN is_current = 1 AND f.first_date IS NOT NULL THEN 0 ELSE is_current END AS is_current,
            change_reason, attrition FROM dim_employee d LEFT JOIN (SELECT employee_id, min(change_date) AS first_date
            FROM accepted GROUP BY employee_id) f ON d.employee_id = f.employee_id
            UNION ALL SELECT (SELECT max(emp_key) FROM dim_employee) + a.n, a.employee_id, b.full_name, b.email, a.job_role,
            a.job_level, a.new_monthly_income, a.new_department_id, b.hire_date, a.change_date,
            coalesce(a.next_date, {_OPEN}), CASE WHEN a.next_date IS NULL THEN 1 ELSE 0 END,
            'Department/Role Update', a.attrition FROM accepted a
            JOIN (SELECT * FROM dim_employee WHERE is_current = 1) b ON a.employee_id = b.employee_id""",
    }


def _with_steps(body: str, extra: dict[str, str] | None = None) -> str:
    """The statement behind the steps it names, directly or through other steps."""
    steps = {**_STEPS, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in steps:
            if name in needed or name == own:
                continue
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                visit(steps[name], name)
                needed.append(name)

    visit(body)
    recursive = "RECURSIVE " if {"folded", "climbed"} & set(extra or ()) else ""
    if not needed:
        return body
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({steps[n]})" for n in needed) + "\n" + body


def _shown(table: str) -> str:
    """All columns of a declared table as the registry presents them."""

    def show(field) -> str:
        kind = field.dataType.simpleString()
        if kind.startswith("decimal"):
            return f'CAST("{field.name}" AS DOUBLE) AS "{field.name}"'
        if kind == "date":
            return f'CAST("{field.name}" AS VARCHAR) AS "{field.name}"'
        return f'"{field.name}"'

    schema = STAGING_WITH_KEY if table == "staging" else TABLES[table].schema
    return ", ".join(show(f) for f in schema.fields)


def _as(table: str, columns_of: str | None = None) -> str:
    return f"SELECT {_shown(columns_of or table)} FROM {table}"


_CURRENT = "(SELECT * FROM dim_employee WHERE is_current = 1)"
_RATES = f"""SELECT d.department_name, CAST(((20000 * count(*) FILTER (e.attrition = 'Yes') + count(*)) // (2 * count(*))) / 100.0 AS DOUBLE)
  AS attrition_rate_pct FROM {_CURRENT} e JOIN dim_department d ON e.department_id = d.department_id GROUP BY d.department_name"""
_TOP = f"""SELECT * FROM (SELECT d.department_name, e.full_name, e.employee_id, f.performance_rating,
  CAST(f.percent_salary_hike AS DOUBLE) AS percent_salary_hike, CAST(row_number() OVER (PARTITION BY d.department_name
  ORDER BY f.performance_rating DESC, f.percent_salary_hike DESC, f.monthly_income DESC, e.emp_key, f.review_fact_id) AS INTEGER) AS rnk
  FROM fact_performance_reviews f JOIN dim_department d ON f.dept_key = d.dept_key JOIN {_CURRENT} e ON f.emp_key = e.emp_key)
  WHERE rnk <= 5"""
_LABELLED = f"""SELECT '#' || rnk || ' ' || full_name || ' (' || department_name || ')' AS emp_label, percent_salary_hike,
  department_name, performance_rating FROM ({_TOP})"""
_TRENDS = f"""SELECT dt.year, count(*) AS review_count, {_avg('f.performance_rating')} AS avg_rating,
  {_avg('f.job_satisfaction')} AS avg_satisfaction, {_avg('f.monthly_income')} AS avg_income,
  {_avg('f.percent_salary_hike')} AS avg_salary_hike
  FROM fact_performance_reviews f JOIN dim_date dt ON f.review_date_key = dt.date_key GROUP BY dt.year"""
_KPIS = f"""SELECT (SELECT count(*) FROM {_CURRENT}) AS active_count,
  (SELECT coalesce({_avg('monthly_income')}, 0) FROM {_CURRENT}) AS avg_income,
  (SELECT coalesce({_avg('performance_rating')}, 0) FROM fact_performance_reviews) AS avg_rating,
  (SELECT coalesce({_avg('job_satisfaction')}, 0) FROM fact_performance_reviews) AS avg_satisfaction"""
_DIRECTORY = """SELECT e.employee_id, e.first_name, e.last_name, e.first_name || ' ' || e.last_name AS full_name, e.email,
  CAST(e.monthly_income AS DOUBLE) AS monthly_income, e.attrition, CAST(e.hire_date AS VARCHAR) AS hire_date,
  d.department_name, j.job_role FROM employees e JOIN departments d ON e.department_id = d.department_id
  JOIN jobs j ON e.job_id = j.job_id"""
_VALID_REVIEWS = """SELECT r.*, e.department_id FROM review_requests r JOIN employees e ON r.employee_id = e.employee_id
  WHERE r.rating BETWEEN 1 AND 4 AND r.employee_id >= 10001"""
_REPLICATED = """SELECT c_custkey, 10000 + row_number() OVER (ORDER BY copy, c_custkey) AS employee_id
  FROM customer, (SELECT unnest([0, 1, 2]) AS copy)
  QUALIFY row_number() OVER (ORDER BY copy, c_custkey) <= CAST(floor((SELECT count(*) FROM customer) * 2.5) AS BIGINT)"""
_V1_EMPLOYEE = f"""SELECT employee_id, first_name, last_name, email, {_EMPLOYEE_COPY},
  CAST(NULL AS INTEGER) AS manager_id, "MonthlyIncome" AS monthly_income, "Attrition" AS attrition,
  "DistanceFromHome" AS distance_from_home, "TotalWorkingYears" AS total_working_years
  FROM staging s JOIN jobs_v1 j ON s."JobRole" = j.job_role AND s."JobLevel" = j.job_level WHERE is_current = 1"""
_JOBS_V1 = """SELECT row_number() OVER (ORDER BY job_role, job_level) AS job_id, job_role, job_level FROM (
  SELECT DISTINCT "JobRole" AS job_role, "JobLevel" AS job_level FROM staging)"""
_HISTORY = """SELECT c_custkey, c_custkey * 37 % 19000 + 1000 AS income, c_custkey % 5 + 1 AS lvl, c_custkey % 3 + 1 AS dept,
  DATE '2026-08-15' - CAST(c_custkey % 3400 + 200 AS INTEGER) AS hired, c_custkey % 3400 + 200 AS tenure,
  c_custkey % 10 < 6 AS has_history FROM customer"""
_HISTORY_DATED = """SELECT *, hired + CAST(CASE WHEN tenure > 365
  THEN least(greatest(c_custkey % 916 + 180, 180), least(tenure - 30, 1095)) ELSE 180 END AS INTEGER) AS changed FROM history"""
_KEYWORDS = " ".join(
    f"WHEN regexp_matches(t, '\\b{w}\\b') THEN 'Forbidden keyword detected: ''{w}''.'"
    for w in (
        "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE",
        "EXEC", "CALL", "INTO OUTFILE",
    )
)
_TEXTS = """SELECT event_id AS query_id, CASE event_id % 12
  WHEN 0 THEN 'SELECT ' || event_id WHEN 1 THEN '  SELECT ' || event_id || ';  '
  WHEN 2 THEN 'select * from ' || event_type || '; drop table ' || event_type
  WHEN 3 THEN 'UPDATE ' || event_type || ' SET a=' || event_id
  WHEN 4 THEN 'WITH a AS (SELECT ' || event_id || ') SELECT * FROM a'
  WHEN 5 THEN 'SELECT ''please UPDATE ' || event_type || ''''
  WHEN 6 THEN 'SELECT updated_at FROM ' || event_type
  WHEN 7 THEN 'SELECT * FROM (SELECT * FROM ' || event_type || ' limit  5) x'
  WHEN 8 THEN 'SELECT * FROM ' || event_type || ' INTO OUTFILE ''' || event_id || ''''
  WHEN 9 THEN 'EXECUTE p' || event_id WHEN 10 THEN 'SELECT EXECUTE FROM ' || event_type || ';;' ELSE '' END AS sql_text FROM events"""
_AUDIT = f"""SELECT query_id, sql_text, reason, reason = 'Valid' AS valid, CASE WHEN reason <> 'Valid' THEN NULL
  WHEN regexp_matches(sql_text, '(?i)\\bLIMIT\\s+\\d+') THEN sql_text ELSE rtrim(sql_text, ';') || ' LIMIT 100;' END AS limited_sql
  FROM (SELECT query_id, sql_text, CASE
  WHEN contains(substr(t, 1, greatest(len(t) - 1, 0)), ';') THEN 'Multi-statement queries (containing semicolons) are prohibited.'
  WHEN NOT (starts_with(t, 'SELECT') OR starts_with(t, 'WITH')) THEN 'Query must strictly begin with SELECT or WITH.'
  {_KEYWORDS} ELSE 'Valid' END AS reason FROM (SELECT *, upper(regexp_replace(sql_text, '^\\s+|\\s+$', '', 'g')) AS t FROM texts))"""


def _integrity(dim: str) -> str:
    days = f"""SELECT DISTINCT employee_id, day FROM (SELECT employee_id, effective_start_date AS day FROM {dim}
        WHERE effective_start_date <= effective_end_date UNION ALL SELECT employee_id, effective_end_date FROM {dim}
        WHERE effective_start_date <= effective_end_date) WHERE day < {_OPEN}"""
    in_force = f"""SELECT b.employee_id, b.day, count(v.employee_id) AS versions FROM ({days}) b LEFT JOIN {dim} v
        ON v.employee_id = b.employee_id AND v.effective_start_date <= b.day AND b.day < v.effective_end_date GROUP BY 1, 2"""
    currents = f"SELECT employee_id, count(*) FILTER (is_current = 1) AS n FROM {dim} GROUP BY employee_id"
    checks = {
        "no_current": f"({currents}) WHERE n = 0",
        "multiple_current": f"({currents}) WHERE n > 1",
        "open_end_not_current": f"{dim} WHERE (effective_end_date = {_OPEN}) <> (is_current = 1)",
        "negative_length": f"{dim} WHERE effective_start_date > effective_end_date",
        "zero_length": f"{dim} WHERE effective_start_date = effective_end_date",
        "gap": f"({in_force}) WHERE versions < 1",
        "overlap": f"({in_force}) WHERE versions > 1",
    }
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, count(*) AS violations FROM {source}" for kind, source in checks.items()
    )


def _fk() -> str:
    checks = [
        (name, column, parent, key)
        for name, table in TABLES.items()
        for column, parent, key in table.references
    ]
    feeds = [
        ("role_changes", "role_changes", "employee_id", "employees", "employee_id"),
        ("assignment_requests", "assignment_requests", "project_id", "projects", "project_id"),
        ("onboarding", "candidates", "manager_id", "employees", "employee_id"),
    ]
    rows = [(n, n, c, p, k) for n, c, p, k in checks] + feeds
    return " UNION ALL ".join(
        f"SELECT '{label}.{c}->{p}' AS relation, count(*) AS violations FROM {n} "
        f"WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p})"
        for label, n, c, p, k in rows
    )


def _unique() -> str:
    keys = [(n, n, k) for n, t in TABLES.items() for k in (t.primary_key, *t.unique)]
    keys.append(("staging_employees", "staging", ("employee_id", "effective_start_date")))
    return " UNION ALL ".join(
        f"SELECT '{label}({','.join(k)})' AS unique_key, count(*) AS violations FROM "
        f"(SELECT {', '.join(k)} FROM {n} GROUP BY ALL HAVING count(*) > 1)"
        for label, n, k in keys
    )


def _nulls() -> str:
    columns = [(n, n, c) for n, t in TABLES.items() for c in t.required]
    columns += [("staging_employees", "staging", c) for c in ("employee_id", "department_id", "hire_date")]
    return " UNION ALL ".join(
        f"SELECT '{label}.{c}' AS required_column, count(*) AS violations FROM {n} WHERE {c} IS NULL"
        for label, n, c in columns
    )


_RAISES = {
    "raises": """SELECT r.employee_id, r.percent, row_number() OVER (PARTITION BY r.employee_id ORDER BY ts, request_id) AS n
        FROM raise_requests r JOIN employees e ON r.employee_id = e.employee_id WHERE r.percent > 0""",
    "folded": """SELECT employee_id, CAST(0 AS BIGINT) AS n, CAST(monthly_income * 100 AS BIGINT) AS cents FROM employees
        UNION ALL SELECT f.employee_id, r.n, CASE
        WHEN (f.cents * (100 + r.percent)) % 100 > 50
          OR ((f.cents * (100 + r.percent)) % 100 = 50 AND (f.cents * (100 + r.percent)) // 100 % 2 = 1)
        THEN (f.cents * (100 + r.percent)) // 100 + 1 ELSE (f.cents * (100 + r.percent)) // 100 END
        FROM folded f JOIN raises r ON r.employee_id = f.employee_id AND r.n = f.n + 1""",
}
# One income at a time, in cents; 100 % are 100,000 points.
_RAISED = "(c.cents * (100000 + a.points))"
_WANTED = f"""({_RAISED} // 100000 + CASE WHEN {_RAISED} % 100000 > 50000
    OR ({_RAISED} % 100000 = 50000 AND {_RAISED} // 100000 % 2 = 1) THEN 1 ELSE 0 END)"""
_RAISES_OF_ONE = {
    "asked": """SELECT event_id AS request_id, ts, CASE WHEN event_id % 50 <> 49 THEN event_id % 7 END AS points FROM events""",
    "numbered": """SELECT request_id, points, row_number() OVER (ORDER BY ts, request_id) AS n FROM asked WHERE points > 0""",
    "climbed": f"""SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS request_id, CAST(monthly_income * 100 AS HUGEINT) AS cents, FALSE AS beyond
        FROM employees WHERE employee_id = 10101
        UNION ALL SELECT a.n, a.request_id, CASE WHEN {_WANTED} > 9999999999 THEN c.cents ELSE {_WANTED} END, {_WANTED} > 9999999999
        FROM climbed c JOIN numbered a ON a.n = c.n + 1""",
}
_COUNTS = """SELECT 'active_oltp_employees' AS check_name, count(*) AS n FROM employees
            UNION ALL SELECT 'total_olap_dim_employees', count(*) FROM dim_employee
            UNION ALL SELECT 'current_dim_employees', count(*) FROM dim_employee WHERE is_current = 1
            UNION ALL SELECT 'expired_dim_employees', count(*) FROM dim_employee WHERE is_current = 0
            UNION ALL SELECT 'total_performance_facts', count(*) FROM fact_performance_reviews
            UNION ALL SELECT 'versions_without_fact', count(*) FROM dim_employee
              WHERE emp_key NOT IN (SELECT emp_key FROM fact_performance_reviews)"""
_LATE = {
    "late": """SELECT r.* REPLACE (CASE WHEN change_id % 40 <> 7 THEN CASE WHEN change_id % 3 = 1
        THEN change_date - 15000 ELSE change_date END END AS change_date,
        CASE WHEN change_id % 3 = 1 THEN ts - INTERVAL 15000 DAY ELSE ts END AS ts) FROM described r""",
    "newest": """SELECT employee_id, arg_max(effective_start_date, emp_key) AS started FROM dim_employee
        WHERE is_current = 1 GROUP BY employee_id""",
    "judged": """SELECT l.*, CASE WHEN started IS NULL THEN 'no current version of this employee'
        WHEN change_date IS NULL THEN 'change date is missing'
        WHEN change_date < started THEN 'change date lies before the current version' END AS reason
        FROM late l LEFT JOIN newest w ON l.employee_id = w.employee_id""",
    "on_time": "SELECT * FROM judged WHERE reason IS NULL",
}
_ASSIGN = {
    "wanted": f"""SELECT employee_id, project_id, min(request_id) AS first_id,
        arg_min(assigned_date, request_id) AS first_date, arg_max(role_in_project, request_id) AS last_role,
        arg_max(allocation_percentage, request_id) AS last_allocation FROM (SELECT row_number() OVER (ORDER BY ts, request_id) AS request_id,
        ts, employee_id, project_id, trim(role_in_project) AS role_in_project, allocation_percentage, assigned_date
        FROM assignment_requests WHERE len({_ASSIGNMENT_ERRORS}) = 0
        AND employee_id IN (SELECT employee_id FROM employees) AND project_id IN (SELECT project_id FROM projects))
        GROUP BY employee_id, project_id""",
}


_ROUTED_TEXTS = """SELECT event_id AS query_id, CASE event_id % 11
  WHEN 0 THEN 'SELECT full_name, monthly_income FROM DIM_EMPLOYEE WHERE employee_id = ' || (user_id + 10001)
  WHEN 1 THEN 'SELECT phone_number FROM EMPLOYEES WHERE employee_id = ' || (user_id + 10001) || ';'
  WHEN 2 THEN 'select e.Manager_ID, e.total_working_years from employees e where e.employee_id = ' || (user_id + 10001)
  WHEN 3 THEN 'SELECT ''the phone_number of ' || (user_id + 10001) || ''' AS note, full_name FROM dim_employee'
  WHEN 4 THEN 'SELECT department_name FROM departments WHERE department_id = ' || event_id || ' % 5'
  WHEN 5 THEN 'WITH a AS (SELECT allocation_percentage FROM project_assignments WHERE employee_id = ' || (user_id + 10001)
    || ') SELECT max(allocation_percentage) FROM a'
  WHEN 6 THEN 'SELECT full_name AS phone_number FROM DIM_EMPLOYEE -- not the manager_id of ' || event_id
  WHEN 7 THEN 'SELECT ' || event_id
  WHEN 8 THEN 'WITH projects AS (SELECT project_name FROM dim_project WHERE project_key = ' || event_id || ') SELECT * FROM projects'
  WHEN 9 THEN 'SELECT f.performance_rating /* no age */ FROM fact_performance_reviews f WHERE f.emp_key = ' || event_id
  ELSE '' END AS sql_text FROM events"""
# What each template needs, stated rather than derived.
_ROUTED = """SELECT query_id, sql_text, CASE WHEN query_id % 11 IN (1, 2, 4, 5) THEN 'OLTP' ELSE 'OLAP' END AS layer,
  CASE query_id % 11 WHEN 1 THEN 'needs phone_number' WHEN 2 THEN 'needs manager_id, total_working_years' WHEN 4 THEN 'reads departments'
  WHEN 5 THEN 'needs allocation_percentage' ELSE 'default' END AS reason FROM routed_texts"""


def parity_sql() -> dict[str, str]:
    texts = {"texts": _TEXTS}
    jobs_v1 = {"jobs_v1": _JOBS_V1}
    history = {"history": _HISTORY, "dated": _HISTORY_DATED}
    known = "(CASE WHEN department_id IS NULL THEN NULL ELSE " + _NAME_CASE.format(
        rest='ELSE coalesce("Department", \'General\')'
    ) + " END)"
    statements: dict[str, tuple[str, dict[str, str] | None] | str] = {
        "staging_employees": _as("staging"),
        "stage_csv_roundtrip": _as("staging"),
        "seed_projects": """SELECT p.department_id, project_id, project_name, CAST(start_date AS VARCHAR) AS start_date,
            CAST(end_date AS VARCHAR) AS end_date, CAST(budget AS DOUBLE) AS budget, department_name
            FROM projects p JOIN departments d ON p.department_id = d.department_id""",
        "drop_constant_columns": "SELECT * FROM customer",
        "replicate_to_target": _REPLICATED,
        "zip_rows_by_position": f"""SELECT r.c_custkey, r.employee_id, o.o_orderkey FROM ({_REPLICATED}) r JOIN (
            SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) o ON r.employee_id = 10000 + o.n""",
        "department_lookup_default": f"""SELECT src_key, department, CASE department WHEN 'Sales' THEN 1
            WHEN 'Research & Development' THEN 2 WHEN 'Human Resources' THEN 3 ELSE 1 END AS department_id
            FROM (SELECT src_key, {known} AS department FROM staging)""",
        "scd2_history_expand": (
            f"""SELECT c_custkey, CAST(hired AS VARCHAR) AS hire_date, CAST("MonthlyIncome" AS INTEGER) AS "MonthlyIncome",
            CAST("JobLevel" AS INTEGER) AS "JobLevel", CAST(department_id AS INTEGER) AS department_id,
            CAST(s AS VARCHAR) AS effective_start_date, CAST(e AS VARCHAR) AS effective_end_date, is_current, change_reason FROM (
            SELECT c_custkey, hired, income * (75 + c_custkey % 16) // 100 AS "MonthlyIncome", greatest(1, lvl - 1) AS "JobLevel",
            CASE WHEN c_custkey % 10 < 3 THEN dept % 3 + 1 ELSE dept END AS department_id, hired AS s, changed AS e, 0 AS is_current,
            {_pick('c_custkey % 3', 'Promotion & Salary Hike', 'Department Transfer', 'Annual Merit Increase')} AS change_reason
            FROM dated WHERE has_history
            UNION ALL SELECT c_custkey, hired, income, lvl, dept, changed, {_OPEN}, 1, 'Current Active State' FROM dated WHERE has_history
            UNION ALL SELECT c_custkey, hired, income, lvl, dept, hired, {_OPEN}, 1, 'Initial Onboarding' FROM dated WHERE NOT has_history)""",
            history,
        ),
        "email_derivation": """SELECT c_custkey, lower(substr(c_name, 1, 8)) || '.' || lower(c_mktsegment)
            || CAST(10 + c_custkey % 90 AS VARCHAR) || '@company.com' AS email FROM customer""",
        "cleanse_staging": f"""SELECT * REPLACE (CAST(monthly_income AS DOUBLE) AS monthly_income, CAST(hire_date AS VARCHAR) AS hire_date,
            CAST(percent_salary_hike AS DOUBLE) AS percent_salary_hike) FROM (
            SELECT src_key, employee_id, {_CLEAN_DIM}, {_CLEAN_SCORES} FROM staging)""",
        "surrogate_keys": """SELECT src_key, employee_id, CAST(effective_start_date AS VARCHAR) AS effective_start_date,
            row_number() OVER (ORDER BY employee_id, effective_start_date, src_key) AS row_key FROM staging""",
        "next_employee_id": "SELECT CAST(coalesce(max(employee_id), 0) + 1 AS BIGINT) AS next_id FROM employees",
        "distinct_departments": "SELECT DISTINCT department_id FROM staging",
        "dedup_staging": """SELECT employee_id, CAST(effective_start_date AS VARCHAR) AS effective_start_date, src_key, is_current,
            CAST("MonthlyIncome" AS DOUBLE) AS "MonthlyIncome" FROM deduped""",
        "oltp_departments": _as("departments"),
        "oltp_departments_v1": f"""SELECT department_id, {_NAME_CASE.format(rest='')} AS department_name,
            {_PLACE_CASE.format(rest='')} AS location FROM (SELECT DISTINCT department_id FROM staging)""",
        "oltp_jobs": _as("jobs"),
        "oltp_jobs_v1": (_as("jobs_v1", "jobs"), jobs_v1),
        "oltp_employees": f"""SELECT {_shown('employees')} FROM (SELECT *, CAST(NULL AS INTEGER) AS manager_id FROM unmanaged)""",
        "oltp_employees_v1": (f"SELECT {_shown('employees')} FROM ({_V1_EMPLOYEE})", jobs_v1),
        "assign_managers": "SELECT employee_id, department_id, manager_id FROM employees",
        "assign_managers_v1": """SELECT e.employee_id, e.department_id, CASE WHEN e.employee_id % 5 <> 0 THEN (
            SELECT min(m.employee_id) FROM employees m WHERE m.department_id = e.department_id
            AND m.employee_id <> e.employee_id) END AS manager_id FROM employees e""",
        "project_assignments": _as("project_assignments"),
        "project_assignments_v1": _as("assignments_v1", "project_assignments"),
        "oltp_reviews": _as("performance_reviews"),
        "oltp_reviews_v1": f"""SELECT row_number() OVER (ORDER BY employee_id, effective_start_date, src_key) AS review_id, employee_id,
            CAST(effective_start_date AS VARCHAR) AS review_date, {_RAW_SCORES.replace('"PercentSalaryHike" AS', 'CAST("PercentSalaryHike" AS DOUBLE) AS')}
            FROM staging""",
        "dim_department": _as("dim_department"),
        "dim_project": _as("dim_project"),
        "dim_date": f"SELECT * REPLACE (CAST(full_date AS VARCHAR) AS full_date) FROM ({_calendar(_first_of_year('min(hire_date)'))})",
        "dim_date_extend": f"SELECT * REPLACE (CAST(full_date AS VARCHAR) AS full_date) FROM ({_calendar(_first_of_year('min(hire_date)'))})",
        "dim_date_v1": _facts_per_day("2015-01-01", "2030-12-31"),
        "dim_date_v2": _facts_per_day("2010-01-01", "2035-12-31"),
        "dashboard_bundle": f"""SELECT 'combined_kpis' AS metric, 'active_count' AS key, CAST(active_count AS DOUBLE) AS value FROM ({_KPIS})
            UNION ALL SELECT 'combined_kpis', 'avg_income', avg_income FROM ({_KPIS})
            UNION ALL SELECT 'combined_kpis', 'avg_rating', avg_rating FROM ({_KPIS})
            UNION ALL SELECT 'combined_kpis', 'avg_satisfaction', avg_satisfaction FROM ({_KPIS})
            UNION ALL SELECT 'top_performers_by_department', department_name || ' #' || rnk, percent_salary_hike FROM ({_TOP})
            UNION ALL SELECT 'attrition_rate_by_department', department_name, attrition_rate_pct FROM ({_RATES})
            UNION ALL SELECT 'avg_income_by_role', job_role, avg_income FROM (
              SELECT job_role, {_avg('monthly_income')} AS avg_income FROM {_CURRENT} GROUP BY job_role)
            UNION ALL SELECT 'yearly_trends', CAST(year AS VARCHAR), avg_rating FROM ({_TRENDS})
            UNION ALL SELECT 'attrition_risk_flags', department_name, CAST(count(*) AS DOUBLE) FROM (
              SELECT d.department_name FROM fact_performance_reviews f JOIN {_CURRENT} e ON f.emp_key = e.emp_key
              JOIN dim_department d ON f.dept_key = d.dept_key JOIN dim_date dt ON f.review_date_key = dt.date_key
              WHERE f.job_satisfaction <= 2 ORDER BY f.job_satisfaction, dt.full_date DESC, e.employee_id, f.review_fact_id LIMIT 50)
              GROUP BY department_name""",
        "dim_date_populate": f"""SELECT 'empty' AS calendar, year, count(*) AS n_days FROM (
            {_calendar(_first_of_year('min(hire_date)'))}) GROUP BY year
            UNION ALL SELECT 'filled', year, count(*) FROM dim_date WHERE year >= 2000 GROUP BY year""",
        "dim_employee_scd2": _as("dim_employee"),
        "dim_employee_v1": _as("dim_employee_v1", "dim_employee"),
        "fact_reviews": _as("fact_performance_reviews"),
        "fact_reviews_v1_fanout": f"""SELECT s.src_key, e.emp_key, d.dept_key, coalesce(p.project_key, 1) AS project_key,
            CAST(strftime(s.effective_start_date, '%Y%m%d') AS INTEGER) AS review_date_key,
            {_RAW_SCORES.replace('"PercentSalaryHike" AS', 'CAST("PercentSalaryHike" AS DOUBLE) AS')},
            CAST(s."MonthlyIncome" AS DOUBLE) AS monthly_income FROM staging s JOIN dim_employee e
            ON s.employee_id = e.employee_id AND s.effective_start_date = e.effective_start_date
            JOIN dim_department d ON s.department_id = d.department_id
            LEFT JOIN assignments_v1 pa ON s.employee_id = pa.employee_id LEFT JOIN dim_project p ON pa.project_id = p.project_id""",
        "employee_version_asof": """SELECT p.employee_id, CAST(p.probe_date AS VARCHAR) AS probe_date, p.probe_id, e.emp_key FROM (
            SELECT o_orderkey AS probe_id, CAST(o_custkey + 10001 AS INTEGER) AS employee_id,
            CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 30 AS INTEGER) AS probe_date FROM orders) p LEFT JOIN dim_employee e
            ON p.employee_id = e.employee_id AND e.effective_start_date <= p.probe_date AND p.probe_date < e.effective_end_date""",
        "load_counts": _COUNTS,
        "pipeline_row_counts": _COUNTS,
        "scd2_apply_changes": (_as("changed_dim", "dim_employee"), _scd2("described")),
        "scd2_apply_rejects": """SELECT change_id, employee_id, CAST(change_date AS VARCHAR) AS change_date FROM role_changes
            WHERE employee_id NOT IN (SELECT employee_id FROM dim_employee WHERE is_current = 1)""",
        "reject_unknown_employees": """SELECT change_id, employee_id FROM role_changes
            WHERE employee_id NOT IN (SELECT employee_id FROM employees)""",
        "update_employee_roles": f"""SELECT {_shown('employees')} FROM (SELECT e.* REPLACE (
            coalesce(l.new_department_id, e.department_id) AS department_id, coalesce(l.new_job_id, e.job_id) AS job_id,
            coalesce(l.new_monthly_income, e.monthly_income) AS monthly_income) FROM employees e LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY ts DESC, change_id DESC) AS rn FROM valid_changes) l
            ON e.employee_id = l.employee_id AND l.rn = 1)""",
        "update_employee_roles_dim": (_as("changed_dim", "dim_employee"), _scd2("valid_changes")),
        "update_employee_roles_stored": (_as("changed_dim", "dim_employee"), _scd2("valid_changes")),
        "role_changes_stream": (_as("changed_dim", "dim_employee"), _scd2("valid_changes")),
        "update_unknown_jobs": (
            """SELECT e.employee_id, w.new_job_id AS job_id, w.job_role AS oltp_role, w.job_level AS oltp_level,
            w.job_role AS olap_role, w.job_level AS olap_level FROM employees e JOIN (SELECT *, row_number() OVER (
            PARTITION BY employee_id ORDER BY ts DESC, change_id DESC) AS rn FROM fitting) w
            ON w.employee_id = e.employee_id AND w.rn = 1""",
            {
                "fitting": """SELECT c.change_id, c.ts, c.employee_id, coalesce(j.job_id, (SELECT max(job_id) + 1 FROM jobs)) AS new_job_id,
                coalesce(j.job_role, 'Updated Role') AS job_role, coalesce(j.job_level, 1) AS job_level
                FROM role_changes c JOIN (SELECT employee_id, max(effective_start_date) AS began FROM dim_employee
                WHERE is_current = 1 GROUP BY employee_id) d ON d.employee_id = c.employee_id AND c.change_date >= began
                LEFT JOIN jobs j ON j.job_id = c.change_id % 29 + 1
                WHERE new_monthly_income BETWEEN 1000 AND 500000 AND c.employee_id IN (SELECT employee_id FROM employees)
                AND new_department_id IN (SELECT department_id FROM departments)"""
            },
        ),
        "onboard_unknown_jobs": f"""SELECT CAST(employee_id AS INTEGER) AS employee_id,
            coalesce(j.job_id, (SELECT max(job_id) + 1 FROM jobs)) AS job_id,
            coalesce(j.job_role, 'Unassigned') AS oltp_role, coalesce(j.job_level, 1) AS oltp_level,
            coalesce(j.job_role, 'Unassigned') AS olap_role, coalesce(j.job_level, 1) AS olap_level FROM (
            SELECT row_number() OVER (ORDER BY candidate_id) + (SELECT max(employee_id) FROM employees) AS employee_id, *
            FROM hireable WHERE len({_ONBOARDING_ERRORS}) = 0 AND department_id IN (SELECT department_id FROM departments)
            AND manager_id IN (SELECT employee_id FROM employees)) h LEFT JOIN jobs j ON h.job_id = j.job_id""",
        "reload_tables": """SELECT 'departments' AS table_name, count(*) AS n FROM departments WHERE department_id <> 3
            UNION ALL SELECT 'jobs', count(*) FROM jobs UNION ALL SELECT 'projects', count(*) FROM projects WHERE department_id <> 3
            UNION ALL SELECT 'employees', count(*) FROM employees WHERE department_id <> 3""",
        "append_reviews_stored": f"SELECT {_shown('fact_performance_reviews')} FROM fact_performance_reviews UNION ALL ",
        "staging_quarantine": """SELECT CASE WHEN src_key % 97 = 5 OR src_key % 89 = 7 OR src_key % 101 = 3 THEN 'quarantined'
            ELSE 'loaded' END AS kind, count(*) AS n, CAST(sum(src_key) AS BIGINT) AS key_sum FROM staging GROUP BY ALL""",
        "routed_sql": (_ROUTED, {"routed_texts": _ROUTED_TEXTS}),
        "onboard_employees": f"""SELECT {_shown('employees')} FROM (SELECT CAST(employee_id AS INTEGER) AS employee_id,
            trim(first_name) AS first_name, trim(last_name) AS last_name, lower(trim(email)) AS email, trim(phone_number) AS phone_number,
            age, CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS marital_status, CAST(NULL AS INTEGER) AS education,
            CAST(NULL AS VARCHAR) AS education_field, hire_date, department_id, job_id, manager_id, monthly_income, 'No' AS attrition,
            CAST(NULL AS INTEGER) AS distance_from_home, total_working_years FROM hires)""",
        "onboard_dim_rows": f"""SELECT {_shown('dim_employee')} FROM (SELECT row_number() OVER (ORDER BY candidate_id)
            + (SELECT max(emp_key) FROM dim_employee) AS emp_key, CAST(employee_id AS INTEGER) AS employee_id,
            trim(first_name) || ' ' || trim(last_name) AS full_name, lower(trim(email)) AS email, j.job_role, j.job_level,
            monthly_income, department_id, hire_date, hire_date AS effective_start_date, {_OPEN} AS effective_end_date,
            1 AS is_current, 'New Hire' AS change_reason, 'No' AS attrition FROM hires h JOIN jobs j ON h.job_id = j.job_id)""",
        "assign_projects_upsert": (
            """SELECT a.assignment_id, a.employee_id, a.project_id, coalesce(w.last_role, a.role_in_project) AS role_in_project,
            coalesce(w.last_allocation, a.allocation_percentage) AS allocation_percentage,
            CAST(a.assigned_date AS VARCHAR) AS assigned_date FROM project_assignments a LEFT JOIN wanted w
            ON a.employee_id = w.employee_id AND a.project_id = w.project_id
            UNION ALL SELECT row_number() OVER (ORDER BY w.first_id) + (SELECT max(assignment_id) FROM project_assignments),
            w.employee_id, w.project_id, w.last_role, w.last_allocation, CAST(w.first_date AS VARCHAR) FROM wanted w
            WHERE NOT EXISTS (SELECT 1 FROM project_assignments a WHERE a.employee_id = w.employee_id AND a.project_id = w.project_id)""",
            _ASSIGN,
        ),
        "submit_reviews": f"""SELECT row_number() OVER (ORDER BY v.ts, v.request_id) + (SELECT max(review_fact_id)
            FROM fact_performance_reviews) AS review_fact_id, e.emp_key, d.dept_key, CAST(1 AS BIGINT) AS project_key,
            dt.date_key AS review_date_key, CAST(NULL AS INTEGER) AS environment_satisfaction, CAST(NULL AS INTEGER) AS job_satisfaction,
            CAST(NULL AS INTEGER) AS relationship_satisfaction, CAST(NULL AS INTEGER) AS job_involvement, v.rating AS performance_rating,
            CAST(NULL AS DOUBLE) AS percent_salary_hike, CAST(NULL AS DOUBLE) AS monthly_income FROM ({_VALID_REVIEWS}) v
            JOIN {_CURRENT} e ON v.employee_id = e.employee_id JOIN dim_department d ON v.department_id = d.department_id
            JOIN dim_date dt ON CAST(strftime(v.review_date, '%Y%m%d') AS INTEGER) = dt.date_key""",
        "submit_reviews_oltp": f"""SELECT row_number() OVER (ORDER BY ts, request_id) + (SELECT max(review_id) FROM performance_reviews)
            AS review_id, employee_id, CAST(review_date AS VARCHAR) AS review_date, CAST(NULL AS INTEGER) AS environment_satisfaction,
            CAST(NULL AS INTEGER) AS job_satisfaction, CAST(NULL AS INTEGER) AS relationship_satisfaction,
            CAST(NULL AS INTEGER) AS job_involvement, rating AS performance_rating, CAST(NULL AS DOUBLE) AS percent_salary_hike
            FROM ({_VALID_REVIEWS})""",
        "give_raises": (
            "SELECT employee_id, arg_max(cents, n) / 100.0 AS monthly_income FROM folded GROUP BY employee_id",
            _RAISES,
        ),
        "give_raises_rejects": """SELECT request_id, employee_id, CAST(percent AS DOUBLE) AS percent, CASE WHEN employee_id NOT IN (
            SELECT employee_id FROM employees) THEN 'no employee with this id' ELSE 'percent must be positive' END AS reason
            FROM raise_requests WHERE percent <= 0 OR employee_id NOT IN (SELECT employee_id FROM employees)""",
        "give_raises_one_employee": (
            """SELECT employee_id, CAST(CASE WHEN employee_id = 10101 THEN (SELECT arg_max(cents, n) FROM climbed) / 100.0
                ELSE monthly_income END AS DOUBLE) AS monthly_income FROM employees""",
            _RAISES_OF_ONE,
        ),
        "give_raises_one_employee_rejects": (
            """SELECT request_id, CAST(points / 1000.0 AS DOUBLE) AS percent, CASE WHEN points IS NULL THEN 'percent is missing'
                WHEN points = 0 THEN 'percent must be positive' ELSE 'income would leave the range of the column' END AS reason
                FROM asked WHERE points IS NULL OR points = 0 OR request_id IN (SELECT request_id FROM climbed WHERE beyond)""",
            _RAISES_OF_ONE,
        ),
        "scd2_apply_late_rejects": ("SELECT change_id, reason FROM judged WHERE reason IS NOT NULL", _LATE),
        "scd2_integrity_late": (_integrity("changed_dim"), {**_LATE, **_scd2("on_time")}),
        "validate_required": "SELECT s_suppkey AS candidate_id, array_to_string("
        + _found(
            ("s_suppkey % 8 = 0", "**First Name** is required."),
            ("s_suppkey % 10 = 9", "**Last Name** is required."),
            ("s_suppkey % 8 = 1", "**Email** is required."),
            ("s_suppkey % 8 = 2", "Age is required."),
            ("s_suppkey % 8 = 3", "Hire date is required."),
            ("s_suppkey % 8 = 4", "Total working years is required."),
            ("s_suppkey % 8 = 5", "Monthly Income is required."),
            ("s_suppkey % 8 = 6", "Manager ID is required."),
        )
        + ", '; ') AS missing FROM supplier",
        "validate_names": f"""SELECT candidate_id, first_name, array_to_string({_name_errors('first_name', 'First Name')}, '; ') AS errors
            FROM candidates""",
        "validate_phones": f"SELECT candidate_id, phone_number, array_to_string({_PHONE_ERRORS}, '; ') AS errors FROM candidates",
        "validate_emails": f"SELECT candidate_id, email, array_to_string({_EMAIL_ERRORS}, '; ') AS errors FROM candidates",
        "validate_onboarding": "SELECT candidate_id, array_to_string(errors, '; ') AS errors FROM checked_candidates",
        "onboarding_error_counts": """SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM checked_candidates)
            GROUP BY error""",
        "validate_assignments": f"SELECT request_id, array_to_string({_ASSIGNMENT_ERRORS}, '; ') AS errors FROM assignment_requests",
        "validate_role_updates": "SELECT change_id, array_to_string("
        + _found(
            ("employee_id < 10001", rules.TARGET_EMPLOYEE_ID),
            ("new_monthly_income < 1000 OR new_monthly_income > 500000", rules.UPDATED_INCOME),
        )
        + ", '; ') AS errors FROM role_changes",
        "validate_reviews": "SELECT request_id, array_to_string("
        + _found(("employee_id < 10001", rules.EMPLOYEE_ID), ("rating NOT IN (1, 2, 3, 4)", rules.RATING))
        + ", '; ') AS errors FROM review_requests",
        "fk_violations": _fk(),
        "unique_violations": _unique(),
        "null_violations": _nulls(),
        "scd2_integrity": (_integrity("changed_dim"), _scd2("described")),
        "scd2_integrity_loaded": _integrity("dim_employee"),
        "sql_audit": (_AUDIT, texts),
        "combined_kpis": _KPIS,
        "kpi_cards": f"""SELECT format('{{:,}}', active_count) AS active_employees,
            format('{{:.2f}}', avg_rating) || ' / 4.0' AS avg_performance_rating,
            '$' || format('{{:,}}', CAST(floor(avg_income) AS BIGINT)) || right(format('{{:.2f}}', avg_income), 3) AS avg_monthly_income,
            format('{{:.2f}}', avg_satisfaction) || ' / 4.0' AS avg_job_satisfaction FROM ({_KPIS})""",
        "attrition_rate_by_department": _RATES,
        "attrition_share": f"""SELECT department_name, attrition_rate_pct,
            round(100 * attrition_rate_pct / nullif(sum(attrition_rate_pct) OVER (), 0), 4) AS share_pct FROM ({_RATES})""",
        "avg_income_by_role": f"SELECT job_role, {_avg('monthly_income')} AS avg_income FROM {_CURRENT} GROUP BY job_role",
        "attrition_risk_flags": f"""SELECT e.employee_id, d.department_name, e.job_role, f.job_satisfaction,
            CAST(dt.full_date AS VARCHAR) AS review_date FROM fact_performance_reviews f JOIN {_CURRENT} e ON f.emp_key = e.emp_key
            JOIN dim_department d ON f.dept_key = d.dept_key JOIN dim_date dt ON f.review_date_key = dt.date_key
            WHERE f.job_satisfaction <= 2 ORDER BY f.job_satisfaction, dt.full_date DESC, e.employee_id, f.review_fact_id LIMIT 50""",
        "top_performers_by_department": _TOP,
        "performer_labels": _LABELLED,
        "performers_by_hike": f"""SELECT emp_label, sum(percent_salary_hike) AS total_hike FROM ({_LABELLED}) GROUP BY emp_label""",
        "yearly_trends": _TRENDS,
        "yearly_scores_long": f"""SELECT CAST(year AS VARCHAR) AS year_str, 'avg_rating' AS metric, avg_rating AS value FROM ({_TRENDS})
            UNION ALL SELECT CAST(year AS VARCHAR), 'avg_satisfaction', avg_satisfaction FROM ({_TRENDS})""",
        "active_dim_employees": f"SELECT count(*) AS active_count FROM {_CURRENT}",
        "avg_performance_rating": f"SELECT coalesce({_avg('performance_rating')}, 0) AS avg_rating FROM fact_performance_reviews",
        "avg_income_current": f"SELECT coalesce({_avg('monthly_income')}, 0) AS avg_income FROM {_CURRENT}",
        "avg_job_satisfaction": f"SELECT coalesce({_avg('job_satisfaction')}, 0) AS avg_satisfaction FROM fact_performance_reviews",
        "top_earners_with_rating": f"""SELECT e.employee_id, e.full_name, CAST(e.monthly_income AS DOUBLE) AS monthly_income,
            f.performance_rating FROM {_CURRENT} e JOIN dim_department d ON e.department_id = d.department_id
            JOIN fact_performance_reviews f ON f.emp_key = e.emp_key WHERE d.department_name = 'Sales'
            ORDER BY e.monthly_income DESC, e.emp_key, f.review_fact_id LIMIT 5""",
        "employee_directory": _DIRECTORY,
        "employee_by_id": f"{_DIRECTORY} WHERE e.employee_id = {registry.ASK_EMPLOYEE}",
        "employees_in_department": f"{_DIRECTORY} WHERE d.department_name = '{registry.ASK_DEPARTMENT}'",
        "list_departments": "SELECT department_id, department_name FROM departments",
        "list_jobs": "SELECT job_id, job_role, job_level FROM jobs",
        "lookup_labels": """SELECT 'department' AS kind, CAST(department_id AS BIGINT) AS id,
            department_id || ' - ' || department_name AS label FROM departments
            UNION ALL SELECT 'job', job_id, job_id || ' - ' || job_role || ' (Level ' || job_level || ')' FROM jobs""",
        "top_performer_flag": """SELECT review_id, employee_id, performance_rating, performance_rating >= 4 AS is_top_performer
            FROM performance_reviews""",
        "guarded_sql_olap": f"""SELECT d.department_name, e.job_role, count(*) AS headcount FROM {_CURRENT} e
            JOIN dim_department d ON e.department_id = d.department_id GROUP BY d.department_name, e.job_role
            ORDER BY headcount DESC, d.department_name, e.job_role LIMIT 100""",
        "guarded_sql_oltp": """SELECT employee_id, phone_number, manager_id, total_working_years FROM employees
            WHERE manager_id IS NOT NULL ORDER BY total_working_years DESC, employee_id LIMIT 100""",
    }
    columns = ", ".join(TABLES["fact_performance_reviews"].columns)
    statements["append_reviews_stored"] += f"SELECT {columns} FROM ({statements['submit_reviews']})"
    built = {}
    for name, statement in statements.items():
        body, extra = statement if isinstance(statement, tuple) else (statement, None)
        built[name] = _with_steps(body, extra)
    return built
