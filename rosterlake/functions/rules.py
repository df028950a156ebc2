"""Input rules: each returns a column of the messages of the rules a row breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the rules mean it: the Unicode class plus four separators it leaves out.
_SPACE = r"\s\x1c-\x1f"
# Accepted formats, Unicode-aware in \s and \d.
NAME_PATTERN = rf"(?U)^[A-Za-z{_SPACE}\-']{{2,50}}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = rf"(?U)^\+?[\d{_SPACE}\-\(\)\.]{{7,20}}$"
ROLE_PATTERN = rf"(?U)^[A-Za-z{_SPACE}\-\._']{{2,50}}$"
LETTER = r"\p{L}"
# Decimal digits plus the super-, subscript and enclosed ones.
DIGITS = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
DIGIT = f"[{DIGITS}]"

# Limits.
FIRST_EMPLOYEE_ID = 10001
AGE_RANGE = (18, 75)
MIN_HIRE_AGE = 16
INCOME_RANGE = (1000, 500000)
ALLOCATION_RANGE = (10, 100)
RATING_RANGE = (1, 4)
MIN_PHONE_DIGITS = 7

# Messages.
EMAIL_REQUIRED = "**Email** is required."
EMAIL_SPACES = "Email address cannot contain spaces."
EMAIL_INVALID = "Please enter a valid email address (e.g., `jane.doe@company.com`)."
PHONE_DIGITS = "Phone number must contain at least 7 numeric digits."
PHONE_LETTERS = "Phone number cannot contain letters."
PHONE_FORMAT = "Phone number format is invalid (allowed: digits, spaces, +, -, parentheses)."
AGE = "Age must be between 18 and 75 years."
HIRE_FUTURE = "Hire date cannot be set in the future."
INCOME = "Monthly Income must be between $1,000.00 and $500,000.00."
MANAGER = "Manager ID must be a positive integer."
EMPLOYEE_ID = "Employee ID must be 10001 or greater."
PROJECT_ID = "Project ID must be a positive integer."
ROLE = "Role in Project must contain letters/title words only (no digits or symbols)."
ALLOCATION = "Allocation percentage must be between 10% and 100%."
TARGET_EMPLOYEE_ID = "Target Employee ID must be 10001 or greater."
UPDATED_INCOME = "Updated Monthly Income must be between $1,000.00 and $500,000.00."
RATING = "Performance Rating must be an integer between 1 and 4."
AGE_REQUIRED = "Age is required."
HIRE_REQUIRED = "Hire date is required."
YEARS_REQUIRED = "Total working years is required."
INCOME_REQUIRED = "Monthly Income is required."
MANAGER_REQUIRED = "Manager ID is required."
EMPLOYEE_REQUIRED = "Employee ID is required."
PROJECT_REQUIRED = "Project ID is required."
ALLOCATION_REQUIRED = "Allocation percentage is required."


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind; NULL becomes empty."""
    start = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)^[{_SPACE}]+", "")
    return F.regexp_replace(start, rf"(?U)[{_SPACE}]+\z", "")


def broken(*rules: tuple[Column, Column | str]) -> Column:
    """Messages of the conditions that hold, in order. An unknown condition does not hold, so
    every value that must be there has a rule of its own for being absent."""
    messages = [F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in rules]
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def outside(value: Column, bounds: tuple[int, int]) -> Column:
    return (value < bounds[0]) | (value > bounds[1])


def name_errors(name: Column, label: str) -> Column:
    text = stripped(name)
    letters = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    one_symbol = F.size(F.array_distinct(F.split(letters, ""))) <= 1
    details = broken(
        (text.rlike(DIGIT), f"**{label}** cannot contain numbers or digits."),
        (
            ~text.rlike(NAME_PATTERN),
            f"**{label}** can only contain letters, spaces, hyphens, and apostrophes "
            "(2–50 characters).",
        ),
        (one_symbol, f"**{label}** cannot consist of a single repeated character."),
    )
    missing = F.array(F.lit(f"**{label}** is required."))
    return F.when(text == "", missing).otherwise(details)


def email_errors(email: Column) -> Column:
    """At most one message: the first rule broken."""
    text = stripped(email)
    first = (
        F.when(text == "", EMAIL_REQUIRED)
        .when(text.contains(" "), EMAIL_SPACES)
        .when(~text.rlike(EMAIL_PATTERN), EMAIL_INVALID)
    )
    return F.filter(F.array(first), lambda m: m.isNotNull())


def phone_errors(phone: Column) -> Column:
    """Nothing to complain about when there is no number."""
    text = stripped(phone)
    digits = F.length(F.regexp_replace(text, f"[^{DIGITS}]", ""))
    given = text != ""
    return broken(
        (given & (digits < MIN_PHONE_DIGITS), PHONE_DIGITS),
        (given & text.rlike(LETTER), PHONE_LETTERS),
        (given & ~text.rlike(PHONE_PATTERN), PHONE_FORMAT),
    )


def timeline_errors(age: Column, hire_date: Column, working_years: Column, today: Column) -> Column:
    earliest_year = F.year(today) - age + MIN_HIRE_AGE
    career = F.greatest(F.lit(0), age - MIN_HIRE_AGE)
    too_young = F.concat(
        F.lit("Hire date ("), F.year(hire_date).cast("string"),
        F.lit(f") implies employee was hired before age {MIN_HIRE_AGE} (Age: "),
        age.cast("string"), F.lit(")."),
    )
    too_long = F.concat(
        F.lit("Total working years ("), working_years.cast("string"),
        F.lit(") exceeds maximum possible career span for age "), age.cast("string"),
        F.lit(" (max allowed: "), career.cast("string"), F.lit(" years)."),
    )
    return broken(
        (age.isNull(), AGE_REQUIRED),
        (hire_date.isNull(), HIRE_REQUIRED),
        (working_years.isNull(), YEARS_REQUIRED),
        (outside(age, AGE_RANGE), AGE),
        (hire_date > today, HIRE_FUTURE),
        (F.year(hire_date) < earliest_year, too_young),
        (working_years > career, too_long),
    )


def onboarding_errors(today: Column) -> Column:
    return F.concat(
        name_errors(F.col("first_name"), "First Name"),
        name_errors(F.col("last_name"), "Last Name"),
        email_errors(F.col("email")),
        phone_errors(F.col("phone_number")),
        timeline_errors(F.col("age"), F.col("hire_date"), F.col("total_working_years"), today),
        broken(
            (F.col("monthly_income").isNull(), INCOME_REQUIRED),
            (outside(F.col("monthly_income"), INCOME_RANGE), INCOME),
            (F.col("manager_id").isNull(), MANAGER_REQUIRED),
            (F.col("manager_id") <= 0, MANAGER),
        ),
    )


def assignment_errors() -> Column:
    role = stripped(F.col("role_in_project"))
    bad_role = (role == "") | role.rlike(DIGIT) | ~role.rlike(ROLE_PATTERN)
    return broken(
        (F.col("employee_id").isNull(), EMPLOYEE_REQUIRED),
        (F.col("employee_id") < FIRST_EMPLOYEE_ID, EMPLOYEE_ID),
        (F.col("project_id").isNull(), PROJECT_REQUIRED),
        (F.col("project_id") < 1, PROJECT_ID),
        (bad_role, ROLE),
        (F.col("allocation_percentage").isNull(), ALLOCATION_REQUIRED),
        (outside(F.col("allocation_percentage"), ALLOCATION_RANGE), ALLOCATION),
    )


def role_update_errors() -> Column:
    return broken(
        (F.col("employee_id").isNull(), EMPLOYEE_REQUIRED),
        (F.col("employee_id") < FIRST_EMPLOYEE_ID, TARGET_EMPLOYEE_ID),
        (F.col("new_monthly_income").isNull(), INCOME_REQUIRED),
        (outside(F.col("new_monthly_income"), INCOME_RANGE), UPDATED_INCOME),
    )


def review_errors() -> Column:
    rating = F.col("rating")
    return broken(
        (F.col("employee_id").isNull(), EMPLOYEE_REQUIRED),
        (F.col("employee_id") < FIRST_EMPLOYEE_ID, EMPLOYEE_ID),
        (rating.isNull() | outside(rating, RATING_RANGE), RATING),
    )
