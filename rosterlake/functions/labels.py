"""Code-to-label mappings and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known departments with their names and locations.
DEPARTMENTS = {
    1: ("Sales", "New York - Tech Hub"),
    2: ("Research & Development", "San Francisco - R&D Center"),
    3: ("Human Resources", "Chicago - HQ"),
}
DEFAULT_DEPARTMENT = "General"
DEFAULT_LOCATION = "Headquarters"


def _mapped(code: Column, position: int) -> Column:
    mapping = F.create_map(*[F.lit(x) for k, v in DEPARTMENTS.items() for x in (k, v[position])])
    return F.try_element_at(mapping, code)


def department_name(code: Column, staged_name: Column | None = None) -> Column:
    """Known name; otherwise the staged name or 'General'. Without a staged name: NULL."""
    known = _mapped(code, 0)
    if staged_name is None:
        return known
    return F.coalesce(known, staged_name, F.lit(DEFAULT_DEPARTMENT))


def department_location(code: Column, default: bool = True) -> Column:
    known = _mapped(code, 1)
    return F.coalesce(known, F.lit(DEFAULT_LOCATION)) if default else known


def department_code(name: Column) -> Column:
    """Id of a department name, 1 for every other name."""
    pairs = [F.lit(x) for code, (label, _) in DEPARTMENTS.items() for x in (label, code)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(1)).cast("int")


def full_name(first: str | Column, last: str | Column) -> Column:
    first, last = (F.col(c) if isinstance(c, str) else c for c in (first, last))
    return F.concat(first, F.lit(" "), last)


def email_address(first: Column, last: Column, number: Column, domain: str = "company.com") -> Column:
    """first.lastNN@domain in lower case."""
    return F.concat(
        F.lower(first), F.lit("."), F.lower(last), number.cast("string"), F.lit(f"@{domain}")
    )


def performer_label(rank: Column, name: Column, department: Column) -> Column:
    return F.concat(
        F.lit("#"), rank.cast("string"), F.lit(" "), name, F.lit(" ("), department, F.lit(")")
    )


def count_display(value: Column) -> Column:
    return F.format_number(value, 0)


def score_display(value: Column) -> Column:
    return F.concat(F.format_number(value, 2), F.lit(" / 4.0"))


def money_display(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def department_option(code: Column, name: Column) -> Column:
    return F.concat(code.cast("string"), F.lit(" - "), name)


def job_option(code: Column, role: Column, level: Column) -> Column:
    return F.concat(
        code.cast("string"), F.lit(" - "), role, F.lit(" (Level "), level.cast("string"), F.lit(")")
    )
