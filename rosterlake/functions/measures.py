"""Exact averages and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_avg(value: str | Column, digits: int = 2) -> Column:
    """AVG rounded half away from zero on decimals: rounding a double average would turn
    1.005 either way."""
    value = F.col(value) if isinstance(value, str) else value
    total = F.sum(value.cast("decimal(12,2)"))
    return F.round(total / F.nullif(F.count(value), F.lit(0)), digits).cast("double")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))
