"""Calendar rows: one per day of a closed range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators.keys import date_key

# The ranges of the two calendar loads.
CALENDAR_V1 = ("2015-01-01", "2030-12-31")
CALENDAR_V2 = ("2010-01-01", "2035-12-31")


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    bounds = spark.range(1).select(
        F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")
    )
    return calendar_between(bounds, F.col("first"), F.col("last"))


def calendar_between(bounds: DataFrame, first: Column, last: Column) -> DataFrame:
    """Calendar of a one-row frame's bounds."""
    day = F.col("full_date")
    days = bounds.select(F.explode(F.sequence(first, last)).alias("full_date"))
    return days.select(
        date_key(day).alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).alias("day_of_month"),
        F.date_format(day, "EEEE").alias("day_of_week"),
    )
