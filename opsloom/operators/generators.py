"""Calendar rows made inside Spark."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsloom.functions.calendar import month_of


def months_between(start: date, end: date) -> Column:
    """Array of month starts from the month of ``start`` to the month of ``end``."""
    return F.sequence(month_of(F.lit(start)), month_of(F.lit(end)), F.expr("interval 1 month"))


def month_spine(spark: SparkSession, start: date, as_of: date) -> DataFrame:
    """One row per month."""
    return spark.range(1).select(F.explode(months_between(start, as_of)).alias("index_month"))


def day_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("index_date"))


def explode_days(
    df: DataFrame, start: str, end: str, first: date, last: date, name: str = "index_date"
) -> DataFrame:
    """One row per day of ``[start, end]`` clipped to ``[first, last]``.

    The clip happens before the rows are made, and rows with an open or empty interval give none.
    """
    lo = F.greatest(F.col(start), F.lit(first))
    hi = F.least(F.col(end), F.lit(last))
    alive = F.col(start).isNotNull() & F.col(end).isNotNull() & (lo <= hi)
    return df.filter(alive).withColumn(name, F.explode(F.sequence(lo, hi)))
