"""Typed companion tables of sources that hold their dates as text.

A filter on parsed text cannot be pushed, so a look-back over such a source reads its whole history. A
companion is written once: text dates are parsed to timestamps, and rows are partitioned by ``touched_day``,
the latest day of the columns that look-backs test. A row is inside a look-back only if one of those columns
is, so reading partitions from the look-back's first day on loses nothing, and the plans' own filters, which
stay as they are, decide the rest. The plans read a companion in place of the source: parsing leaves a column
that is a timestamp already as it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsloom.sources.tables import read_since, save_dataset

TOUCHED = "touched_day"


def typed(source: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Text columns as timestamps: column -> format. Bad text raises, NULL stays NULL."""
    return source.withColumns({c: F.to_timestamp_ntz(F.col(c), F.lit(f)) for c, f in formats.items()})


def latest_day(columns: Sequence[str]) -> Column:
    """Latest day of several timestamps, NULLs left out."""
    days = [F.to_date(c) for c in columns]
    return F.greatest(*days) if len(days) > 1 else days[0]


def save_companion(source: DataFrame, path: str, *, formats: Mapping[str, str], touched: Sequence[str]) -> None:
    """Write the companion of a source; ``touched`` are the columns that look-backs test, parsed or already typed."""
    dated = typed(source, formats).withColumn(TOUCHED, latest_day(touched))
    save_dataset(dated, path, partition_by=TOUCHED)


def touched_since(spark: SparkSession, path: str, day: date) -> DataFrame:
    """Rows that may be inside a look-back from ``day`` on; older partitions are not read."""
    return read_since(spark, path, TOUCHED, day).drop(TOUCHED)


def touched_on(spark: SparkSession, path: str, days: DataFrame, day: str) -> DataFrame:
    """Rows last touched on the days that another relation lists; its partitions are picked at run time.

    ``days`` is reduced to one row per calendar day, which bounds what is broadcast by the length of the history.
    """
    wanted = days.select(F.col(day).alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    companion = spark.read.parquet(path)
    return companion.join(F.broadcast(wanted), F.col(TOUCHED) == F.col("_day"), "left_semi").drop(TOUCHED)
