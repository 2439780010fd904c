"""Tables in and out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, location: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{location}/{name}.parquet")


def save_dataset(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Write a dataset for other queries to read.

    With ``partition_by`` the rows are rebalanced on that column first, which keeps files large, and
    AQE splits a value that holds much of the data over several tasks.
    """
    writer = df if partition_by is None else df.hint("rebalance", partition_by)
    out = writer.write.mode(mode)
    (out if partition_by is None else out.partitionBy(partition_by)).parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset written by ``save_dataset``."""
    return spark.read.parquet(path)


def read_since(spark: SparkSession, path: str, partition: str, start: date) -> DataFrame:
    """A dataset from one partition date on; older partitions are not listed for reading."""
    return spark.read.parquet(path).filter(F.col(partition) >= F.lit(start))


def save_bucketed(df: DataFrame, table: str, *, by: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Write a table whose files are dealt out by a hash of some columns.

    Grouping on those columns and more, and joining on them with a table of as many buckets, then needs
    no shuffle. Rows are rebalanced on the columns before they are written, which keeps files large; AQE
    splits a value that holds much of the data over several tasks, so a task sorts no whole bucket and
    a large bucket is several files.
    """
    writer = df.hint("rebalance", *by).write.mode("overwrite").bucketBy(buckets, *by)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def append_table(df: DataFrame, table: str, *, path: str | None = None) -> None:
    """Append to a table, making it on first use."""
    writer = df.write.mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Define a view and read it by name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def present(df: DataFrame, *order: str | tuple[str, bool]) -> DataFrame:
    """Final sort for display: column names, or ``(name, ascending)``."""
    columns = [o if isinstance(o, tuple) else (o, True) for o in order]
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in columns])
