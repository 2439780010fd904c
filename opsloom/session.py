"""Session defaults the library is written for, and the shared folder for written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

#: Rows of the datasets shrink up to 25 times in a shuffle, so tasks are dealt less than Spark's 64 MB of it.
TASK_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
}
#: Partitions a shuffle starts with; AQE merges what is smaller than the advisory size. More than these
#: (``spark.shuffle.sort.bypassMergeThreshold``) and map tasks hold their output in memory to sort it.
SHUFFLED = 200


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings the results depend on (UTC day boundaries, ANSI casts, AQE)."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def prepare_tables(spark: SparkSession) -> SparkSession:
    """``prepare``, and tasks whose size does not grow with the tables."""
    prepare(spark)
    for key, value in TASK_CONF.items():
        spark.conf.set(key, value)
    starts = max(SHUFFLED, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(starts))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    It has no default: a folder of one machine would lose data with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, grouped by application so that old runs can be expired.

    Inside ``scratch`` the path lies in the scope's folder and goes with it.
    """
    folder = _scope.get() or f"{shared_dir(spark)}/opsloom/{spark.conf.get('spark.app.id')}"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Own what is written to the shared folder inside the block, and remove it at the end.

    Save or collect results inside: a relation that reads an intermediate cannot be read afterwards.
    Scopes nest; what an outer one holds stays until it ends, also when the block fails.
    """
    folder = fresh_dir(spark, "scratch")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        _remove(spark, folder)


def release(spark: SparkSession) -> None:
    """Remove all that this application wrote to the shared folder; call it when the results have been read."""
    _remove(spark, f"{shared_dir(spark)}/opsloom/{spark.conf.get('spark.app.id')}")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    This cuts the lineage on reliable storage, computes a relation that several branches read only
    once, and gives Catalyst the true file size: a join against it is broadcast only when that size
    is under ``spark.sql.autoBroadcastJoinThreshold`` and is a shuffled, skew-split join otherwise.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
