"""Load all feeds of an inbox into named tables, each file once, a load visible only when it is complete.

One stream reads the names of arrived files, not their content; each micro-batch is one load of all feeds. A load
writes its rows of every feed into its own partition of that feed's table, replacing what an earlier try left, and
is then published by one row group appended to the log, the commit marker. ``read_published`` shows published
loads only, so a reader sees all feeds of a load or none of it. A load that is tried again after it was published
is skipped. Batch loads (``load_files``) go the same way, so tables may take both.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsloom.sources.feeds import FEEDS, LOAD, csv_options, feed_schema, with_lineage

LOG_COLUMNS = f"{LOAD} string, feed string, files long"
_FILE = "path string, modificationTime timestamp, length long, content binary"


def make_table(spark: SparkSession, table: str, columns: str, *, partition_by: str | None = None, path: str | None = None) -> None:
    """Make a parquet table if it is absent; with ``path`` its files lie there, otherwise in the warehouse.

    A table made over a folder that holds partitions already shows them.
    """
    if spark.catalog.tableExists(table):
        return
    parts = f" PARTITIONED BY ({partition_by})" if partition_by else ""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{parts}{place}")
    if partition_by and path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def make_feed_tables(spark: SparkSession, tables: Mapping[str, str], log: str, *, folder: str | None = None) -> None:
    """Make the feeds' tables (feed -> table name) and the log, all below ``folder`` where it is given."""
    for feed, table in tables.items():
        columns = ", ".join(f"`{f.name}` string" for f in feed_schema(feed))
        make_table(spark, table, f"{columns}, source_file string, {LOAD} string", partition_by=LOAD, path=folder and f"{folder}/{table}")
    make_table(spark, log, LOG_COLUMNS, path=folder and f"{folder}/{log}")


def write_load(rows: DataFrame, table: str, load_id: str) -> None:
    """Put a load into its partition of a named table, in place of what that partition held; others stay."""
    if not re.fullmatch(r"[\w.-]+", load_id):
        raise ValueError(f"{load_id!r} is no name of a load")
    rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({LOAD} = '{load_id}') SELECT * FROM {{rows}}", rows=rows)


def is_published(spark: SparkSession, log: str, load_id: str) -> bool:
    return not spark.table(log).filter(F.col(LOAD) == load_id).isEmpty()


def publish(spark: SparkSession, log: str, load_id: str, files: Mapping[str, int]) -> None:
    """Append a load's rows to the log in one file, which appears whole or not at all."""
    marker = spark.createDataFrame([(load_id, feed, n) for feed, n in files.items()], LOG_COLUMNS)
    marker.coalesce(1).write.mode("append").insertInto(log)


def read_published(spark: SparkSession, table: str, log: str) -> DataFrame:
    """Rows of complete loads."""
    spark.catalog.refreshTable(table)
    spark.catalog.refreshTable(log)
    loads = spark.table(log).select(LOAD).distinct()
    return spark.table(table).join(loads, LOAD, "left_semi")


def _inside(inbox: str, path: str) -> str:
    """Place of a file or delivery folder below the inbox."""
    place = re.sub(r"^[a-z0-9]+:/*", "/", inbox).rstrip("/") + "/"
    return path[path.index(place) + len(place) :]


def _escaped(path: str) -> str:
    """A path that a glob takes literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def route(inbox: str, paths: Sequence[str], feeds: Sequence[str]) -> dict[str, list[str]]:
    """Files of each feed, told apart by the first four characters of their name, or of their delivery's, in the inbox."""
    return {feed: [p for p in paths if _inside(inbox, p).startswith(FEEDS[feed][0])] for feed in feeds}


def load_files(
    spark: SparkSession, inbox: str, paths: Sequence[str], tables: Mapping[str, str], log: str, load_id: str | None = None,
    *, quoted_newlines: bool = True,
) -> str | None:
    """Load some files of the inbox into the feeds' tables and publish them together; ``None`` if that was done before."""
    load_id = load_id or f"batch-{uuid.uuid4().hex}"
    if is_published(spark, log, load_id):
        return None
    routed = route(inbox, paths, list(tables))
    for feed, files in routed.items():
        if files:
            reader = spark.read.schema(feed_schema(feed)).options(**csv_options(quoted_newlines))
            write_load(with_lineage(reader.csv([_escaped(f) for f in files])), tables[feed], load_id)
    publish(spark, log, load_id, {feed: len(files) for feed, files in routed.items()})
    return load_id


def load_inbox(
    spark: SparkSession, inbox: str, tables: Mapping[str, str], log: str, checkpoint: str,
    *, quoted_newlines: bool = True, files_per_batch: int = 1000,
) -> int:
    """Load the files of all feeds that arrived since the last call; the number of loads published.

    The driver holds the names of at most ``files_per_batch`` files at a time.
    """
    prefixes = ",".join(FEEDS[feed][0] for feed in tables)
    arrived = (
        spark.readStream.format("binaryFile").schema(_FILE)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(f"{inbox.rstrip('/')}/{{{prefixes}}}*")
        .select("path")
    )
    started, stream, loads = Event(), [], []

    def load(names: DataFrame, batch: int) -> None:
        started.wait()
        paths = sorted({r["path"] for r in names.collect()})  # the file source lists some names twice
        loads.append(load_files(spark, inbox, paths, tables, log, f"stream-{stream[0]}-{batch}", quoted_newlines=quoted_newlines))

    query = arrived.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.append(query.id)
    started.set()
    query.awaitTermination()
    return sum(1 for load_id in loads if load_id)
