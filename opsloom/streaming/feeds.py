"""Load each arrived feed file exactly once."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession

from opsloom.sources.feeds import csv_options, feed_glob, feed_schema, save_load, with_lineage


def load_arrived(
    spark: SparkSession, inbox: str, feed: str, target: str, checkpoint: str, *,
    quoted_newlines: bool = True, files_per_batch: int = 1000,
) -> int:
    """Append the files that arrived since the last call and return the number of batches run.

    The checkpoint remembers which files were loaded, so sources need not be deleted, a rerun loads
    nothing twice, and a run cut short resumes. Each batch is one load of the dataset, named by the
    stream and the batch, so a batch that is tried again replaces its own rows; ``load_feed`` may append
    to the same dataset.
    """
    arrived = (
        spark.readStream.schema(feed_schema(feed))
        .options(**csv_options(quoted_newlines))
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(feed_glob(inbox, feed))
    )
    started, stream, batches = Event(), [], []

    def append(rows: DataFrame, batch: int) -> None:
        started.wait()
        save_load(rows, target, f"stream-{stream[0]}-{batch}")
        batches.append(batch)

    query = (
        with_lineage(arrived)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.append(query.id)
    started.set()
    query.awaitTermination()
    return len(batches)
