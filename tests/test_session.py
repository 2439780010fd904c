import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from opsloom.session import SESSION_CONF, SHUFFLED, TASK_CONF, fresh_dir, prepare_tables, release, scratch, settle, shared_dir
from tests.conftest import rows


def test_settings_are_pinned(spark):
    assert {k: spark.conf.get(k) for k in SESSION_CONF} == SESSION_CONF


def test_table_tasks_do_not_grow_with_few_shuffle_partitions(spark):
    session = prepare_tables(spark.newSession())
    assert {k: session.conf.get(k) for k in TASK_CONF} == TASK_CONF
    assert int(session.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == SHUFFLED
    session.conf.set("spark.sql.shuffle.partitions", "900")
    assert int(prepare_tables(session).conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 900


def test_settled_relation_is_read_from_the_shared_folder(spark, make):
    df = make("a int, b string", (1, "x"), (2, None)).withColumn("c", F.col("a") * 2)
    kept = settle(df, "probe")
    assert kept.schema.simpleString() == df.schema.simpleString() and rows(kept) == rows(df)
    assert all(shared_dir(spark).removeprefix("file:") in f for f in kept.inputFiles())
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_small_settled_side_is_broadcast_by_its_size_and_large_one_is_not(spark, make):
    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    small = settle(spark.range(10).withColumnRenamed("id", "k"), "small")

    def plan():
        return big.join(small, "k", "left")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "SortMergeJoin" in plan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_settled_relation_without_rows(spark, make):
    assert settle(make("a int").filter("a > 1"), "none").isEmpty()


def test_release_leaves_nothing_behind(spark, make):
    kept = settle(make("a int", (1,)), "left")
    files = [f.removeprefix("file://") for f in kept.inputFiles()]
    assert kept.count() == 1 and all(map(os.path.exists, files))
    release(spark)
    assert not any(map(os.path.exists, files))


class _Session:
    """What ``shared_dir`` asks a session for."""

    def __init__(self, setting=None, checkpoint=None):
        self.conf = SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" else default)
        self.sparkContext = SimpleNamespace(getCheckpointDir=lambda: checkpoint)


def test_shared_folder_has_no_default():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session())
    assert shared_dir(_Session("hdfs://x/y/")) == "hdfs://x/y" and shared_dir(_Session(None, "s3a://b/c")) == "s3a://b/c"


def test_scratch_owns_what_is_written_inside(spark, make):
    outside = settle(make("a int", (1,)), "outside")
    with scratch(spark) as outer:
        kept = settle(make("a int", (2,)), "x")
        with scratch(spark) as inner:
            assert inner.startswith(outer) and rows(settle(kept, "y")) == [(2,)]
            assert os.listdir(inner.removeprefix("file:"))
        assert not os.path.exists(inner.removeprefix("file:")) and rows(kept) == [(2,)]
    assert not os.path.exists(outer.removeprefix("file:")) and rows(outside) == [(1,)]
    with pytest.raises(ZeroDivisionError), scratch(spark) as failed:
        settle(outside, "z")
        1 / 0
    assert not os.path.exists(failed.removeprefix("file:"))
