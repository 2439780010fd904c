"""CSV feeds: positions, blanks, quoted newlines, wrong widths, once-only loading."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from opsloom.sources import feeds, tables
from opsloom.streaming.feeds import load_arrived
from tests.conftest import rows


def write_feed(folder, name, feed, *records, width=None):
    os.makedirs(folder, exist_ok=True)
    columns = feeds.FEEDS[feed][1]
    with open(os.path.join(folder, name), "w", newline="") as f:
        out = csv.writer(f)
        out.writerow([f"Header {i}" for i in range(len(columns))])
        for record in records:
            line = [record.get(c, "") for c in columns]
            out.writerow(line[:width] if width and width < len(line) else line + ["extra"] * ((width or len(line)) - len(line)))


@pytest.fixture
def inbox(tmp_path):
    return str(tmp_path / "inbox")


def test_feed_widths():
    assert [len(columns) for _, columns in feeds.FEEDS.values()] == [43, 119]
    assert feeds.STATUS_COLUMNS[0] == "agent" and feeds.STATUS_COLUMNS[-1] == "after_call_work_time"
    assert feeds.CALL_COLUMNS[0] == "date" and feeds.CALL_COLUMNS[-1] == "custom_queue"
    assert all(len(set(c)) == len(c) for _, c in feeds.FEEDS.values())


def test_routing_positions_blanks_and_newlines(spark, inbox):
    write_feed(inbox, "Status Log - 1.csv", "status", {"agent": "a", "date": "007", "reason_code": 'two\n"lines"'}, {"agent": "b"})
    write_feed(inbox, "Status Log - 2.csv", "status", {"agent": "c", "state": "Ready"})
    write_feed(inbox, "Call Log.csv", "call", {"call_id": "9", "custom_queue": "q"})
    write_feed(inbox, "Other.csv", "call", {"call_id": "10"})
    status = feeds.read_feed(spark, inbox, "status")
    assert status.columns == [*feeds.STATUS_COLUMNS, feeds.LINEAGE]
    assert all(kind == "string" for _, kind in status.dtypes)
    assert rows(status, "agent", "date", "reason_code", "state") == [
        ("a", "007", 'two\n"lines"', None), ("b", None, None, None), ("c", None, None, "Ready"),
    ]
    assert rows(feeds.read_feed(spark, inbox, "call"), "call_id", "custom_queue", "date") == [("9", "q", None)]
    files = {os.path.basename(r[0]) for r in rows(status.select(feeds.LINEAGE).distinct())}
    assert files == {"Status%20Log%20-%201.csv", "Status%20Log%20-%202.csv"}


@pytest.mark.parametrize("width", [42, 44])
def test_wrong_width_fails_even_when_few_columns_are_read(spark, inbox, width):
    write_feed(inbox, "Stat.csv", "status", {"agent": "a"}, width=width)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        feeds.read_feed(spark, inbox, "status").select("agent").collect()


def test_batch_load_appends_and_repeats(spark, inbox, tmp_path):
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"})
    target = str(tmp_path / "target")
    for expected in (1, 2):
        feeds.load_feed(spark, inbox, "status", target)
        assert tables.read_dataset(spark, target).count() == expected


def test_stream_loads_each_file_once(spark, inbox, tmp_path):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"}, {"agent": "b"})
    write_feed(inbox, "Call 1.csv", "call", {"call_id": "1"})
    assert load_arrived(spark, inbox, "status", target, state) == 1
    assert load_arrived(spark, inbox, "status", target, state) == 0
    write_feed(inbox, "Stat 2.csv", "status", {"agent": "c"})
    assert load_arrived(spark, inbox, "status", target, state, files_per_batch=1) == 1
    assert rows(tables.read_dataset(spark, target), "agent") == [("a",), ("b",), ("c",)]


def test_partitioned_dataset_is_pruned(spark, make, tmp_path):
    from datetime import date

    path = str(tmp_path / "visits")
    days = [date(2018, 1, d) for d in range(1, 9)]
    tables.save_dataset(make("day date, n int", *[(d, i) for i, d in enumerate(days)]), path, partition_by="day")
    late = tables.read_since(spark, path, "day", days[6])
    assert rows(late.select("day", "n")) == [(days[6], 6), (days[7], 7)]
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "DataFilters: []" in plan


def test_view_table_and_sorted_output(spark, make, tmp_path):
    df = make("a int, b string", (2, "x"), (1, "y"), (3, "x"))
    assert rows(tables.register_view(df.filter("a > 1"), "small_view")) == [(2, "x"), (3, "x")]
    assert [tuple(r) for r in tables.present(df, ("b", False), "a").collect()] == [(1, "y"), (2, "x"), (3, "x")]
    name = "appended_" + os.path.basename(str(tmp_path)).replace("-", "_")
    for _ in range(2):
        tables.append_table(df, name, path=str(tmp_path / "appended"))
    assert spark.table(name).count() == 6
    assert df.filter(F.col("a") == 9).isEmpty()


def test_stream_waits_for_the_first_file(spark, inbox, tmp_path):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"})
    assert load_arrived(spark, inbox, "call", target, state) == 0
    write_feed(inbox, "Call 1.csv", "call", {"call_id": "1"})
    assert load_arrived(spark, inbox, "call", target, state) == 1
    assert rows(tables.read_dataset(spark, target), "call_id") == [("1",)]


def test_broken_file_stops_the_stream_and_loads_nothing_of_its_batch(spark, inbox, tmp_path):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"}, width=40)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|STREAM_FAILED"):
        load_arrived(spark, inbox, "status", target, state)
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"})  # repaired in place
    load_arrived(spark, inbox, "status", target, state)
    assert rows(tables.read_dataset(spark, target), "agent") == [("a",)]


def test_all_feeds_of_an_inbox(spark, inbox, tmp_path):
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"})
    write_feed(inbox, "Call 1.csv", "call", {"call_id": "1"}, {"call_id": "2"})
    targets = {feed: str(tmp_path / feed) for feed in feeds.FEEDS}
    feeds.load_feeds(spark, inbox, targets)
    assert {f: tables.read_dataset(spark, t).count() for f, t in targets.items()} == {"status": 1, "call": 2}


@pytest.mark.parametrize("stream_first", [False, True])
def test_batch_and_stream_share_one_dataset(spark, inbox, tmp_path, stream_first):
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"})
    loads = [lambda: load_arrived(spark, inbox, "status", target, state), lambda: feeds.load_feed(spark, inbox, "status", target)]
    for load in loads if stream_first else loads[::-1]:
        load()
    write_feed(inbox, "Stat 2.csv", "status", {"agent": "b"})
    load_arrived(spark, inbox, "status", target, state)
    assert rows(tables.read_dataset(spark, target), "agent") == [("a",), ("a",), ("b",)]


def test_many_batches_are_all_counted(spark, inbox, tmp_path):
    for i in range(104):
        write_feed(inbox, f"Stat {i}.csv", "status", {"agent": str(i)})
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    assert load_arrived(spark, inbox, "status", target, state, files_per_batch=1) == 104
    assert tables.read_dataset(spark, target).count() == 104
