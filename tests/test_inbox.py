"""One stream for all feeds: named tables, once each, nothing of a load before it is complete."""

import os
import uuid

import pytest

from opsloom.streaming import inbox as loads
from tests.conftest import rows
from tests.test_feeds import write_feed


@pytest.fixture
def place(spark, tmp_path):
    """(inbox, tables, log, checkpoint) with fresh tables."""
    mark = uuid.uuid4().hex[:8]
    tables, log = {"status": f"status_{mark}", "call": f"calls_{mark}"}, f"loads_{mark}"
    loads.make_feed_tables(spark, tables, log, folder=str(tmp_path / "tables"))
    yield str(tmp_path / "inbox"), tables, log, str(tmp_path / "state")
    for table in [*tables.values(), log]:
        spark.sql(f"DROP TABLE {table}")


def seen(spark, tables, log):
    keys = {"status": "agent", "call": "call_id"}
    return {feed: [r[0] for r in rows(loads.read_published(spark, table, log), keys[feed])] for feed, table in tables.items()}


def deliver(inbox, number):
    write_feed(inbox, f"Stat {number}.csv", "status", {"agent": f"a{number}"}, {"agent": f"b{number}"})
    write_feed(inbox, f"Call {number}.csv", "call", {"call_id": str(number)})


def test_both_feeds_in_one_call_once_each(spark, place):
    inbox, tables, log, state = place
    deliver(inbox, 1)
    write_feed(inbox, "Other.csv", "call", {"call_id": "0"})
    assert loads.load_inbox(spark, inbox, tables, log, state) == 1
    assert loads.load_inbox(spark, inbox, tables, log, state) == 0
    deliver(inbox, 2)
    write_feed(inbox, "Stat [x] {y}*?.csv", "status", {"agent": "odd"})
    os.makedirs(f"{inbox}/Call folder.csv")
    write_feed(f"{inbox}/Call folder.csv", "part-0.csv", "call", {"call_id": "3"})
    assert loads.load_inbox(spark, inbox, tables, log, state, files_per_batch=2) >= 2
    assert seen(spark, tables, log) == {"status": ["a1", "a2", "b1", "b2", "odd"], "call": ["1", "2", "3"]}
    write_feed(inbox, "Stat *.csv", "status", {"agent": "star"})
    loads.load_inbox(spark, inbox, tables, log, state)
    assert [r for r, in rows(spark.table(tables["status"]), "agent")] == ["a1", "a2", "b1", "b2", "odd", "star"]


@pytest.mark.parametrize("order", [("status", "call"), ("call", "status")])
@pytest.mark.parametrize("cut", ["between feeds", "before the marker", "after the marker"])
def test_a_load_cut_short_and_tried_again_gives_each_row_once(spark, place, monkeypatch, order, cut):
    inbox, tables, log, state = place
    tables = {feed: tables[feed] for feed in order}
    deliver(inbox, 1)
    assert loads.load_inbox(spark, inbox, tables, log, state) == 1
    deliver(inbox, 2)
    before = {"status": ["a1", "b1"], "call": ["1"]}

    with monkeypatch.context() as broken:
        write, publish, calls = loads.write_load, loads.publish, []

        def failing_write(*args):
            calls.append(args)
            if len(calls) == 2 and cut == "between feeds":
                raise RuntimeError("killed")
            write(*args)

        def failing_publish(*args):
            if cut == "after the marker":
                publish(*args)
            raise RuntimeError("killed")

        broken.setattr(loads, "write_load", failing_write)
        broken.setattr(loads, "publish", failing_publish)
        with pytest.raises(Exception, match="killed|STREAM_FAILED"):
            loads.load_inbox(spark, inbox, tables, log, state)
        assert seen(spark, tables, log) == (before if cut != "after the marker" else {"status": ["a1", "a2", "b1", "b2"], "call": ["1", "2"]})
    loads.load_inbox(spark, inbox, tables, log, state)
    assert seen(spark, tables, log) == {"status": ["a1", "a2", "b1", "b2"], "call": ["1", "2"]}
    # the table itself holds each row once as well
    assert [r[0] for r in rows(spark.table(tables["status"]), "agent")] == ["a1", "a2", "b1", "b2"]


@pytest.mark.parametrize("stream_first", [False, True])
def test_tables_take_batch_and_stream_loads(spark, place, stream_first):
    inbox, tables, log, state = place
    deliver(inbox, 1)
    other = inbox + "-2"
    deliver(other, 2)
    steps = [
        lambda: loads.load_inbox(spark, inbox, tables, log, state),
        lambda: loads.load_files(spark, other, [f"{other}/{f}" for f in os.listdir(other)], tables, log, "first-of-may"),
    ]
    for step in steps if stream_first else steps[::-1]:
        step()
    assert steps[1]() is None  # published before
    assert seen(spark, tables, log) == {"status": ["a1", "a2", "b1", "b2"], "call": ["1", "2"]}
    assert spark.table(tables["call"]).count() == 2


def test_tables_are_found_again_after_their_names_are_lost(spark, place, tmp_path):
    inbox, tables, log, state = place
    deliver(inbox, 1)
    loads.load_inbox(spark, inbox, tables, log, state)
    for table in [*tables.values(), log]:
        spark.sql(f"DROP TABLE {table}")
    loads.make_feed_tables(spark, tables, log, folder=str(tmp_path / "tables"))
    deliver(inbox, 2)
    loads.load_inbox(spark, inbox, tables, log, state)
    assert seen(spark, tables, log) == {"status": ["a1", "a2", "b1", "b2"], "call": ["1", "2"]}


def test_broken_file_publishes_nothing_of_its_load(spark, place):
    inbox, tables, log, state = place
    write_feed(inbox, "Stat 1.csv", "status", {"agent": "a"})
    write_feed(inbox, "Call 1.csv", "call", {"call_id": "1"}, width=100)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|STREAM_FAILED"):
        loads.load_inbox(spark, inbox, tables, log, state)
    assert seen(spark, tables, log) == {"status": [], "call": []}
