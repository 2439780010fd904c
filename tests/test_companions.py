"""Typed companions: what they keep, what a look-back reads, and that plans accept them."""

from datetime import date

import pytest

from opsloom.functions.calendar import ISO_STAMP
from opsloom.sources.companions import save_companion, touched_on, touched_since
from tests.conftest import rows

SOURCE = [
    (1, "2018-01-01 08:00:00", "2018-01-02 09:00:00"), (2, "2018-01-05 23:59:59", None), (3, None, None),
    (4, "2018-01-03 00:00:00", "2018-01-09 10:00:00"), (5, None, "2018-01-07 00:00:00"), (6, "2018-1-9 1:2:3", None),
]


@pytest.fixture
def companion(make, tmp_path):
    path = str(tmp_path / "companion")
    save_companion(
        make("id int, opened string, closed string", *SOURCE), path,
        formats={"opened": ISO_STAMP, "closed": ISO_STAMP}, touched=["opened", "closed"],
    )
    return path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_back_reads_later_partitions_only(spark, companion):
    files = {}
    for day, ids in ((date(2018, 1, 1), [1, 2, 4, 5, 6]), (date(2018, 1, 5), [2, 4, 5, 6]), (date(2018, 1, 8), [4, 6]), (date(2019, 1, 1), [])):
        found = touched_since(spark, companion, day)
        assert [r[0] for r in rows(found, "id")] == ids
        assert dict(found.dtypes) == {"id": "int", "opened": "timestamp_ntz", "closed": "timestamp_ntz"}
        assert "PartitionFilters: [isnotnull(touched_day" in plan_of(found)
        files[day] = len(found.inputFiles())
    read = {d: touched_since(spark, companion, d)._jdf.queryExecution().executedPlan() for d in files}
    for p in read.values():
        p.executeCollect()
    counts = [int(p.collectLeaves().head().metrics().get("numFiles").get().value()) for p in map(_scanned, read.values())]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] > counts[3] == 0


def _scanned(plan):
    return plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.toString() else plan


def test_days_of_another_relation_prune_at_run_time(spark, make, companion):
    days = make("d date, kind string", (date(2018, 1, 9), "x"), (date(2018, 1, 9), "x"), (date(2018, 1, 5), "y"), (None, "x"))
    found = touched_on(spark, companion, days.filter("kind = 'x'"), "d")
    assert [r[0] for r in rows(found, "id")] == [4, 6]
    assert "dynamicpruning" in plan_of(found)


def test_bad_text_stops_the_load(make, tmp_path):
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|could not be parsed"):
        save_companion(make("a string", ("soon",)), str(tmp_path / "x"), formats={"a": ISO_STAMP}, touched=["a"])


def test_empty_source(spark, make, tmp_path):
    path = str(tmp_path / "none")
    save_companion(make("a string, n int").filter("n > 0"), path, formats={"a": ISO_STAMP}, touched=["a"])
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        touched_since(spark, path, date(2018, 1, 1))
