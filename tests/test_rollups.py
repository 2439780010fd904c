"""Interval counts, day joins, bitmaps and bucketed tables against brute force, and the plans they promise."""

import os
import random
import re
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.operators.bitmaps import distinct_ids, id_bitmaps, rolled_up
from opsloom.operators.intervals import count_in_intervals, join_in_interval, join_on_days
from opsloom.plans import experiments, productivity, weekly
from opsloom.session import shared_dir
from opsloom.sources.tables import save_bucketed
from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moments(rng, n, keys, days=6):
    start = datetime(2020, 1, 1)
    return [(rng.choice(keys), start + timedelta(seconds=rng.choice([0, 1, 3600, 86399]) + 86400 * rng.randrange(days)) if rng.random() < 0.95 else None, rng.randrange(-5, 20)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_interval_counts_against_pairs(make, seed):
    rng = random.Random(seed)
    keys = [1, 2, 3, None, 7]
    points = moments(rng, 120, [1] * 6 + keys)  # key 1 is hot
    intervals = [(k, *[m for _, m, _ in moments(rng, 2, [0])], i % 3) for i in range(60) for k in [rng.choice([*keys, 9])]]
    intervals += intervals[:10]  # repeats
    got = count_in_intervals(
        make("k int, since timestamp_ntz, until timestamp_ntz, tag int", *intervals), make("k int, at timestamp_ntz, v int", *points),
        key="k", start="since", stop="until", at="at", measures={"n": F.lit(1), "total": F.col("v")},
    )
    want = []
    for k, a, b, tag in intervals:
        inside = [v for key, at, v in points if None not in (k, a, b, at) and key == k and a <= at <= b]
        want.append((k, a, b, tag, len(inside), sum(inside)))
    assert rows(got) == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert dict(got.dtypes)["n"] == "bigint"


def test_interval_counts_without_points_or_intervals(make):
    spans, points = make("k int, a timestamp_ntz, b timestamp_ntz", (1, datetime(2020, 1, 1), datetime(2020, 1, 2))), make("k int, at timestamp_ntz", (1, datetime(2020, 1, 1)))

    def count(left, right):
        return rows(count_in_intervals(left, right, key="k", start="a", stop="b", at="at", measures={"n": F.lit(1)}), "k", "n")

    assert count(spans, points) == [(1, 1)] and count(spans, points.filter("k > 1")) == [(1, 0)] and count(spans.filter("k > 1"), points) == []


def test_interval_counts_join_each_interval_once_per_look_up(spark, make):
    """A key with many days and many intervals: no join makes more rows than there are intervals."""
    start = datetime(2020, 1, 1)
    points = make("k int, at timestamp_ntz", *[(1, start + timedelta(days=i % 400, hours=i % 24)) for i in range(4000)])
    spans = make("k int, id int, a timestamp_ntz, b timestamp_ntz", *[(1, i, start, start + timedelta(days=i)) for i in range(300)])
    got = count_in_intervals(spans, points, key="k", start="a", stop="b", at="at", measures={"n": F.lit(1)})
    assert got.count() == 300
    joins = re.findall(r"\w+Join .*", plan_of(got))
    assert len(joins) == 3 and all("LeftOuter" in line and "NestedLoop" not in line for line in joins)
    assert got.orderBy("id").first()["n"] == sum(1 for i in range(4000) if i % 400 == 0 and i % 24 == 0)


def test_day_join_equals_the_interval_join(make):
    rng = random.Random(3)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(40))
    stints = [(rng.choice(["a", "a", "a", "b", None]), *sorted([day(), day()]), i) for i in range(80)] + [("a", None, day(), -1), ("b", day(), None, -2)]
    facts = [(rng.choice(["a", "a", "b", "c", None]), day() if i % 17 else None, i) for i in range(120)]
    left, right = make("agent string, s date, e date, stint int", *stints), make("owner string, d date, fact int", *facts)
    got = join_on_days(left, right, key="agent", fact_key="owner", day="d", start="s", end="e", first=date(2020, 1, 1), last=date(2020, 3, 1))
    want = join_in_interval(left, right, key=F.col("agent") == F.col("owner"), at=F.col("d"), start=F.col("s"), end=F.col("e"))
    assert got.columns == want.columns and rows(got) == rows(want)
    clipped = join_on_days(left, right, key="agent", fact_key="owner", day="d", start="s", end="e", first=date(2020, 1, 10), last=date(2020, 1, 12))
    assert rows(clipped) == rows(want.filter(F.col("d").between(date(2020, 1, 10), date(2020, 1, 12))))
    joins = re.findall(r"\w+Join \[.*", plan_of(got))
    plain = r"SortMergeJoin \[[^]]*\], \[[^]]*\], Inner|BroadcastHashJoin \[[^]]*\], \[[^]]*\], Inner, Build\w+, false"
    assert joins and all(re.fullmatch(plain, j) for j in joins), joins  # no condition beside the keys


def test_bitmaps_count_like_distinct(spark, make):
    rng = random.Random(5)
    data = [(rng.choice("xyz"), date(2020, 1, 1) + timedelta(days=rng.randrange(20)), rng.choice([None, 0, 1, 5, 32768, 32769, 70000, -3, -40000, rng.randrange(10**12)])) for _ in range(400)]
    df = make("g string, d date, id long", *data)
    daily = id_bitmaps(df, ["g", "d"], "id")
    assert "Expand" not in plan_of(distinct_ids(daily, ["g"], "n"))
    for keys in (["g", "d"], ["g"], ["d"], []):
        got = rows(distinct_ids(daily, keys, "n"))
        want = rows(df.filter("id is not null").groupBy(*keys).agg(F.count_distinct("id").alias("n")))
        assert got == want
    months = rows(distinct_ids(rolled_up(daily, ["g", F.trunc("d", "month").alias("m")]), ["m"], "n"))
    assert months == rows(df.filter("id is not null").groupBy(F.trunc("d", "month").alias("m")).agg(F.count_distinct("id").alias("n")))
    assert distinct_ids(id_bitmaps(df.filter("id is null"), ["g"], "id"), ["g"], "n").isEmpty()


def test_weekly_visitors_from_bitmaps(make):
    days = [date(2018, 1, 1) + timedelta(days=d) for d in range(21)]
    visits = make("visit_date date, partition_date date, visitor_pk long, ip_sessions int", *[(d, d, v, 99 + (v == 3)) for d in days for v in (1, 2, 3, d.day)])
    plain = weekly.weekly_visitors(visits, start=date(2018, 1, 5))
    assert rows(weekly.weekly_visitors_from_bitmaps(weekly.visitor_bitmaps(visits, start=date(2018, 1, 5)))) == rows(plain)


def test_bucketed_scorecards_are_grouped_without_a_shuffle(spark, make, tmp_path):
    card = make(
        "emp_lvl string, email_address string, manager_name string, index_date date, closed_cases int, total_lops_time long, lunch_time long",
        *[("1" if i % 5 else "2", f"a{i % 7}@x", ("IBEX", "Partner", "M", None)[i % 4], date(2020, 1, 1 + i % 9), i, 600 * i, 60) for i in range(200)],
    )
    table = f"cards_{uuid.uuid4().hex[:8]}"
    save_bucketed(card, table, by=["index_date"], buckets=4, path=str(tmp_path / "cards"))
    assert len([f for f in os.listdir(tmp_path / "cards") if f.endswith(".parquet")]) <= 4
    stored = productivity.phone_team_days(spark.table(table), excluded_emails=["a1@x"], surveys=False)
    assert "Exchange" not in plan_of(stored)
    assert rows(stored) == rows(productivity.phone_team_days(card, excluded_emails=["a1@x"], surveys=False))
    spark.sql(f"DROP TABLE {table}")


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    card = spark.range(0, 40000, 1, 8).select(F.lit(date(2020, 1, 6)).alias("index_date"), F.xxhash64("id").alias("n"))
    table, key = f"cards_{uuid.uuid4().hex[:8]}", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "32k")
    try:
        save_bucketed(card, table, by=["index_date"], buckets=4, path=str(tmp_path / "cards"))
    finally:
        spark.conf.set(key, before)
    assert len([f for f in os.listdir(tmp_path / "cards") if f.endswith(".parquet")]) > 1
    days = spark.table(table).groupBy("index_date").agg(F.count("*").alias("n"), F.sum(F.col("n").cast("decimal(38)")).alias("s"))
    assert "Exchange" not in plan_of(days)
    assert rows(days) == rows(card.groupBy("index_date").agg(F.count("*").alias("n"), F.sum(F.col("n").cast("decimal(38)")).alias("s")))
    spark.sql(f"DROP TABLE {table}")


def test_team_labels_are_arguments(make):
    card = make(
        "emp_lvl string, email_address string, manager_name string, index_date date, closed_cases int, total_lops_time long, lunch_time long",
        ("L1", "a@x", "North", date(2020, 1, 6), 2, 120, 0), ("L1", "b@x", "South", date(2020, 1, 6), 3, 60, 0), ("L1", "c@x", None, date(2020, 1, 6), 5, 60, 0), ("1", "d@x", None, date(2020, 1, 6), 7, 60, 0),
    )
    days = productivity.phone_team_days(card, excluded_emails=[], surveys=False, outsourced=["North", "South"], in_house="Home", level="L1")
    assert rows(days, "team_name", "closed_cases") == [("Home", 5), ("North", 2), ("South", 3)]
    week = weekly.weekly_cases_per_hour(days, {"partners": ["North", "South"], "home": ["Home"]})
    assert rows(week, "cases_partners", "cases_home", "cases_total_team") == [(5, 5, 10)]


def test_request_datasets_write_nothing_and_run_no_job(spark, make):
    assigned = make("experiment_id string, bucket_id string, request_id int, assignment_time long, experiment_stop_time long", ("e", "b", 1, 10, 99), ("e", "c", 2, 20, None))
    quotes = make("request_id int, pro_user_id long, customer_id long", (1, 5, 6), (2, 5, 5))
    folder = f"{shared_dir(spark).removeprefix('file:')}/opsloom/{spark.conf.get('spark.app.id')}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    spark.sparkContext.setJobGroup("building", "plans only")
    frames = [experiments.request_exposure(assigned, quotes), experiments.unified_exposure(assigned, quotes)]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [f.count() for f in frames] == [4, 3]
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before
