"""Building blocks against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.operators import generators, relations
from opsloom.operators.intervals import count_in_intervals, join_in_interval, spread_over_stints
from opsloom.operators.panel import dense_months
from tests.conftest import one, rows

BASE = datetime(2020, 1, 1)


@pytest.mark.parametrize("hot", [0, 1])
def test_interval_counts_equal_brute_force_with_a_hot_key(make, hot):
    rng = random.Random(5 + hot)

    def moment():
        return BASE + timedelta(seconds=rng.randrange(0, 9 * 86400, 1800))

    # A third of the points on one key, many at equal times, some keys without points, NULL keys and times.
    points = [(7 if hot and i % 3 == 0 else rng.randrange(12), moment()) for i in range(1500)]
    points += [(None, BASE), (3, None)]
    spans = []
    for i in range(150):
        a, b = sorted((moment(), moment()))
        spans.append((i, rng.randrange(14), a, b))
    spans += [(200, 7, BASE, datetime(2999, 1, 1)), (201, 7, BASE + timedelta(days=5), BASE), (202, None, BASE, BASE),
              (203, 5, None, BASE), (204, 6, BASE, None), (205, 4, points[0][1], points[0][1])]
    got = count_in_intervals(
        make("i int, k int, a timestamp_ntz, b timestamp_ntz", *spans),
        make("k int, t timestamp_ntz", *points),
        key="k", start="a", stop="b", at="t", measures={"n": F.lit(1), "evens": F.when(F.hour("t") % 2 == 0, 1).otherwise(0)},
    )
    expected = {}
    for i, k, a, b in spans:
        inside = [t for p, t in points if None not in (k, p, t, a, b) and p == k and a <= t <= b]
        expected[i] = (len(inside), sum(t.hour % 2 == 0 for t in inside))
    assert {r.i: (r.n, r.evens) for r in got.collect()} == expected


def test_days_are_clipped_and_empty_stints_give_no_rows(make):
    df = make(
        "i int, s date, e date",
        (1, date(2020, 1, 1), date(2020, 1, 3)),   # ends before the look-back
        (2, date(2020, 1, 8), date(2020, 1, 11)),  # cut at the front
        (3, date(2020, 1, 19), date(2020, 2, 9)),  # cut at the back
        (4, date(2020, 1, 12), None),              # open end
        (5, None, date(2020, 1, 12)),              # open start
        (6, date(2020, 1, 15), date(2020, 1, 14)), # reversed
        (7, date(2020, 3, 1), date(2020, 3, 9)),   # not begun
    )
    got = rows(generators.explode_days(df, "s", "e", date(2020, 1, 10), date(2020, 1, 20)), "i", "index_date")
    assert got == [(2, date(2020, 1, 10)), (2, date(2020, 1, 11)), (3, date(2020, 1, 19)), (3, date(2020, 1, 20))]


def test_interval_join_is_inclusive_and_left_keeps_rows(make):
    spans = make("k int, s date, e date", (1, date(2020, 1, 1), date(2020, 1, 3)), (2, date(2020, 1, 1), None))
    facts = make("f int, d date", (1, date(2019, 12, 31)), (1, date(2020, 1, 1)), (1, date(2020, 1, 3)), (2, date(2020, 1, 2)))
    inner, left = (
        join_in_interval(spans, facts, key=F.col("k") == F.col("f"), at=F.col("d"), start=F.col("s"), end=F.col("e"), how=how)
        for how in ("inner", "left")
    )
    assert rows(inner, "k", "d") == [(1, date(2020, 1, 1)), (1, date(2020, 1, 3))]
    assert rows(left, "k", "d") == [(1, date(2020, 1, 1)), (1, date(2020, 1, 3)), (2, None)]


def test_spread_sums_equal_stints_together_and_overlaps_apart(make):
    stints = make(
        "a string, team string, date_team_start date, date_team_end date",
        ("x", "t1", date(2020, 1, 1), date(2020, 1, 9)), ("x", "t1", date(2020, 1, 1), date(2020, 1, 9)),
        ("x", "t2", date(2020, 1, 5), date(2020, 1, 9)),
    )
    daily = make("who string, day date, n int", ("x", date(2020, 1, 2), 10), ("x", date(2020, 1, 6), 1), ("y", date(2020, 1, 6), 5))
    start_end = ["date_team_start", "date_team_end"]
    for agent in (["a"], []):
        got = spread_over_stints(
            daily, stints, agent="who", stint_agent=F.col("a"), day="day", attributes=[*agent, "team", *start_end],
            measures=["n"], agent_in_attributes=bool(agent),
        )
        assert rows(got, "team", "day", "n") == [
            ("t1", date(2020, 1, 2), 20), ("t1", date(2020, 1, 6), 2), ("t2", date(2020, 1, 6), 1),
        ]


def test_group_values_match_null_keys_and_count_distinct(make):
    df = make("g string, h int, v int", ("a", 1, 1), ("a", 1, 1), ("a", 1, 2), (None, 1, 5), (None, 1, None), ("a", None, 9))
    got = relations.with_group_values(df, ["g", "h"], {"n": F.count_distinct("v"), "top": F.max("v")})
    assert rows(got) == sorted(
        [("a", 1, 1, 2, 2), ("a", 1, 1, 2, 2), ("a", 1, 2, 2, 2), (None, 1, 5, 1, 5), (None, 1, None, 1, 5), ("a", None, 9, 1, 9)],
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )


def test_clone_adds_exactly_the_matched_rows(make):
    df = make("e string, n int", ("a", 1), ("b", 2), ("b", 3), (None, 4))
    got = relations.clone_rows(df, F.col("e") == "b", {"e": "demo"})
    assert rows(got) == [(None, 4), ("a", 1), ("b", 2), ("b", 3), ("demo", 2), ("demo", 3)]


def test_union_is_by_position_and_widens(make):
    got = relations.union_by_position(make("a int, amount double", (1, 0.5)), make("amout int, x int", (2, 3)))
    assert got.columns == ["a", "amount"] and dict(got.dtypes)["amount"] == "double"
    assert rows(got) == [(1, 0.5), (2, 3.0)]


def test_allow_list_leaves_other_columns_out(make):
    df = make("id int, secret string, name string", (1, "s", "n"))
    assert relations.keep_only(df, ["id", "name"]).columns == ["id", "name"]
    assert relations.keep_only(df, ["id", "absent"], may_lack=["absent"]).columns == ["id"]
    with pytest.raises(ValueError, match="absent"):
        relations.keep_only(df, ["id", "absent"])


def test_dense_months_fill_every_month_and_ignore_months_outside(make):
    sparse = make(
        "e int, m date, n int", (1, date(2020, 1, 1), 3), (1, date(2020, 3, 1), 4), (1, date(2019, 11, 1), 9),
        (2, None, 0), (2, date(2020, 5, 1), 1),
    )
    got = dense_months(sparse, ["e"], "m", ["n"], [F.min("m").alias("first")], date(2020, 1, 15), date(2020, 3, 2))
    months = [date(2020, m, 1) for m in (1, 2, 3)]
    assert rows(got, "e", "index_month", "n", "first") == [
        (1, months[0], 3, date(2019, 11, 1)), (1, months[1], None, date(2019, 11, 1)), (1, months[2], 4, date(2019, 11, 1)),
        (2, months[0], None, date(2020, 5, 1)), (2, months[1], None, date(2020, 5, 1)), (2, months[2], None, date(2020, 5, 1)),
    ]
    assert one(got.agg(F.count(F.lit(1)).alias("n"))) == {"n": 6}


def test_equal_intervals_keep_their_rows(make):
    spans = make("k int, a timestamp_ntz, b timestamp_ntz", *[(1, datetime(2020, 1, 1), datetime(2020, 1, 3))] * 2)
    points = make("k int, t timestamp_ntz", (1, datetime(2020, 1, 2)))
    found = count_in_intervals(spans, points, key="k", start="a", stop="b", at="t", measures={"n": F.lit(1)})
    assert [r["n"] for r in found.collect()] == [1, 1]


def test_intervals_carry_no_arrays_from_one_join_to_the_next(make):
    """The totals of a key's whole history are looked up where they are met; rows that are shuffled again hold numbers."""
    intervals = make("user int, since timestamp, until timestamp", (1, datetime(2024, 1, 1), datetime(2024, 1, 3, 12)), (2, datetime(2024, 1, 1), None))
    points = make("user int, at timestamp", (1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 3, 12)), (1, datetime(2024, 1, 3, 13)))
    counted = count_in_intervals(intervals, points, key="user", start="since", stop="until", at="at", measures={"n": F.lit(1)})
    assert [(r["user"], r["n"]) for r in counted.orderBy("user").collect()] == [(1, 2), (2, 0)]
    plan, joins = counted._jdf.queryExecution().optimizedPlan(), 0
    while joins < 3:
        if plan.nodeName() == "Join":
            joins += 1
            assert "array" not in plan.children().apply(0).schema().simpleString()
        plan = plan.children().apply(0)
