"""Joins of keyed moments with keyed intervals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.operators.generators import explode_days


def join_in_interval(
    intervals: DataFrame,
    facts: DataFrame,
    *,
    key: Column,
    at: Column,
    start: Column,
    end: Column,
    how: str = "inner",
) -> DataFrame:
    """Equi-join on ``key`` with ``start <= at <= end`` as the residual of the hash or merge join.

    Broadcast or sort-merge is left to the statistics; AQE splits a hot key of the larger side.
    """
    return intervals.join(facts, key & at.between(start, end), how)


def join_on_days(
    intervals: DataFrame, facts: DataFrame, *, key: str, fact_key: str, day: str, start: str, end: str, first: date, last: date
) -> DataFrame:
    """Inner join of facts with the intervals of their key that cover their day, for days from ``first`` to ``last``.

    Intervals become one row per day, so key and day are both equi-keys: no row is compared with an
    interval that does not cover it, however many intervals or facts a key has, and a hot key is dealt
    out by its days. Worth it where a key has many intervals; with a few, ``join_in_interval`` moves less.
    """
    days = explode_days(intervals, start, end, first, last, "_covered_day")
    covered = days.join(facts, (F.col(key) == F.col(fact_key)) & (F.col("_covered_day") == F.col(day)))
    return covered.drop("_covered_day")


def spread_over_stints(
    daily: DataFrame,
    stints: DataFrame,
    *,
    agent: str,
    stint_agent: Column,
    day: str,
    attributes: Sequence[str],
    measures: Sequence[str],
    start: str = "date_team_start",
    end: str = "date_team_end",
    agent_in_attributes: bool = True,
) -> DataFrame:
    """Attach measures already summed per agent and day to the stints that cover the day.

    ``daily`` holds one row per agent and day, so a hot agent reaches this join as a few rows, however
    many raw rows it has. Equal stints listed several times are counted first and multiply the sums, as
    a join of raw rows would. When ``attributes`` determine the agent the result needs no second
    aggregation; otherwise (``agent_in_attributes=False``) the agents of equal attributes are summed.
    """
    listed = stints.groupBy(*attributes, stint_agent.alias("_agent")).agg(F.count(F.lit(1)).alias("_times"))
    covered = join_in_interval(
        listed.alias("s"),
        daily.alias("d"),
        key=F.col("s._agent") == F.col(f"d.{agent}"),
        at=F.col(f"d.{day}"),
        start=F.col(f"s.{start}"),
        end=F.col(f"s.{end}"),
    ).select(
        *[F.col(f"s.{a}").alias(a) for a in attributes],
        F.col(f"d.{day}").alias(day),
        *[(F.col(f"d.{m}") * F.col("s._times")).alias(m) for m in measures],
    )
    if agent_in_attributes:
        return covered
    return covered.groupBy(*attributes, day).agg(*[F.sum(m).alias(m) for m in measures])


def _leading(entries: Column, holds: Callable[[Column], Column]) -> Column:
    """How many leading entries of a sorted array hold, by binary search; 0 for a NULL array."""
    size = F.coalesce(F.size(entries), F.lit(0))
    steps = F.transform(
        F.sequence(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)),
        lambda j: F.call_function("shiftleft", F.lit(1), j),
    )
    return F.aggregate(
        steps, F.lit(0), lambda found, step: F.when((found + step <= size) & holds(F.get(entries, found + step - 1)), found + step).otherwise(found)
    )


def _latest(entries: str, holds: Callable[[Column], Column]) -> Column:
    """The last of the leading entries that hold; NULL when there is none."""
    return F.get(entries, _leading(F.col(entries), holds) - 1)


def running_totals(sums: DataFrame, keys: Sequence[str], at: str, measures: Sequence[str]) -> DataFrame:
    """One row per key with ``totals``: its moments in order, each with the sums up to and with it.

    ``sums`` has one row per key and moment, so the arrays hold one entry per different moment of a key.
    """
    upto = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select(*keys, at, *[F.sum(m).over(upto).alias(m) for m in measures])
    return running.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, *measures))).alias("totals"))


def count_in_intervals(
    intervals: DataFrame,
    points: DataFrame,
    *,
    key: str,
    start: str,
    stop: str,
    at: str,
    measures: Mapping[str, Column],
) -> DataFrame:
    """For each interval row, sums of ``measures`` over the points of its key with ``start <= at <= stop``.

    Points become running totals on two levels: per key over its days, and per key and day over that
    day's different moments. An interval looks up its key once and the days of its two ends, finds its
    places by binary search, and takes the total up to its stop less the total before its start. So every
    join has as many rows as there are intervals, however many points a key holds, only the entries found
    go on to the next join, and no array holds more than the days of the history or the moments of a day. Measures are exact numbers (integers or
    decimals), as totals are subtracted. Intervals without points, without a key or an end, or that stop
    before they start, keep their row with zeros.
    """
    columns, names = intervals.columns, list(measures)
    pts = (
        points.select(F.col(key).alias("_key"), F.to_date(at).alias("_day"), F.col(at).alias("_at"), *[m.alias(n) for n, m in measures.items()])
        .filter(F.col("_key").isNotNull() & F.col("_day").isNotNull())
        .groupBy("_key", "_day", "_at").agg(*[F.sum(n).alias(n) for n in names])
    )
    moments = running_totals(pts, ["_key", "_day"], "_at", names)
    per_day = moments.select("_key", "_day", *[F.element_at("totals", -1).getField(n).alias(n) for n in names])
    days = running_totals(per_day, ["_key"], "_day", names).select("_key", F.col("totals").alias("_days"))

    first, last = F.to_date(start), F.to_date(stop)
    looked_up = intervals.join(days, F.col(key) == F.col("_key"), "left").select(
        *columns,
        _latest("_days", lambda e: e.getField("_day") < first).alias("_days_before"),
        _latest("_days", lambda e: e.getField("_day") < last).alias("_days_upto"),
    )
    ends = (("_before", first, lambda e: e.getField("_at") < F.col(start)), ("_upto", last, lambda e: e.getField("_at") <= F.col(stop)))
    for place, day, holds in ends:
        on_day = moments.select(F.col("_key").alias("_k"), F.col("_day").alias("_d"), F.col("totals").alias("_moments"))
        looked_up = looked_up.join(on_day, (F.col(key) == F.col("_k")) & (day == F.col("_d")), "left").select(
            *looked_up.columns, _latest("_moments", holds).alias(place)
        )

    def total(entry: str, name: str) -> Column:
        return F.coalesce(F.col(entry).getField(name), F.lit(0))

    def inside(name: str) -> Column:
        upto = total("_days_upto", name) + total("_upto", name)
        before = total("_days_before", name) + total("_before", name)
        return F.when(F.col(start) <= F.col(stop), upto - before).otherwise(0).alias(name)

    return looked_up.select(*columns, *[inside(n) for n in names])
