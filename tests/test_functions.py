"""Column helpers, with the NULL, zone and rounding cases that are easy to get wrong."""

import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.functions import calendar as cal, casts, conditions as cond, measures as ms
from opsloom.operators import generators
from tests.conftest import one, rows


def test_text_ids_round_through_double(make):
    df = make("v string", ("123.0",), ("12.5",), ("12.4",), ("-0.5",), ("x",), ("",), (None,))
    got = {r.v: r.n for r in df.select("v", casts.long_via_double(F.col("v")).alias("n")).collect()}
    assert got == {"123.0": 123, "12.5": 13, "12.4": 12, "-0.5": -1, "x": None, "": None, None: None}


def test_safe_casts_give_null_and_strict_casts_fail(make):
    df = make("v string", ("12",), ("12.0",), ("x",), (None,))
    assert rows(df.select("v", casts.safe_long(F.col("v")), casts.safe_double(F.col("v")))) == sorted(
        [("12", 12, 12.0), ("12.0", None, 12.0), ("x", None, None), (None, None, None)],
        key=lambda r: (r[0] is not None, str(r[0])),
    )
    for strict in (casts.strict_long, casts.strict_double):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            df.select(strict(F.col("v"))).collect()


def test_text_stamps_take_one_and_two_digits_and_fail_on_bad_text(make):
    df = make("us string, iso string", ("1/5/2018 3:04:05", "2018-1-5 3:04:05"), ("01/05/2018 03:04:05", "2018-01-05 03:04:05"), (None, None))
    stamp = datetime(2018, 1, 5, 3, 4, 5)
    got = rows(df.select(cal.parse_us_stamp(F.col("us")), cal.parse_iso_stamp(F.col("iso"))))
    assert got == [(None, None), (stamp, stamp), (stamp, stamp)]
    for bad in ("2018-13-40", ""):
        with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
            make("v string", (bad,)).select(cal.parse_iso_stamp(F.col("v"))).collect()


@pytest.mark.parametrize(
    ("moment", "denver", "manila"),
    [
        (datetime(2018, 1, 15, 6, 59, 59), date(2018, 1, 14), date(2018, 1, 15)),
        (datetime(2018, 1, 15, 7, 0, 0), date(2018, 1, 15), date(2018, 1, 15)),
        (datetime(2018, 7, 15, 5, 59, 59), date(2018, 7, 14), date(2018, 7, 15)),
        (datetime(2018, 7, 15, 6, 0, 0), date(2018, 7, 15), date(2018, 7, 15)),
        (datetime(2018, 7, 15, 15, 59, 59), date(2018, 7, 15), date(2018, 7, 15)),
        (datetime(2018, 7, 15, 16, 0, 0), date(2018, 7, 15), date(2018, 7, 16)),
    ],
)
def test_day_boundaries_by_zone_winter_and_summer(make, moment, denver, manila):
    for kind in ("timestamp_ntz", "timestamp"):
        df = make("t timestamp_ntz", (moment,)).select(F.col("t").cast(kind).alias("t"))
        got = one(df.select(
            cal.local_date(F.col("t"), "America/Denver").alias("d"), cal.local_date(F.col("t"), "Asia/Manila").alias("m"),
            cal.utc_date(F.col("t")).alias("u"),
        ))
        assert got == {"d": denver, "m": manila, "u": moment.date()}


def test_monday_week_equals_shifted_sunday_week(spark):
    days = generators.day_spine(spark, date(2016, 12, 20), date(2019, 1, 10))
    assert days.count() == (date(2019, 1, 10) - date(2016, 12, 20)).days + 1
    day = F.col("index_date")
    assert days.filter(cal.week_of(day) != cal.week_of_sunday_shift(day)).isEmpty()
    assert days.filter(F.dayofweek(cal.week_of(day)) != 2).isEmpty()


def test_month_arithmetic_clips_to_month_end(make):
    df = make("d date", (date(2020, 2, 29),), (date(2019, 8, 31),))
    got = rows(df.select("d", cal.months_before(F.col("d"), 12), cal.months_before(F.col("d"), 6)))
    assert got == [
        (date(2019, 8, 31), date(2018, 8, 31), date(2019, 2, 28)),
        (date(2020, 2, 29), date(2019, 2, 28), date(2019, 8, 29)),
    ]


def test_month_spine_covers_partial_months(spark):
    got = [r[0] for r in rows(generators.month_spine(spark, date(2015, 12, 17), date(2016, 2, 1)))]
    assert got == [date(2015, 12, 1), date(2016, 1, 1), date(2016, 2, 1)]


def test_null_flags(make):
    df = make("f boolean", (True,), (False,), (None,))
    got = {
        r.f: (r.a, r.b, r.c, r.d)
        for r in df.select(
            "f", cond.is_true(F.col("f")).alias("a"), cond.is_false(F.col("f")).alias("b"),
            (F.col("f") == F.lit(False)).alias("c"), F.when(F.col("f") == F.lit(False), 1).otherwise(0).alias("d"),
        ).collect()
    }
    assert got == {True: (True, False, False, 0), False: (False, True, True, 1), None: (False, False, None, 0)}


def test_not_in_drops_or_keeps_null(make):
    df = make("c string", ("a",), ("b",), (None,))
    assert rows(df.filter(cond.not_in(F.col("c"), ["a"]))) == [("b",)]
    assert rows(df.filter(cond.not_in_or_null(F.col("c"), ["a"]))) == [(None,), ("b",)]
    assert rows(df.filter(cond.in_not_null(F.col("c"), ["a"]))) == [("a",)]


def test_full_name_needs_both_parts(make):
    df = make("a string, b string", ("Ada", "Low"), ("Ada", None), (None, "Low"))
    assert rows(df.select(casts.full_name(F.col("a"), F.col("b")))) == [(None,), (None,), ("Ada Low",)]


def test_measures_on_empty_scope_and_nulls(make):
    df = make("k int, s int", (1, 5), (1, 4), (1, None), (1, 2), (2, None))
    got = rows(df.groupBy("k").agg(
        ms.top_two_rate(F.col("s")).alias("rate"),
        ms.top_two_rate(F.col("s"), F.col("k") == 9).alias("empty"),
        ms.sum_when(F.col("s") == 4, F.col("s")).alias("fours"),
        ms.count_when(F.col("s") == 4).alias("n"),
        *ms.score_histogram(F.col("s"), "x"),
    ))
    assert got == [(1, 2 / 3, None, 4, 1, 3, 2, 1, 1, 0, 1, 0), (2, None, None, 0, 0, 0, 0, 0, 0, 0, 0, 0)]


def test_ratio_rounds_half_away_from_zero(make):
    df = make("a int, b int", (5, 2), (-1, 2), (1, 3))
    assert rows(df.select(F.round(F.col("a") / F.col("b"), 0))) == sorted([(3.0,), (-1.0,), (0.0,)], key=lambda r: str(r[0]))


def test_zone_floor_never_cuts_a_local_day(make):
    lower = date(2018, 3, 11)
    hours = [(datetime(2018, 3, 9) + timedelta(hours=h),) for h in range(96)]
    df = make("t timestamp_ntz", *hours)
    for zone in ("America/Denver", "Asia/Manila", "Pacific/Kiritimati", "Pacific/Pago_Pago"):
        kept = df.filter(cal.local_date(F.col("t"), zone) >= F.lit(lower))
        assert kept.filter(F.col("t") < cal.zone_floor(lower)).isEmpty()


def test_literals_do_not_depend_on_the_machine_zone(spark, monkeypatch):
    monkeypatch.setenv("TZ", "America/Denver")
    time.tzset()
    try:
        got = spark.range(1).select(
            cal.midnight(date(2018, 7, 1)).cast("string").alias("m"), cal.zone_floor(date(2018, 7, 1)).cast("string").alias("z"),
            F.lit(date(2018, 7, 1)).cast("string").alias("d"), cal.from_millis(F.lit(cal.millis(date(2018, 7, 1)))).cast("string").alias("i"),
        )
        assert one(got) == {
            "m": "2018-07-01 00:00:00", "z": "2018-06-30 00:00:00", "d": "2018-07-01", "i": "2018-07-01 00:00:00",
        }
    finally:
        monkeypatch.undo()
        time.tzset()
