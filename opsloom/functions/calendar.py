"""Dates, weeks, zones and text dates.

Instants are handled as UTC wall clock. ``as_of`` is always an explicit ``datetime.date``, so results
are reproducible and the bounds reach Catalyst as literals.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

# Fixed text formats of the source systems.
US_STAMP = "M/d/yyyy H:m:s"
ISO_STAMP = "yyyy-M-d H:m:s"
US_DATE = "M/d/yyyy"
ISO_DATE = "yyyy-M-d"

# Fixed stand-in for "never stops".
FAR_FUTURE = "2999-01-01 00:00:00"


def parse_us_stamp(text: Column) -> Column:
    """``month/day/year time`` text to a timestamp; bad text raises, NULL stays NULL."""
    return F.to_timestamp_ntz(text, F.lit(US_STAMP))


def parse_iso_stamp(text: Column) -> Column:
    """``year-month-day time`` text (a local wall clock without offset) to a timestamp."""
    return F.to_timestamp_ntz(text, F.lit(ISO_STAMP))


def parse_us_date(text: Column) -> Column:
    return F.to_date(text, US_DATE)


def parse_iso_date(text: Column) -> Column:
    return F.to_date(text, ISO_DATE)


def from_millis(ms: Column) -> Column:
    """Epoch milliseconds to UTC wall clock."""
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def local_date(ts: Column, zone: str) -> Column:
    """Calendar day of an instant in ``zone``."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")))


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def week_of(day: Column) -> Column:
    """Monday that starts the week of ``day``."""
    return F.trunc(day, "week")


def week_of_sunday_shift(day: Column) -> Column:
    """Monday week from Sunday weeks: shift a day back, go to Sunday, shift a day forward."""
    shifted = F.date_sub(day, 1)
    sunday = F.date_sub(shifted, F.dayofweek(shifted) - 1)
    return F.date_add(sunday, 1)


def days_before(as_of: date, days: int) -> date:
    return as_of - timedelta(days=days)


def months_before(day: Column, months: int) -> Column:
    """``months`` earlier, clipped to the month's last day (29 Feb minus a year is 28 Feb)."""
    return F.add_months(day, -months)


def stamp(text: str) -> Column:
    """Literal UTC wall clock. Python datetimes are not passed to ``lit``: that would go through the
    driver machine's own zone."""
    return F.lit(text).cast("timestamp_ntz")


def far_future() -> Column:
    return stamp(FAR_FUTURE)


def midnight(day: date) -> Column:
    """First instant of a UTC day: ``ts >= midnight(d)`` is ``date(ts) >= d`` in a pushable form."""
    return stamp(f"{day} 00:00:00")


def zone_floor(day: date) -> Column:
    """An instant at or before ``day`` begins in every zone; a pushable superset of a local-day filter."""
    return midnight(day - timedelta(days=1))


def millis(day: date) -> int:
    """Epoch milliseconds of a day's first UTC instant."""
    return (day - date(1970, 1, 1)).days * 86_400_000


def zone_floor_millis(day: date) -> int:
    return millis(day - timedelta(days=1))
