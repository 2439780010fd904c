"""Text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict_long(text: Column) -> Column:
    """Cast that fails the query on bad text (ANSI)."""
    return text.cast("bigint")


def strict_double(text: Column) -> Column:
    return text.cast("double")


def safe_long(text: Column) -> Column:
    """Whole-number text to bigint, anything else to NULL; ``'12.0'`` is not whole-number text."""
    return text.try_cast("bigint")


def safe_double(text: Column) -> Column:
    return text.try_cast("double")


def long_via_double(text: Column) -> Column:
    """``'123.0'`` to 123: through double, rounded half away from zero, NULL on bad text."""
    return F.round(text.try_cast("double")).try_cast("bigint")


def full_name(first: Column, last: Column) -> Column:
    """First and last name with a space; NULL when either is NULL."""
    return F.concat(first, F.lit(" "), last)


def first_token(text: Column, separator: str = " ") -> Column:
    return F.split_part(text, F.lit(separator), F.lit(1))


def last_char(value: Column) -> Column:
    return F.right(value.cast("string"), F.lit(1))
