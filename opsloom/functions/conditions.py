"""Predicates with their NULL behaviour spelled out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, functions as F

from opsloom.functions.calendar import far_future

# The contact channels that count as support contacts.
CHANNELS = ("Phone", "Email", "Chat", "SMS", "Directly Question", "In-Product")
# Categories left out of support counts.
EXCLUDED_CATEGORIES = ("Marketplace Integrity",)
NOISE = "Noise"


def is_true(flag: Column) -> Column:
    """True only for TRUE; NULL gives false."""
    return flag.eqNullSafe(F.lit(True))


def is_false(flag: Column) -> Column:
    """True only for FALSE; NULL gives false."""
    return flag.eqNullSafe(F.lit(False))


def not_in(value: Column, excluded: Sequence) -> Column:
    """Plain NOT IN: a NULL value gives NULL, so a filter drops it."""
    return ~value.isin(list(excluded))


def not_in_or_null(value: Column, excluded: Sequence[str]) -> Column:
    """NOT IN that keeps NULL values; an excluded empty text excludes them too. Parquet can use this form."""
    kept = ~value.isin(list(excluded))
    return value.isNotNull() & kept if "" in excluded else value.isNull() | kept


def in_not_null(value: Column, wanted: Sequence[str]) -> Column:
    """IN that is false, never NULL, for NULL values; a wanted empty text wants them too. Parquet can use this form."""
    found = value.isin(list(wanted))
    return value.isNull() | found if "" in wanted else value.isNotNull() & found


def since(day: Column, lower: date) -> Column:
    return day >= F.lit(lower)


def either_since(first: Column, second: Column, lower: Column) -> Column:
    """Either of two moments on or after ``lower``."""
    return (first >= lower) | (second >= lower)


def open_until(moment: Column, stop: Column) -> Column:
    """``moment <= stop`` where a missing stop never ends."""
    return moment <= F.coalesce(stop, far_future())


def countable_case(
    *,
    channels: Sequence[str] = CHANNELS,
    excluded_categories: Sequence[str] = EXCLUDED_CATEGORIES,
    channel: str = "first_contact_channel",
    auto_response: str = "auto_response",
    duplicate: str = "duplicate_case_id",
    category: str = "case_category",
) -> Column:
    """A case that counts for an agent: support channel, not automatic, not a duplicate, category kept."""
    return (
        F.col(channel).isin(list(channels))
        & is_false(F.col(auto_response))
        & F.col(duplicate).isNull()
        & not_in_or_null(F.col(category), excluded_categories)
    )


def user_contact_case(channels: Sequence[str] = CHANNELS, noise: str = NOISE) -> Column:
    """A case that counts for a user: support channel, not automatic, sub-category not noise."""
    return (
        F.col("first_contact_channel").isin(list(channels))
        & is_false(F.col("auto_response"))
        & not_in_or_null(F.col("case_subcategory"), [noise])
    )
