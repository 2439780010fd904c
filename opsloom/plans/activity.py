"""Dense month-by-month activity of pros in enabled and other markets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from opsloom.functions.calendar import midnight, month_of, utc_date
from opsloom.operators import panel
from opsloom.operators.generators import months_between

ENTITY = ["pro_user_id", "im_enabled_market"]


def _market_weights(markets: DataFrame) -> DataFrame:
    """Market rows per key, split by whether the row is enabled.

    Repeated market rows multiply contacts. Counting them first keeps the join at two rows per key at
    most, whatever the number of repeats.
    """
    return markets.groupBy(
        "category_id",
        "cbsa_id",
        F.when(F.col("enabled_timestamp").isNotNull(), 1).otherwise(0).alias("im_enabled_market"),
    ).agg(F.count(F.lit(1)).alias("weight"))


def _by_month(contacts: DataFrame, markets: DataFrame, start: date) -> DataFrame:
    """One pass for everything per pro, flag and month, inside and outside the start filter."""
    matched = (
        contacts.alias("c")
        .join(_market_weights(markets).alias("m"), ["category_id", "cbsa_id"], "left")
        .select(
            month_of(utc_date(F.col("c.first_customer_contact_time"))).alias("month"),
            F.col("c.pro_user_id").alias("pro_user_id"),
            F.coalesce(F.col("m.im_enabled_market"), F.lit(0)).alias("im_enabled_market"),
            F.coalesce(F.col("m.weight"), F.lit(1)).alias("weight"),
            F.col("c.first_customer_contact_time").isNotNull().alias("contacted"),
            F.coalesce(F.col("c.request_create_time") >= midnight(start), F.lit(False)).alias("in_scope"),
            F.col("c.revenue").alias("revenue"),
        )
    )
    return matched.groupBy("month", *ENTITY).agg(
        F.bool_or("in_scope").alias("in_scope"),
        F.sum(F.when(F.col("in_scope") & F.col("contacted"), F.col("weight")).otherwise(0)).alias("contacts"),
        F.sum(F.when(F.col("in_scope"), F.col("revenue") * F.col("weight"))).alias("revenue"),
    )


def monthly_activity(contacts: DataFrame, markets: DataFrame, start: date) -> DataFrame:
    """Contacts and revenue per month, pro and market flag, for requests since ``start``."""
    return (
        _by_month(contacts, markets, start)
        .filter("in_scope")
        .select("month", *ENTITY, "contacts", "revenue")
    )


def first_activity(contacts: DataFrame, markets: DataFrame) -> DataFrame:
    """First contact month per pro and market flag, over all requests whenever made."""
    return (
        contacts.join(_market_weights(markets), ["category_id", "cbsa_id"], "left")
        .groupBy("pro_user_id", F.coalesce("im_enabled_market", F.lit(0)).alias("im_enabled_market"))
        .agg(F.min(month_of(utc_date(F.col("first_customer_contact_time")))).alias("first_contact_month"))
    )


def activity_panel(contacts: DataFrame, markets: DataFrame, *, start: date, as_of: date) -> DataFrame:
    """Every pro and flag in every month, zero-filled, with running, total, previous and look-ahead counts.

    Contacts are shuffled once, already summed per month; the only other exchange brings a pro's active
    months into one row. Measures are array scans in that row, taken before its months are exploded, so
    the full panel is neither sorted nor windowed. Requests without a pro keep their zero-filled rows and
    match no counts.
    """
    counted = F.col("in_scope") & F.col("pro_user_id").isNotNull()
    scoped = _by_month(contacts, markets, start).select(
        "month",
        *ENTITY,
        "in_scope",
        F.when(counted, F.col("contacts")).alias("n"),
        F.when(counted, F.col("revenue")).alias("amount"),
    )
    first_month = F.min(F.when(F.col("pro_user_id").isNotNull(), F.col("month")))
    arrays = panel.month_arrays(
        scoped,
        ENTITY,
        "month",
        ["n", "amount"],
        [first_month.alias("first_contact_month"), F.bool_or("in_scope").alias("listed")],
        start,
        as_of,
    ).filter("listed")
    scanned = arrays.select(
        *ENTITY, "n", "amount", "first_contact_month", panel.running_totals(F.col("n")).alias("totals")
    ).select("*", F.posexplode(months_between(start, as_of)).alias("pos", "month"))
    n, totals, pos, month = (F.col(c) for c in ("n", "totals", "pos", "month"))
    return scanned.select(
        "month",
        *ENTITY,
        F.coalesce(F.get(n, pos), F.lit(0)).alias("contacts"),
        F.coalesce(F.get(F.col("amount"), pos), F.lit(0)).alias("revenue"),
        panel.through(totals, pos).alias("running_contacts"),
        F.element_at(totals, -1).alias("total_contacts"),
        panel.one_before(n, pos).alias("contacts_prev_month"),
        *[
            F.when(panel.elapsed(month, as_of, k), panel.next_elements(totals, pos, k)).alias(f"contacts_next_{k}months")
            for k in (1, 2, 5)
        ],
        "first_contact_month",
    )
