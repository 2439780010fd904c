"""Revenue against support cost per pro, and the flags drawn from it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.calendar import months_before, utc_date
from opsloom.functions.casts import last_char
from opsloom.functions.conditions import CHANNELS, NOISE, is_false, is_true, not_in, not_in_or_null
from opsloom.functions.measures import avg_when, count_when, sum_when

PHONE = ("Phone",)
OTHER = tuple(c for c in CHANNELS if c not in PHONE)
PERIODS = ("all_time", "last_year")

# Cost of one support contact, tenure before a pro can be flagged, segments never flagged,
# and the last id digits of each roll-out wave.
COST_PHONE = 60
COST_OTHER = 30
TENURE_MONTHS = 6
PROTECTED_SEGMENTS = (1, 2, 3)
WAVES = [(1, ("1",)), (2, ("2", "3", "4")), (3, ("5", "6", "7", "8", "9", "0"))]


def _within(period: str, moment: Column, as_of: date) -> Column:
    """Condition for a measure of the period: none, or the year up to ``as_of``."""
    if period == "all_time":
        return F.lit(True)
    return utc_date(moment) >= months_before(F.lit(as_of), 12)


def pro_measures(quotes: DataFrame, as_of: date) -> DataFrame:
    """Quotes, contacts, refunds, revenue and free units per pro, all-time and last year."""
    ppc, revenue = F.col("pay_per_customer_contact"), F.col("revenue")
    contact_time = F.when(ppc, F.col("first_intentful_ppc_contact_time")).otherwise(
        F.col("first_positive_customer_interaction_time")
    )
    unpaid = (revenue == 0) & is_false(F.col("refunded"))
    free_quote = (ppc == F.lit(False)) & unpaid
    free_contact = (ppc == F.lit(True)) & F.col("first_intentful_ppc_contact_time").isNotNull() & unpaid
    aggregates = [
        F.count("bid_id").alias("quotes"),
        F.count(contact_time).alias("customer_contacts"),
        count_when(is_true(F.col("refunded"))).alias("refunded"),
    ]
    for period in PERIODS:
        inside = _within(period, F.col("sent_time"), as_of)
        for source in ("revenue", "revenue_ppq", "revenue_ppc"):
            aggregates.append(F.coalesce(sum_when(inside, F.col(source)), F.lit(0)).alias(f"{source}_{period}"))
        aggregates.append(count_when(inside & free_quote).alias(f"free_quotes_{period}"))
        aggregates.append(count_when(inside & free_contact).alias(f"free_customer_contacts_{period}"))
    return quotes.groupBy("pro_user_id").agg(*aggregates)


def support_volume(cases: DataFrame, as_of: date) -> DataFrame:
    """Support cases per user, by phone and otherwise, all-time and last year."""
    channel, number = F.col("first_contact_channel"), F.col("case_number")
    aggregates = []
    for period in PERIODS:
        inside = _within(period, F.col("created_time"), as_of)
        for name, channels in (("cases", CHANNELS), ("cases_phone", PHONE), ("cases_other", OTHER)):
            aggregates.append(count_when(channel.isin(list(channels)) & inside, number).alias(f"{name}_{period}"))
    return (
        cases.filter(is_false(F.col("auto_response")) & not_in_or_null(F.col("case_owner_agent_team"), [NOISE]))
        .groupBy("user_id")
        .agg(*aggregates)
    )


def reference_prices(
    quotes: DataFrame, as_of: date, *, cost_phone: int = COST_PHONE, cost_other: int = COST_OTHER
) -> DataFrame:
    """One row: mean paid price of a contact and of a quote, all-time and last year, and the unit costs."""
    ppc, revenue = F.col("pay_per_customer_contact"), F.col("revenue")
    paid_contact = is_true(ppc) & (revenue > 0) & F.col("first_intentful_ppc_contact_time").isNotNull()
    paid_quote = is_false(ppc) & (revenue > 0)
    return quotes.agg(
        *[
            avg_when(_within(period, F.col("sent_time"), as_of) & paid, revenue).alias(f"avg_{kind}_price_{period}")
            for period in PERIODS
            for kind, paid in (("ppc", paid_contact), ("ppq", paid_quote))
        ]
    ).select(
        "*",
        F.lit(cost_phone).alias("cost_phone_support_contact"),
        F.lit(cost_other).alias("cost_other_support_contact"),
    )


def profitability(
    pros: DataFrame, quotes: DataFrame, cases: DataFrame, *, as_of: date,
    cost_phone: int = COST_PHONE, cost_other: int = COST_OTHER,
) -> DataFrame:
    """33 columns per pro: revenue less support cost, without and with the imputed value of free units.

    The one-row prices enter as a scalar subquery, so no join is needed for them. Free value and cost
    are filled as whole sums: a missing part loses the other part too. All three relations are hashed
    on the pro id, after aggregation where they are large.
    """
    prices = reference_prices(quotes, as_of, cost_phone=cost_phone, cost_other=cost_other)
    one = prices.select(F.struct(*prices.columns).alias("prices")).scalar()
    base = (
        pros.alias("p")
        .join(pro_measures(quotes, as_of).alias("q"), F.col("p.pro_user_id") == F.col("q.pro_user_id"), "left")
        .join(support_volume(cases, as_of).alias("s"), F.col("p.pro_user_id") == F.col("s.user_id"), "left")
        .withColumn("one", one)
    )

    def filled(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0))

    def price(name: str) -> Column:
        return F.col("one").getField(name)

    def free_value(period: str) -> Column:
        return F.coalesce(
            price(f"avg_ppq_price_{period}") * F.col(f"q.free_quotes_{period}")
            + price(f"avg_ppc_price_{period}") * F.col(f"q.free_customer_contacts_{period}"),
            F.lit(0),
        )

    def cost(period: str) -> Column:
        return F.coalesce(
            price("cost_phone_support_contact") * F.col(f"s.cases_phone_{period}")
            + price("cost_other_support_contact") * F.col(f"s.cases_other_{period}"),
            F.lit(0),
        )

    def quote_columns(period: str) -> list[Column]:
        names = [f"{n}_{period}" for n in (
            "revenue", "revenue_ppq", "revenue_ppc", "free_quotes", "free_customer_contacts"
        )]
        earned = filled(f"q.revenue_{period}")
        return [
            *[filled(f"q.{n}").alias(n) for n in names],
            *[price(f"avg_{k}_price_{period}").alias(f"avg_{k}_price_{period}") for k in ("ppq", "ppc")],
            free_value(period).alias(f"est_free_{period}"),
            (earned - cost(period)).alias(f"profitability_{period}"),
            (earned + free_value(period) - cost(period)).alias(f"profitability_incl_free_{period}"),
        ]

    def case_columns(period: str) -> list[Column]:
        return [
            cost(period).alias(f"cost_{period}"),
            *[filled(f"s.{n}_{period}").alias(f"{n}_{period}") for n in ("cases", "cases_phone", "cases_other")],
        ]

    return base.select(
        "p.pro_user_id",
        "p.first_service_create_time",
        *[filled(f"q.{c}").alias(c) for c in ("quotes", "customer_contacts", "refunded")],
        *quote_columns("all_time"),
        *quote_columns("last_year"),
        *case_columns("all_time"),
        *case_columns("last_year"),
    )


def unprofitable_flags(
    profits: DataFrame, segments: DataFrame, *, as_of: date, tenure_months: int = TENURE_MONTHS,
    protected: Sequence[int] = PROTECTED_SEGMENTS,
) -> DataFrame:
    """17 columns per pro: four flags, the roll-out wave of the last id digit, and the sums behind them.

    Pros without a segment are never flagged.
    """
    groups = segments.select(F.col("pro_user_id").alias("_pro"), "group_id")
    joined = profits.join(groups, F.col("pro_user_id") == F.col("_pro"), "left")
    settled_in = utc_date(F.col("first_service_create_time")) < months_before(F.lit(as_of), tenure_months)
    eligible = settled_in & not_in(F.col("group_id"), protected)

    def loss(measure: str) -> Column:
        return F.when(eligible & (F.col(measure) < 0), 1).otherwise(0)

    flagged, digit = loss("profitability_incl_free_all_time") == 1, last_char(F.col("pro_user_id"))
    number, digits = WAVES[0]
    wave = F.when(digit.isin(list(digits)) & flagged, number)
    for number, digits in WAVES[1:]:
        wave = wave.when(digit.isin(list(digits)) & flagged, number)
    return joined.select(
        "pro_user_id",
        wave.otherwise(0).alias("unprofitable_rollout_wave"),
        "group_id",
        loss("profitability_all_time").alias("unprofitable_flag_all_time"),
        loss("profitability_last_year").alias("unprofitable_flag_last_year"),
        loss("profitability_incl_free_all_time").alias("unprofitable_flag_incl_free_all_time"),
        loss("profitability_incl_free_last_year").alias("unprofitable_flag_incl_free_last_year"),
        "profitability_all_time",
        "profitability_last_year",
        "profitability_incl_free_all_time",
        "profitability_incl_free_last_year",
        "revenue_all_time",
        "revenue_last_year",
        "est_free_all_time",
        "est_free_last_year",
        "cost_all_time",
        "cost_last_year",
    )
