"""Weekly operations board and its parts; weeks start on Monday."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.calendar import midnight, utc_date, week_of
from opsloom.functions.conditions import CHANNELS, EXCLUDED_CATEGORIES, in_not_null, is_false, is_true, not_in_or_null
from opsloom.functions.measures import count_when, share, sum_when, top_two_rate
from opsloom.operators.bitmaps import distinct_ids, id_bitmaps
from opsloom.plans.chat import CHAT_TEAMS
from opsloom.plans.productivity import OUTSOURCED, PHONE_TEAM

# First day of the board, first day of survey rates, sessions that mark an address as a bot.
BOARD_START = date(2017, 1, 1)
SURVEY_START = date(2017, 6, 1)
BOT_SESSIONS = 100

VISITOR_UNIT = 10000
REQUEST_UNIT = 100


def weekly_visitors(visits: DataFrame, *, start: date = BOARD_START, partition: str = "partition_date") -> DataFrame:
    """Distinct visitors per week, heavy addresses left out; ``partition`` prunes the scan."""
    return (
        visits.filter((F.col(partition) >= F.lit(start)) & (F.col("ip_sessions") < BOT_SESSIONS))
        .groupBy(week_of(F.col("visit_date")).alias("week"))
        .agg(F.count_distinct("visitor_pk").alias("visitors"))
        .select("week", "visitors", (F.col("visitors") / VISITOR_UNIT).alias("visitors_10k"))
    )


def visitor_bitmaps(visits: DataFrame, *, start: date = BOARD_START, partition: str = "partition_date") -> DataFrame:
    """Visitors per day as bitmaps, heavy addresses left out; stored, they answer weeks and months without the visits."""
    counted = visits.filter((F.col(partition) >= F.lit(start)) & (F.col("ip_sessions") < BOT_SESSIONS))
    return id_bitmaps(counted, ["visit_date"], "visitor_pk")


def weekly_visitors_from_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """``weekly_visitors`` from stored daily bitmaps."""
    weeks = distinct_ids(bitmaps, [week_of(F.col("visit_date")).alias("week")], "visitors")
    return weeks.select("week", "visitors", (F.col("visitors") / VISITOR_UNIT).alias("visitors_10k"))


def weekly_requests(requests: DataFrame, *, start: date = BOARD_START) -> DataFrame:
    return (
        requests.filter(F.col("create_time") >= midnight(start))
        .groupBy(week_of(utc_date(F.col("create_time"))).alias("week"))
        .agg(F.count("request_id").alias("requests"))
        .select("week", "requests", (F.col("requests") / REQUEST_UNIT).alias("requests_100"))
    )


def weekly_contacts(contacts: DataFrame, *, start: date = BOARD_START) -> DataFrame:
    moment = F.col("first_customer_contact_time")
    return (
        contacts.filter(moment >= midnight(start))
        .groupBy(week_of(utc_date(moment)).alias("week"))
        .agg(F.count("bid_id").alias("contacts"))
    )


def _email(automatic: bool) -> Column:
    flag = F.col("auto_response")
    return (F.col("first_contact_channel") == "Email") & (is_true(flag) if automatic else is_false(flag))


def weekly_case_mix(cases: DataFrame, *, start: date = BOARD_START) -> DataFrame:
    """Cases per week and channel; e-mail splits into answered and automatic."""
    channel = F.col("first_contact_channel")
    return (
        cases.filter(
            not_in_or_null(F.col("case_category"), EXCLUDED_CATEGORIES)
            & channel.isin(list(CHANNELS))
            & (F.col("created_time") >= midnight(start))
        )
        .groupBy(week_of(utc_date(F.col("created_time"))).alias("week"))
        .agg(
            F.count(F.lit(1)).alias("cases"),
            count_when(channel == "Phone").alias("cases_phone"),
            count_when(channel == "Chat").alias("cases_chat"),
            count_when(channel == "SMS").alias("cases_sms"),
            count_when(_email(automatic=False)).alias("cases_email"),
            count_when(_email(automatic=True)).alias("cases_auto_response"),
            count_when(channel == "Directly Question").alias("cases_directly"),
            count_when(channel == "In-Product").alias("cases_in_product"),
        )
    )


def weekly_top_two(cases: DataFrame, *, start: date = SURVEY_START) -> DataFrame:
    """Share of top-two answers per week: all, by channel, by pro segment; NULL where nobody answered."""
    score, channel, segment = (
        F.col("likely_continue_using_score"), F.col("first_contact_channel"), F.col("pro_segment_group_id"),
    )
    scopes = [
        ("ltc", None),
        ("ltc_phone", channel == "Phone"),
        ("ltc_chat", channel == "Chat"),
        ("ltc_sms", channel == "SMS"),
        ("ltc_email", _email(automatic=False)),
        ("ltc_directly", channel == "Directly Question"),
        ("ltc_in_product", channel == "In-Product"),
        ("ltc_strategic", segment == 1),
        ("ltc_hvp_revenue", segment == 2),
        ("ltc_hvp_potential", segment == 3),
        ("ltc_occasional", segment == 4),
        ("ltc_unknown", segment.isNull()),
    ]
    return (
        cases.filter(
            not_in_or_null(F.col("case_category"), EXCLUDED_CATEGORIES)
            & in_not_null(channel, CHANNELS)
            & (F.col("csat_response_time") >= midnight(start))
        )
        .groupBy(week_of(utc_date(F.col("csat_response_time"))).alias("week"))
        .agg(F.count(score).alias("ltc_surveys"), *[top_two_rate(score, s).alias(n) for n, s in scopes])
    )


# Groups of teams on the board, as (column suffix, team labels).
TEAM_GROUPS = {"tsl": (PHONE_TEAM,), "ibex": (OUTSOURCED,), "tph": CHAT_TEAMS}


def weekly_cases_per_hour(team_days: DataFrame, groups: Mapping[str, Sequence[str]] = TEAM_GROUPS) -> DataFrame:
    """Closed cases per hour worked and closed cases, per week and group of teams: suffix -> team labels."""
    closed, hours, team = F.col("closed_cases"), F.col("hours_worked"), F.col("team_name")
    groups = [(suffix, team.isin(list(labels))) for suffix, labels in groups.items()]
    return team_days.groupBy(week_of(F.col("index_date")).alias("week")).agg(
        share(F.sum(closed), F.sum(hours)).alias("cph"),
        *[share(sum_when(g, closed), sum_when(g, hours)).alias(f"cph_{n}") for n, g in groups],
        F.coalesce(F.sum(closed), F.lit(0)).alias("cases_total_team"),
        *[sum_when(g, closed).alias(f"cases_{n}") for n, g in groups],
    )


BOARD_COLUMNS = [
    "week", "visitors", "visitors_10k", "requests", "requests_100", "contacts", "cases", "cases_phone",
    "cases_chat", "cases_sms", "cases_email", "cases_auto_response", "cases_directly", "cases_in_product",
    "cases_total_team", "cases_tsl", "cases_ibex", "cases_tph", "ltc_surveys", "ltc", "ltc_phone", "ltc_chat",
    "ltc_sms", "ltc_email", "ltc_directly", "ltc_in_product", "ltc_strategic", "ltc_hvp_revenue",
    "ltc_hvp_potential", "ltc_occasional", "ltc_unknown", "cph", "cph_tsl", "cph_ibex", "cph_tph",
    "total_costs", "tsl_costs", "ibex_costs", "tph_costs",
]


def weekly_board(
    visitors: DataFrame, requests: DataFrame, contacts: DataFrame, case_mix: DataFrame, top_two: DataFrame,
    cases_per_hour: DataFrame, costs: DataFrame, *, as_of: date, start: date = BOARD_START,
) -> DataFrame:
    """39 columns per complete week that has visitors.

    Every part is already one row per week, so the joins are of a few hundred rows. Costs may list a
    week more than once. A missing cost counts 0 in the total and stays NULL in its own column.
    """
    cost_columns = ["tsl_costs", "ibex_costs", "tph_costs"]
    board = visitors.filter(
        (F.col("week") >= F.lit(start)) & (F.col("week") < week_of(F.lit(as_of)))
    )
    for part in (requests, contacts, case_mix, top_two, cases_per_hour, costs.select("week", *cost_columns)):
        board = board.join(part, "week", "left")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cost_columns[1:]), F.coalesce(F.col(cost_columns[0]), F.lit(0)))
    return board.withColumn("total_costs", total).select(*BOARD_COLUMNS)
