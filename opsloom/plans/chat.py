"""Chat, SMS and e-mail agents: measures per agent day without stints, and the scorecard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.calendar import (
    days_before, from_millis, midnight, millis, parse_us_date, parse_us_stamp, utc_date,
)
from opsloom.functions.casts import strict_double
from opsloom.functions.conditions import countable_case, either_since, not_in_or_null
from opsloom.functions.measures import histogram_names, score_histogram, sum_when
from opsloom.operators.relations import clone_rows, zero_fill
from opsloom.plans.agents import agent_days
from opsloom.plans.ledger import LEDGER_MEASURES, ledger_measures

# The teams on the chat scorecard.
CHAT_TEAMS = ("TPH Email", "TPH Chat", "TPH SMS")
SECONDS_PER_HOUR = 3600

# Presence labels summed under each output column.
PRESENCE_BUCKETS = [
    ("offline_time", ["Offline"]),
    ("coaching_time", ["Coaching"]),
    ("lunch_time", ["Lunch"]),
    ("break_time", ["Break"]),
    ("away_time", ["Away", "Away (Deprecated)"]),
    ("training_time", ["Training"]),
    ("meeting_time", ["Meeting"]),
    ("follow_up_time", ["Follow Up"]),
    ("wrap_break_time", ["Wrap Up (Break)"]),
    ("wrap_shift_end_time", ["Wrap Up (End of shift)"]),
]
PRESENCE_MEASURES = [
    "offline_time", "online_time", "coaching_time", "lunch_time", "break_time", "away_time", "training_time",
    "meeting_time", "follow_up_time", "wrap_break_time", "wrap_shift_end_time", "null_status_time",
]


def contractor_hours(hours: DataFrame) -> DataFrame:
    """Hours per lower-cased contractor name and day."""
    return hours.groupBy(
        parse_us_date(F.col("date")).alias("date"), F.lower("full_name").alias("name_lower")
    ).agg(F.sum("total_hours").alias("total_hours"))


def closed_cases(cases: DataFrame, *, as_of: date, look_back: int) -> DataFrame:
    """Cases closed and surveys offered per owner and UTC closing day."""
    lower = midnight(days_before(as_of, look_back))
    return (
        cases.filter(
            countable_case()
            & F.col("closed_time_mt").isNotNull()
            & either_since(F.col("created_time"), F.col("closed_time"), lower)
        )
        .groupBy(utc_date(F.col("closed_time")).alias("closed_date"), "case_owner_agent_id")
        .agg(F.count("closed_time").alias("closed_cases"), F.count("csat_offered_time").alias("pushed_surveys"))
    )


def presence_time(presence: DataFrame, statuses: DataFrame, *, as_of: date, look_back: int) -> DataFrame:
    """Seconds per owner and day: all, all but lunch, by presence label, by label prefix, and unlabelled.

    Time is summed per status id before the labels are looked up, so the lookup moves one row per
    owner, day and status. Ids listed twice in ``statuses`` still count twice.
    """
    day = utc_date(parse_us_stamp(F.col("createddate")))
    by_status = (
        presence.filter(day >= F.lit(days_before(as_of, look_back)))
        .groupBy(day.alias("event_date"), F.col("ownerid").alias("salesforce_id_18"), "servicepresencestatusid")
        .agg(F.sum(strict_double(F.col("statusduration"))).alias("seconds"))
    )
    labels = statuses.select(F.col("id").alias("servicepresencestatusid"), F.col("masterlabel").alias("label"))
    label, seconds = F.col("label"), F.col("seconds")
    lunch = sum_when(label == "Lunch", seconds)
    return (
        by_status.join(labels, "servicepresencestatusid", "left")
        .groupBy("event_date", "salesforce_id_18")
        .agg(
            F.sum(seconds).alias("total_omni_time"),
            (F.sum(seconds) - lunch).alias("total_omni_denominator"),
            *[sum_when(label.isin(names), seconds).alias(column) for column, names in PRESENCE_BUCKETS],
            sum_when(label.startswith("Online"), seconds).alias("online_time"),
            sum_when(label.isNull(), seconds).alias("null_status_time"),
        )
        .select("event_date", "salesforce_id_18", "total_omni_time", "total_omni_denominator", *PRESENCE_MEASURES)
    )


def survey_filter(lower: Column) -> Column:
    """Created in the look-back, or answered in it and not from inside the product.

    The origin rule binds to the second half only, so in-product surveys created in the look-back count.
    """
    created, answered = F.col("csat_created_time"), F.col("csat_response_time")
    outside_product = not_in_or_null(F.col("csat_case_origin"), ["In-Product"])
    return (created >= lower) | ((answered >= lower) & outside_product)


def survey_scores(surveys: DataFrame, *, as_of: date, look_back: int) -> DataFrame:
    """Score histograms per survey owner and UTC answer day."""
    return (
        surveys.filter(survey_filter(midnight(days_before(as_of, look_back))))
        .groupBy("csat_owner_id", utc_date(F.col("csat_response_time")).alias("csat_response_date"))
        .agg(
            *score_histogram(F.col("csat_score"), "csat"),
            *score_histogram(F.col("likely_continue_using_score"), "ltc"),
        )
    )


def ledger(credit_log: DataFrame, *, as_of: date, look_back: int) -> DataFrame:
    """Refunds and grants per performing user and UTC day."""
    recent = credit_log.filter(F.col("cre_timestamp") >= F.lit(millis(days_before(as_of, look_back))))
    return ledger_measures(recent, utc_date(from_millis(F.col("cre_timestamp"))).alias("cre_date"))


def chat_scorecard(
    stints: DataFrame, cases: DataFrame, presence: DataFrame, statuses: DataFrame, surveys: DataFrame,
    credit_log: DataFrame, hours: DataFrame, *, as_of: date, look_back: int = 45,
    teams: Sequence[str] = CHAT_TEAMS, demo_of: str | None = None, demo_identity: Mapping[str, str] | None = None,
) -> DataFrame:
    """52 columns per stint and day of the listed teams, 0 where nothing happened.

    ``demo_of`` names the e-mail whose rows also appear under ``demo_identity`` (column -> value).
    """
    index = agent_days(stints.filter(F.col("team_name").isin(list(teams))), as_of, look_back).alias("a")
    closed = closed_cases(cases, as_of=as_of, look_back=look_back).alias("c")
    spent = presence_time(presence, statuses, as_of=as_of, look_back=look_back).alias("t")
    scores = survey_scores(surveys, as_of=as_of, look_back=look_back).alias("v")
    money = ledger(credit_log, as_of=as_of, look_back=look_back).alias("m")
    contracted = contractor_hours(hours).alias("u")
    day, agent = F.col("a.index_date"), F.col("a.salesforce_id_18")

    def as_hours(column: str) -> Column:
        return (F.coalesce(F.col(f"t.{column}"), F.lit(0)) / SECONDS_PER_HOUR).alias(f"{column}_hours")

    card = (
        index.join(closed, (agent == F.col("c.case_owner_agent_id")) & (day == F.col("c.closed_date")), "left")
        .join(spent, (agent == F.col("t.salesforce_id_18")) & (day == F.col("t.event_date")), "left")
        .join(scores, (agent == F.col("v.csat_owner_id")) & (day == F.col("v.csat_response_date")), "left")
        .join(
            money,
            (F.col("a.tt_admin_id") == F.col("m.cre_performing_usr_user_id")) & (day == F.col("m.cre_date")),
            "left",
        )
        .join(contracted, (F.col("a.upwork_lower") == F.col("u.name_lower")) & (day == F.col("u.date")), "left")
        .select(
            "a.*",
            *zero_fill(["closed_cases", "pushed_surveys"], "c"),
            F.coalesce("u.total_hours", F.lit(0)).alias("total_upwork_hours"),
            as_hours("total_omni_denominator"),
            *zero_fill(["total_omni_denominator"], "t"),
            as_hours("total_omni_time"),
            *zero_fill(["total_omni_time", *PRESENCE_MEASURES], "t"),
            *zero_fill([*histogram_names("csat"), *histogram_names("ltc")], "v"),
            *zero_fill(LEDGER_MEASURES, "m"),
        )
    )
    if demo_of is None:
        return card
    return clone_rows(card, F.col("email_address") == demo_of, demo_identity or {})
