"""Case rows of agents in their stints, with local times."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from opsloom.functions.calendar import days_before, midnight, parse_iso_stamp, utc_date
from opsloom.functions.conditions import countable_case, either_since
from opsloom.operators.intervals import join_in_interval
from opsloom.plans.agents import CHAT_STINT, PHONE_STINT

CASE_COLUMNS = [
    "case_id", "case_number", "first_contact_channel", "case_category", "case_subcategory", "duplicate_case_id",
]
SURVEY_COLUMNS = ["csat_id", "csat_owner_agent_id", "csat_survey_offered", "csat_survey_not_offered_reason"]
ANSWER_COLUMNS = [
    "csat_score", "likely_continue_using_score", "easy_to_handle_issue_score", "less_time_than_expected_score",
    "issue_resolved_score", "number_interactions_to_resolution", "csat_audit_exception_reason",
    "pro_contact_info_captured", "csat_comments",
]


def case_detail(
    stints: DataFrame, cases: DataFrame, links: DataFrame, *, as_of: date, look_back: int, zone_suffix: str,
    stint_columns: Sequence[str],
) -> DataFrame:
    """Countable cases of agents in stint, with times in the zone named by the column suffix.

    A case belongs to a stint by its Mountain creation day; the look-back reads the ``zone_suffix``
    times. Cases are filtered and cut to the reported columns before the join.
    """

    def local(name: str):
        return parse_iso_stamp(F.col(f"{name}_{zone_suffix}")).alias(f"{name}_{zone_suffix}")

    lower = midnight(days_before(as_of, look_back))
    recent = either_since(local("created_time"), local("closed_time"), lower)
    reported = [
        *CASE_COLUMNS,
        *[f"{n}_{zone_suffix}" for n in ("created_time", "closed_time")],
        *SURVEY_COLUMNS,
        *[f"{n}_{zone_suffix}" for n in ("csat_created_time", "csat_offered_time", "csat_response_time")],
        *ANSWER_COLUMNS,
    ]
    kept = cases.filter(countable_case() & recent).select(
        F.col("case_owner_agent_id").alias("_owner"),
        utc_date(parse_iso_stamp(F.col("created_time_mt"))).alias("_created_day"),
        *CASE_COLUMNS,
        local("created_time"),
        local("closed_time"),
        *SURVEY_COLUMNS,
        local("csat_created_time"),
        local("csat_offered_time"),
        local("csat_response_time"),
        *ANSWER_COLUMNS,
    )
    owned = join_in_interval(
        stints, kept,
        key=F.col("salesforce_id_18") == F.col("_owner"),
        at=F.col("_created_day"), start=F.col("date_team_start"), end=F.col("date_team_end"),
    )
    link = links.select(F.col("id").alias("_link_id"), F.col("caseconsolelink__c").alias("case_link"))
    return owned.join(link, F.col("case_id") == F.col("_link_id"), "left").select(
        *stint_columns, *reported, "case_link"
    )


def phone_case_detail(
    stints: DataFrame, cases: DataFrame, links: DataFrame, *, as_of: date, look_back: int = 45
) -> DataFrame:
    return case_detail(
        stints, cases, links, as_of=as_of, look_back=look_back, zone_suffix="mt", stint_columns=PHONE_STINT
    )


def chat_case_detail(
    stints: DataFrame, cases: DataFrame, links: DataFrame, *, as_of: date, look_back: int = 45
) -> DataFrame:
    return case_detail(
        stints, cases, links, as_of=as_of, look_back=look_back, zone_suffix="pht", stint_columns=CHAT_STINT
    )
