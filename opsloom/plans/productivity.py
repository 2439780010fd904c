"""Closed cases and hours worked per team and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opsloom.functions.conditions import not_in
from opsloom.operators.relations import union_by_position

# The phone system logs minutes, the chat system seconds.
PHONE_UNITS_PER_HOUR = 60
CHAT_UNITS_PER_HOUR = 3600

# Team labels of the published datasets.
OUTSOURCED = "IBEX"
PHONE_TEAM = "TSL Phone"
FIRST_LEVEL = "1"

SURVEY_MEASURES = ("ltc_responses", "ltc_top2")


def phone_team_days(
    card: DataFrame, *, excluded_emails: Sequence[str], surveys: bool = True, outsourced: Sequence[str] = (OUTSOURCED,),
    in_house: str = PHONE_TEAM, level: str = FIRST_LEVEL,
) -> DataFrame:
    """Phone agents of a level by team and day.

    Agents whose manager stands for an ``outsourced`` partner belong to it; all others, those without a
    manager too, to the ``in_house`` team.
    """
    manager = F.col("manager_name")
    team = F.when(manager.isin(list(outsourced)), manager).otherwise(in_house)
    return (
        card.filter((F.col("emp_lvl") == level) & not_in(F.col("email_address"), excluded_emails))
        .groupBy(team.alias("team_name"), "index_date")
        .agg(
            F.sum("closed_cases").alias("closed_cases"),
            (F.sum(F.col("total_lops_time") - F.col("lunch_time")) / PHONE_UNITS_PER_HOUR).alias("hours_worked"),
            *[F.sum(m).alias(m) for m in SURVEY_MEASURES if surveys],
        )
    )


def chat_team_days(card: DataFrame, *, excluded_emails: Sequence[str], surveys: bool = True) -> DataFrame:
    return (
        card.filter(not_in(F.col("email_address"), excluded_emails))
        .groupBy("team_name", "index_date")
        .agg(
            F.sum("closed_cases").alias("closed_cases"),
            (F.sum(F.col("total_omni_time") - F.col("lunch_time")) / CHAT_UNITS_PER_HOUR).alias("hours_worked"),
            *[F.sum(m).alias(m) for m in SURVEY_MEASURES if surveys],
        )
    )


def team_days(
    phone_card: DataFrame, chat_card: DataFrame, *, excluded_emails: Sequence[str], surveys: bool = True,
    outsourced: Sequence[str] = (OUTSOURCED,), in_house: str = PHONE_TEAM, level: str = FIRST_LEVEL,
) -> DataFrame:
    """Both organisations' team days, one below the other."""
    return union_by_position(
        phone_team_days(
            phone_card, excluded_emails=excluded_emails, surveys=surveys, outsourced=outsourced, in_house=in_house, level=level
        ),
        chat_team_days(chat_card, excluded_emails=excluded_emails, surveys=surveys),
    )
