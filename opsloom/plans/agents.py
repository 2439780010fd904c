"""Agent stints: who worked in which team from when to when."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from opsloom.functions.calendar import days_before, parse_iso_date
from opsloom.functions.casts import full_name, strict_long
from opsloom.operators.generators import explode_days

# Team ids of the phone organisation.
PHONE_TEAM_IDS = ("6", "8", "11", "16")

PHONE_STINT = [
    "specialist_name", "email_address", "liveops", "tt_admin_id", "salesforce_id_18", "manager_name",
    "date_team_start", "date_team_end", "emp_lvl", "team_name",
]
CHAT_STINT = [
    "tt_admin_id", "specialist_name", "email_address", "salesforce_id_18", "hired_date", "manager_name",
    "team_name", "upwork_lower", "date_team_start", "date_team_end",
]


def phone_stints(roster: DataFrame, team_ids: Sequence[str] = PHONE_TEAM_IDS) -> DataFrame:
    """Stints from a roster that lists text start and end dates."""
    return roster.filter(F.col("team_id").isin(list(team_ids))).select(
        full_name(F.col("preferred_first_name"), F.col("preferred_last_name")).alias("specialist_name"),
        "email_address",
        strict_long(F.col("liveops_id")).alias("liveops"),
        "tt_admin_id",
        "salesforce_id_18",
        "manager_name",
        parse_iso_date(F.col("team_start_date")).alias("date_team_start"),
        parse_iso_date(F.col("team_end_date")).alias("date_team_end"),
        "emp_lvl",
        "team_name",
    )


def chat_stints(weekly_roster: DataFrame, users: DataFrame) -> DataFrame:
    """Stints collapsed from weekly snapshots: first listed week to last listed week plus six days.

    A gap between listed weeks is bridged. The manager shown is the manager of the agent's manager in
    the same week, else the roster's third-level manager. Only active users count. Both lookups are
    reduced to distinct rows first: repeats cannot change a first or last week.
    """
    snapshot = weekly_roster.select(
        "week_start", "empID", "name", "email", "hired_date", "manager", "manager_three", "tier", "upwork"
    ).distinct()
    active = users.filter(F.col("isactive") == "1").select(F.col("id").alias("user_id"), "email").distinct()
    managers = weekly_roster.select(
        "week_start",
        F.col("shortname").alias("manager"),
        F.col("manager").alias("upper_manager"),
    ).distinct()
    return (
        snapshot.join(active, "email", "inner")
        .join(managers, ["week_start", "manager"], "left")
        .groupBy(
            F.col("empID").alias("tt_admin_id"),
            F.col("name").alias("specialist_name"),
            F.col("email").alias("email_address"),
            F.col("user_id").alias("salesforce_id_18"),
            "hired_date",
            F.coalesce("upper_manager", "manager_three").alias("manager_name"),
            F.col("tier").alias("team_name"),
            F.lower("upwork").alias("upwork_lower"),
        )
        .agg(
            F.min("week_start").alias("date_team_start"),
            F.date_add(F.max("week_start"), 6).alias("date_team_end"),
        )
    )


def agent_days(stints: DataFrame, as_of: date, look_back: int) -> DataFrame:
    """One row per stint and day of the look-back that the stint covers."""
    return explode_days(stints, "date_team_start", "date_team_end", days_before(as_of, look_back), as_of)
