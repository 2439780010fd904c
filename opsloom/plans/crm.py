"""Typed view of CRM action plans, whose source columns are all text.

Only the columns listed here are read, so free-text fields with personal data never enter the output.
``prefix`` names the CRM in the output and user columns (``<prefix>_user_id`` and so on).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opsloom.functions.calendar import parse_us_stamp
from opsloom.functions.casts import full_name, long_via_double, safe_double, safe_long
from opsloom.functions.conditions import not_in

# Source column of each reported time.
CREATED_TIMES = [
    ("action_plan_created_time", "createddate"),
    ("action_plan_start_time", "planstartdate__c"),
    ("action_plan_end_time", "planenddate__c"),
    ("action_plan_expiration_time", "expirationdate__c"),
]
FOLLOW_UP_TIMES = [
    ("last_checkin_time", "lastcheckindate__c"),
    ("last_attempt_time", "lastattempt__c"),
    ("next_call_scheduled_time", "nextcallscheduled__c"),
]
AUDIT_TIMES = [
    ("last_modified_time", "lastmodifieddate"),
    ("last_activity_time", "lastactivitydate"),
    ("last_referenced_time", "lastreferenceddate"),
    ("last_viewed_time", "lastvieweddate"),
    ("system_modstamp_time", "systemmodstamp"),
]
PROGRESS = [
    ("total_action_plan_items", "totalnumberofactionitems__c"),
    ("number_completed_action_plan_items", "numberofcompleteactionitems__c"),
    ("percent_action_plan_complete", "percentcomplete__c"),
]


def _times(pairs: Sequence[tuple[str, str]]) -> list[Column]:
    return [parse_us_stamp(F.col(f"a.{source}")).alias(name) for name, source in pairs]


def _renamed(**names: str) -> list[Column]:
    return [F.col(f"a.{source}").alias(name) for name, source in names.items()]


def _plans(plans: DataFrame, excluded_templates: Sequence[str]) -> DataFrame:
    """Real plans made from a template."""
    template = F.col("actionplantemplate__c")
    kept = plans.filter((F.col("istestdata__c") == "0") & template.isNotNull())
    if excluded_templates:
        kept = kept.filter(not_in(template, excluded_templates))
    return kept.alias("a")


def _with_user_names(plans: DataFrame, users: DataFrame, prefix: str) -> DataFrame:
    """The user table in three roles: creator, owner, last editor."""
    names = users.select(
        F.col(f"{prefix}_user_id").alias("id"),
        full_name(F.col("user_first_name"), F.col("user_last_name")).alias("name"),
    )
    for role, column in (("creator", "createdbyid"), ("owner", "ownerid"), ("editor", "lastmodifiedbyid")):
        plans = plans.join(names.alias(role), F.col(f"a.{column}") == F.col(f"{role}.id"), "left")
    return plans


def _people(prefix: str) -> list[Column]:
    return [
        F.col("a.createdbyid").alias(f"created_by_{prefix}_id"),
        F.col("creator.name").alias(f"created_by_{prefix}_user_name"),
        F.col("a.ownerid").alias(f"owner_{prefix}_id"),
        F.col("owner.name").alias(f"owner_{prefix}_user_name"),
    ]


def _progress_and_audit(prefix: str) -> list[Column]:
    return [
        *[safe_double(F.col(f"a.{source}")).alias(name) for name, source in PROGRESS],
        *_times(FOLLOW_UP_TIMES),
        F.col("a.lastmodifiedbyid").alias("last_modified_by_id"),
        F.col("editor.name").alias(f"last_modified_by_{prefix}_user_name"),
        *_times(AUDIT_TIMES),
        F.col("a.recordtypeid").alias(f"{prefix}_record_type_id"),
        safe_long(F.col("a.isdeleted")).alias("action_plan_is_deleted"),
    ]


def typed_plans(plans: DataFrame, users: DataFrame, *, prefix: str = "crm") -> DataFrame:
    """Action plans with typed columns and the names of creator, owner and last editor."""
    return _with_user_names(_plans(plans, ()), users, prefix).select(
        *_renamed(action_plan_id="id", action_plan_number="actionplannumber__c"),
        *_times(CREATED_TIMES),
        *_renamed(
            action_plan_template_id="actionplantemplate__c",
            action_plan_type="actionplantype__c",
            playbook_url="playbookurl__c",
            action_plan_status="status__c",
        ),
        *_people(prefix),
        *_renamed(**{
            f"{prefix}_contact_id": "contact__c",
            f"{prefix}_parent_account_id": "parentaccount__c",
            f"{prefix}_account_id": "account__c",
            f"{prefix}_lead_id": "lead__c",
            f"{prefix}_service_id": "service__c",
        }),
        *_progress_and_audit(prefix),
    )


def typed_plans_view(
    plans: DataFrame, users: DataFrame, contacts: DataFrame, accounts: DataFrame, campaigns: DataFrame,
    members: DataFrame, *, excluded_templates: Sequence[str] = (), prefix: str = "crm",
) -> DataFrame:
    """Action plans with ids of contact and both accounts, campaign and campaign membership.

    A plan appears once per matching membership.
    """
    joined = _with_user_names(_plans(plans, excluded_templates), users, prefix)
    for role, table, column in (
        ("contact", contacts, "contact__c"),
        ("parent_account", accounts, "parentaccount__c"),
        ("account", accounts, "account__c"),
    ):
        ids = table.select(
            F.col("id"),
            long_via_double(F.col("usr_user_id__c")).alias("user_id"),
            safe_long(F.col("user_pk_id__c")).alias("user_pk"),
        )
        joined = joined.join(ids.alias(role), F.col(f"a.{column}") == F.col(f"{role}.id"), "left")
    joined = joined.join(
        campaigns.select("id", "name").alias("campaign"), F.col("a.campaign__c") == F.col("campaign.id"), "left"
    ).join(
        members.select("id", "contactid", "campaignid").alias("member"),
        (F.col("a.contact__c") == F.col("member.contactid")) & (F.col("campaign.id") == F.col("member.campaignid")),
        "left",
    )

    def linked(role: str, source: str) -> list[Column]:
        return [
            F.col(f"a.{source}").alias(f"{prefix}_{role}_id"),
            F.col(f"{role}.user_id").alias(f"{prefix}_{role}_user_id"),
            F.col(f"{role}.user_pk").alias(f"{prefix}_{role}_user_pk"),
        ]

    return joined.select(
        *_renamed(action_plan_id="id", action_plan_number="actionplannumber__c"),
        *_times(CREATED_TIMES),
        *_renamed(
            action_plan_template_id="actionplantemplate__c",
            action_plan_template_name="actionplantemplatename__c",
            action_plan_type="actionplantype__c",
            playbook_url="playbookurl__c",
            action_plan_status="status__c",
            campaign_id="campaign__c",
        ),
        F.col("campaign.name").alias("campaign_name"),
        F.col("member.id").alias("campaign_member_id"),
        *_people(prefix),
        *linked("contact", "contact__c"),
        *linked("parent_account", "parentaccount__c"),
        *linked("account", "account__c"),
        *_renamed(**{f"{prefix}_lead_id": "lead__c", f"{prefix}_service_id": "service__c"}),
        *_progress_and_audit(prefix),
    )
