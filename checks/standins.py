"""Source tables of the datasets, derived row by row from the driver tables.

Every table is one SELECT in SQL that Spark and DuckDB both run; ``@name`` stands for a driver table and
``Dialect`` fills in the few functions that the engines spell differently. NULLs, bad text, overlaps and
repeats are put in by expression, so that the paths they exercise are reached on every scale factor.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from opsloom.sources.tables import read_table

EVENTS_AS_OF = date(2024, 1, 31)
ORDERS_AS_OF = date(2001, 8, 1)
LONG_LOOK_BACK = 25
SHORT_LOOK_BACK = 15
PANEL_START = date(1995, 3, 1)
BOARD_START = date(2024, 1, 1)
SURVEY_START = date(2024, 1, 8)
EMAIL_DOMAIN = "@desk.example"
CORRECTIONS = {"agent3@desk.exampl": "agent3@desk.example"}
EXCLUDED_EMAILS = ["agent5@desk.example", "viewer@desk.example"]
DEMO_OF = "agent4@desk.example"
DEMO_IDENTITY = {
    "specialist_name": "Demo Viewer", "email_address": "viewer@desk.example", "manager_name": "Demo Manager",
}
EXCLUDED_TEMPLATES = ["T2", "T5"]


_DRIVER_TABLE = re.compile(r"(?<![\w'])@(events|customer|orders|lineitem|nation|region|supplier|part)\b")


@dataclass(frozen=True)
class Dialect:
    iso: str
    us: str
    us_day: str
    local: str
    ms: str
    plus_hours: str
    week: str
    stamp: str


SPARK = Dialect(
    iso="date_format({0}, 'yyyy-MM-dd HH:mm:ss')",
    us="date_format({0}, 'MM/dd/yyyy HH:mm:ss')",
    us_day="date_format({0}, 'MM/dd/yyyy')",
    local="convert_timezone('UTC', '{1}', {0})",
    ms="unix_millis(cast({0} as timestamp))",
    plus_hours="({0} + make_dt_interval(0, cast({1} as int)))",
    week="trunc({0}, 'week')",
    stamp="TIMESTAMP_NTZ '{0}'",
)
DUCKDB = Dialect(
    iso="strftime({0}, '%Y-%m-%d %H:%M:%S')",
    us="strftime({0}, '%m/%d/%Y %H:%M:%S')",
    us_day="strftime({0}, '%m/%d/%Y')",
    local="(({0}) AT TIME ZONE 'UTC' AT TIME ZONE '{1}')",
    ms="(epoch_us({0}) // 1000)",
    plus_hours="({0} + to_hours(cast({1} as int)))",
    week="cast(date_trunc('week', {0}) as date)",
    stamp="TIMESTAMP '{0}'",
)


def _texts(d: Dialect) -> dict[str, str]:
    def iso(ts):
        return d.iso.format(ts)

    def us(ts):
        return d.us.format(ts)

    def mt(ts):
        return d.local.format(ts, "America/Denver")

    def pht(ts):
        return d.local.format(ts, "Asia/Manila")

    def ms(ts):
        return d.ms.format(ts)

    def later(ts, hours):
        return d.plus_hours.format(ts, hours)

    def stamp(literal):
        return d.stamp.format(literal)

    def text(x):
        return f"cast({x} as string)"

    k_events = "(SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) AS k FROM @events) e"
    closed = f"CASE WHEN k % 13 <> 0 THEN {later('ts', 'k')} END"
    offered = f"CASE WHEN k % 3 <> 0 THEN {later('ts', '1 + k')} END"
    answered = f"CASE WHEN k % 3 = 1 THEN {later('ts', '2 + k * 3')} END"
    email = f"'agent' || {text('{0}')} || '{EMAIL_DOMAIN}'"
    t = {}

    t["cases"] = f"""
        SELECT 'C' || {text('event_id')} AS case_id, event_id AS case_number, user_id * 3 AS user_id, ts AS created_time,
          {closed} AS closed_time,
          {iso(mt('ts'))} AS created_time_mt, {iso(mt(closed))} AS closed_time_mt,
          {iso(pht('ts'))} AS created_time_pht, {iso(pht(closed))} AS closed_time_pht,
          CASE k % 8 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Email' WHEN 2 THEN 'Chat' WHEN 3 THEN 'SMS'
            WHEN 4 THEN 'Directly Question' WHEN 5 THEN 'In-Product' WHEN 6 THEN 'Fax' END AS first_contact_channel,
          CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 10 = 1 END AS auto_response,
          CASE k % 9 WHEN 0 THEN 'Marketplace Integrity' WHEN 1 THEN NULL ELSE 'Account' END AS case_category,
          CASE k % 11 WHEN 0 THEN 'Noise' WHEN 1 THEN NULL ELSE 'Billing' END AS case_subcategory,
          'A' || {text('user_id')} AS case_owner_agent_id,
          CASE k % 11 WHEN 2 THEN 'Noise' WHEN 3 THEN NULL ELSE 'Desk' END AS case_owner_agent_team,
          CASE WHEN event_id % 17 = 0 THEN 'C' || {text('event_id - 1')} END AS duplicate_case_id,
          CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN event_id % 7 END AS pro_segment_group_id,
          'V' || {text('event_id')} AS csat_id, 'A' || {text('user_id')} AS csat_owner_agent_id,
          k % 3 <> 0 AS csat_survey_offered,
          CASE WHEN k % 3 = 0 THEN 'recently asked' END AS csat_survey_not_offered_reason,
          {iso(mt(offered))} AS csat_created_time_mt, {iso(pht(offered))} AS csat_created_time_pht,
          {offered} AS csat_offered_time,
          {iso(mt(offered))} AS csat_offered_time_mt, {iso(pht(offered))} AS csat_offered_time_pht,
          {answered} AS csat_response_time,
          {iso(mt(answered))} AS csat_response_time_mt, {iso(pht(answered))} AS csat_response_time_pht,
          CASE WHEN k % 3 = 1 THEN k % 5 + 1 END AS csat_score,
          CASE WHEN k % 3 = 1 AND k % 7 <> 2 THEN (k * 3 + user_id) % 5 + 1 END AS likely_continue_using_score,
          k % 4 + 1 AS easy_to_handle_issue_score, k % 2 AS less_time_than_expected_score,
          (k + 1) % 2 AS issue_resolved_score, k % 3 + 1 AS number_interactions_to_resolution,
          CASE WHEN k % 19 = 0 THEN 'audit' END AS csat_audit_exception_reason,
          k % 2 = 0 AS pro_contact_info_captured, event_type AS csat_comments
        FROM {k_events}"""

    t["csat"] = f"""
        SELECT 'A' || {text('user_id')} AS csat_owner_id, ts AS csat_created_time,
          {answered} AS csat_response_time, {iso(mt(answered))} AS csat_response_time_mt,
          CASE WHEN k % 3 = 1 THEN k % 5 + 1 END AS csat_score,
          CASE WHEN k % 7 <> 2 THEN (k * 3 + user_id) % 5 + 1 END AS likely_continue_using_score,
          CASE k % 4 WHEN 0 THEN 'In-Product' WHEN 1 THEN NULL ELSE 'Phone' END AS csat_case_origin
        FROM {k_events}"""

    t["status_log"] = f"""
        SELECT CASE WHEN user_id = 3 THEN 'agent3@desk.exampl (desk)'
            ELSE {email.format('user_id')} || ' (desk)' END AS agent_system_name,
          CASE k % 5 WHEN 0 THEN 'BUSY' WHEN 1 THEN 'IDLE' WHEN 2 THEN 'NOTREADY' WHEN 3 THEN 'OFFLINE'
            ELSE 'SIGNON' END AS agent_presence_state,
          CASE k % 11 WHEN 0 THEN 'WrapUp' WHEN 1 THEN 'Hold' WHEN 2 THEN 'Pinned' WHEN 3 THEN NULL
            WHEN 4 THEN 'Hold+Pinned' WHEN 5 THEN 'Paused' WHEN 6 THEN 'WrapUp+Hold' WHEN 7 THEN 'WrapUp+Pinned'
            ELSE 'None' END AS agent_state_modifier,
          CASE event_id % 19 WHEN 0 THEN 'Logged On as Unavailable' WHEN 1 THEN 'Last Call' WHEN 2 THEN 'Break'
            WHEN 3 THEN 'Meeting' WHEN 4 THEN 'Coaching' WHEN 5 THEN 'Training' WHEN 6 THEN 'Chat'
            WHEN 7 THEN 'Special_Projects' WHEN 8 THEN 'Lunch' WHEN 9 THEN 'Something Else'
            WHEN 10 THEN 'Terminating Duplicate Agent Connection' WHEN 11 THEN 'System: Presence Server Recycle'
            WHEN 12 THEN 'No Phone Connection' WHEN 13 THEN 'Set Offline by Supervisor' END AS unavailable_reason,
          CASE event_id % 4 WHEN 0 THEN 'Inbound' WHEN 1 THEN 'Dial-out' WHEN 2 THEN 'Outbound' END AS work_type,
          ts AS event_time, CASE WHEN k <> 77 THEN k + event_id % 7 END AS total_time
        FROM {k_events}"""

    t["presence"] = f"""
        SELECT {us('ts')} AS createddate, 'A' || {text('user_id')} AS ownerid,
          'S' || {text('k % 27')} AS servicepresencestatusid, {text('k * 30 + event_id % 60')} AS statusduration
        FROM {k_events}"""

    t["presence_status"] = """
        SELECT 'S' || cast(n_nationkey as string) AS id,
          CASE n_nationkey % 16 WHEN 0 THEN 'Offline' WHEN 1 THEN 'Online' WHEN 2 THEN 'Coaching' WHEN 3 THEN 'Lunch'
            WHEN 4 THEN 'Break' WHEN 5 THEN 'Away' WHEN 6 THEN 'Away (Deprecated)' WHEN 7 THEN 'Training'
            WHEN 8 THEN 'Meeting' WHEN 9 THEN 'Follow Up' WHEN 10 THEN 'Wrap Up (Break)'
            WHEN 11 THEN 'Wrap Up (End of shift)' WHEN 12 THEN 'Online - Chat' WHEN 13 THEN 'Online - SMS'
            WHEN 14 THEN NULL ELSE 'Other' END AS masterlabel
        FROM @nation"""

    t["crm_users"] = f"""
        SELECT 'A' || {text('c_custkey')} AS id, {email.format('c_custkey')} AS email,
          CASE WHEN c_nationkey = 12 THEN '0' ELSE '1' END AS isactive
        FROM @customer"""

    t["phone_roster"] = f"""
        SELECT CASE WHEN c_nationkey <> 7 THEN c_mktsegment END AS preferred_first_name,
          c_name AS preferred_last_name, {email.format('c_custkey')} AS email_address,
          CASE WHEN c_custkey % 23 <> 0 THEN {text('c_custkey')} END AS liveops_id,
          CASE WHEN c_custkey % 29 = 0 THEN 'x' || {text('c_custkey')} ELSE {text('c_custkey')} END AS tt_admin_id,
          'A' || {text('c_custkey')} AS salesforce_id_18,
          CASE c_nationkey % 5 WHEN 0 THEN 'IBEX' WHEN 1 THEN NULL
            ELSE 'Manager ' || {text('c_nationkey')} END AS manager_name,
          {text("DATE '2023-12-20' + cast(c_custkey % 30 + stint * 10 as int)")} AS team_start_date,
          CASE WHEN c_custkey % 31 <> 0
            THEN {text("DATE '2024-01-01' + cast(c_custkey % 37 + stint * 5 as int)")} END AS team_end_date,
          CASE WHEN c_nationkey % 4 = 0 THEN '2' ELSE '1' END AS emp_lvl,
          'Team ' || {text('c_nationkey % 4')} AS team_name,
          CASE c_nationkey % 6 WHEN 0 THEN '6' WHEN 1 THEN '8' WHEN 2 THEN '11' WHEN 3 THEN '16'
            WHEN 4 THEN '8' ELSE '99' END AS team_id
        FROM (SELECT *, 0 AS stint FROM @customer
              UNION ALL SELECT *, 1 AS stint FROM @customer WHERE c_acctbal > 5000) c"""

    week = d.week.format("cast(ts as date)")
    t["weekly_roster"] = f"""
        SELECT user_id AS empID, 'Agent ' || {text('user_id')} AS name, 'a' || {text('user_id')} AS shortname,
          {email.format('user_id')} AS email, DATE '2020-01-01' + cast(user_id as int) AS hired_date,
          CASE WHEN user_id % 6 <> 0 THEN 'a' || {text('user_id % 10')} END AS manager,
          'Head ' || {text('user_id % 3')} AS manager_three,
          CASE (user_id + CASE WHEN user_id % 7 = 0 AND week_start >= DATE '2024-01-15' THEN 1 ELSE 0 END) % 4
            WHEN 0 THEN 'TPH Email' WHEN 1 THEN 'TPH Chat' WHEN 2 THEN 'TPH SMS' ELSE 'Quality' END AS tier,
          CASE WHEN user_id % 5 <> 0 THEN 'Contractor ' || {text('user_id')} END AS upwork, week_start
        FROM (SELECT DISTINCT user_id, {week} AS week_start FROM @events) w"""

    t["contractor_log"] = f"""
        SELECT {d.us_day.format('ts')} AS date, 'CONTRACTOR ' || {text('user_id')} AS full_name,
          CASE WHEN k % 5 <> 0 THEN k * 0.25E0 END AS total_hours
        FROM {k_events}"""

    t["credit_log"] = f"""
        SELECT event_id AS cre_credit_log_id, user_id + k % 3 AS cre_usr_user_id,
          user_id AS cre_performing_usr_user_id, {ms('ts')} AS cre_timestamp, k % 9 AS cre_transaction_type,
          k * 10 AS cre_adjustment_paid_cents,
          CASE WHEN event_id % 19 <> 0 THEN k + 5 END AS cre_adjustment_promotional_cents
        FROM {k_events}"""

    t["case_links"] = f"""
        SELECT 'C' || {text('event_id')} AS id, 'https://desk.example/case/' || {text('event_id')} AS caseconsolelink__c
        FROM @events WHERE event_type <> 'signup'"""

    t["visits"] = f"""
        SELECT cast(ts as date) AS visit_date, cast(ts as date) AS partition_date, user_id AS visitor_pk,
          k + 20 AS ip_sessions
        FROM {k_events}"""

    t["site_requests"] = """
        SELECT CASE WHEN event_id % 21 <> 0 THEN event_id END AS request_id, ts AS create_time
        FROM @events WHERE event_type IN ('view', 'signup', 'purchase')"""

    t["site_contacts"] = f"""
        SELECT event_id AS bid_id, CASE WHEN k % 15 <> 0 THEN {later('ts', 'k')} END AS first_customer_contact_time
        FROM {k_events}"""

    t["support_costs"] = f"""
        SELECT week, CASE WHEN n % 2 = 0 THEN n * 3 END AS tsl_costs, CASE WHEN n % 3 <> 0 THEN n * 2 END AS ibex_costs,
          n AS tph_costs
        FROM (SELECT {week} AS week, count(*) AS n FROM @events WHERE event_type = 'error'
              GROUP BY {week}) w"""

    t["user_assignments"] = f"""
        SELECT event_type AS experiment_id,
          CASE WHEN k < 5 THEN {text('1 - user_id % 2')} ELSE {text('user_id % 2')} END AS bucket_id,
          user_id, {ms('ts')} AS assignment_time,
          CASE event_type WHEN 'view' THEN {ms(stamp("2024-01-20 12:00:00"))}
            WHEN 'click' THEN {ms(stamp("2024-01-10 00:00:00"))} END AS experiment_stop_time
        FROM {k_events}"""

    t["request_assignments"] = f"""
        SELECT o_orderpriority || ' ' || o_orderstatus AS experiment_id,
          CASE WHEN o_custkey % 41 <> 0 THEN {text('o_orderkey % 2')} END AS bucket_id, o_orderkey AS request_id,
          {ms('o_orderdate')} AS assignment_time,
          CASE o_orderstatus WHEN 'F' THEN {ms(stamp("2000-06-01 00:00:00"))} END AS experiment_stop_time
        FROM @orders"""

    t["request_quotes"] = """
        SELECT l_orderkey AS request_id, CASE WHEN l_linenumber <> 7 THEN l_partkey END AS pro_user_id,
          CASE WHEN o_custkey % 43 <> 0 THEN o_custkey END AS customer_id
        FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey"""

    t["order_cases"] = f"""
        SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 35 = 0 THEN 'O' || {text('o_orderkey - 1')}
            ELSE 'O' || {text('o_orderkey')} END AS case_id,
          o_orderkey AS case_number, o_custkey AS user_id,
          {later('o_orderdate', '(o_orderkey % 400) * 24 + 7')} AS created_time,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Phone' WHEN '2-HIGH' THEN 'Email' WHEN '3-MEDIUM' THEN 'Chat'
            WHEN '5-LOW' THEN 'Letter' END AS first_contact_channel,
          CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 10 = 1 END AS auto_response,
          CASE o_orderkey % 11 WHEN 0 THEN 'Noise' WHEN 1 THEN NULL ELSE 'Billing' END AS case_subcategory,
          CASE o_orderkey % 11 WHEN 2 THEN 'Noise' WHEN 3 THEN NULL ELSE 'Desk' END AS case_owner_agent_team
        FROM @orders"""

    t["contacts"] = f"""
        SELECT o_orderkey AS bid_id, CASE WHEN o_orderkey % 501 <> 0 THEN o_custkey END AS pro_user_id,
          CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate END AS first_customer_contact_time,
          {later('o_orderdate', '-24 * (o_orderkey % 60)')} AS request_create_time,
          CASE WHEN o_orderstatus <> 'P' THEN cast(round(o_totalprice * 100) as bigint) END AS revenue,
          cast(o_orderkey % 25 as int) AS category_id, cast(o_custkey % 5 as int) AS cbsa_id
        FROM @orders"""

    t["markets"] = f"""
        SELECT n_nationkey AS category_id, n_regionkey AS cbsa_id,
          CASE WHEN n_nationkey % 4 <> 1 THEN {stamp('1998-01-01 00:00:00')} END AS enabled_timestamp
        FROM @nation
        UNION ALL
        SELECT n_nationkey, CASE n_regionkey WHEN 3 THEN 3 ELSE (n_regionkey + 2) % 5 END,
          {stamp('1999-01-01 00:00:00')}
        FROM @nation WHERE n_regionkey >= 2"""

    t["quotes"] = f"""
        SELECT CASE WHEN o_orderkey % 53 <> 0 THEN o_orderkey END AS bid_id, o_custkey AS pro_user_id,
          CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus = 'O' END AS pay_per_customer_contact,
          CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS first_intentful_ppc_contact_time,
          CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS first_positive_customer_interaction_time,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority = '5-LOW' END AS refunded,
          CASE WHEN o_orderstatus = 'F' THEN 0 ELSE cast(round(o_totalprice / 10000) as bigint) END AS revenue,
          CASE o_orderstatus WHEN 'P' THEN cast(round(o_totalprice / 10000) as bigint) WHEN 'F' THEN 0 END AS revenue_ppq,
          CASE o_orderstatus WHEN 'O' THEN cast(round(o_totalprice / 10000) as bigint) WHEN 'F' THEN 0 END AS revenue_ppc,
          o_orderdate AS sent_time
        FROM @orders"""

    t["pros"] = f"""
        SELECT c_custkey AS pro_user_id,
          CASE WHEN c_custkey % 47 <> 0
            THEN {later(stamp("1995-02-01 00:00:00"), '24 * (c_custkey * 13 % 2300)')} END AS first_service_create_time
        FROM @customer"""

    t["segments"] = """
        SELECT c_custkey AS pro_user_id, CASE WHEN c_nationkey <> 3 THEN c_nationkey % 8 END AS group_id
        FROM @customer WHERE c_acctbal > 200"""

    plan_times = [
        ("createddate", "0"), ("planstartdate__c", "24"), ("planenddate__c", "24 * 30"),
        ("lastmodifieddate", "36"), ("lastactivitydate", "48"), ("lastreferenceddate", "60"),
        ("lastvieweddate", "61"), ("systemmodstamp", "62"),
    ]
    sparse_times = [
        ("expirationdate__c", "24 * 90", 6), ("lastcheckindate__c", "24 * 7", 4), ("lastattempt__c", "24 * 8", 3),
        ("nextcallscheduled__c", "24 * 14", 5),
    ]
    t["action_plans"] = f"""
        SELECT 'P' || {text('o_orderkey')} AS id, 'AP-' || {text('o_orderkey')} AS actionplannumber__c,
          {', '.join(f"{us(later('o_orderdate', h))} AS {c}" for c, h in plan_times)},
          {', '.join(f"CASE WHEN o_orderkey % {m} <> 0 THEN {us(later('o_orderdate', h))} END AS {c}"
                     for c, h, m in sparse_times)},
          CASE WHEN o_orderkey % 9 <> 0 THEN 'T' || {text('o_orderkey % 8')} END AS actionplantemplate__c,
          'Template ' || {text('o_orderkey % 8')} AS actionplantemplatename__c, o_orderpriority AS actionplantype__c,
          'https://desk.example/play/' || {text('o_orderkey % 8')} AS playbookurl__c, o_orderstatus AS status__c,
          'G' || {text('o_orderkey % 27')} AS campaign__c, 'U' || {text('o_custkey')} AS createdbyid,
          'U' || {text('o_orderkey % 1700')} AS ownerid,
          CASE WHEN o_orderkey % 8 <> 0 THEN 'U' || {text('o_custkey % 100')} END AS lastmodifiedbyid,
          CASE WHEN o_orderkey % 3 <> 0 THEN 'K' || {text('o_custkey')} END AS contact__c,
          'K' || {text('o_orderkey % 1600')} AS parentaccount__c, 'K' || {text('o_custkey')} AS account__c,
          'L' || {text('o_orderkey')} AS lead__c, 'S' || {text('o_orderkey')} AS service__c,
          CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE {text('o_orderkey % 12')} || '.0' END AS totalnumberofactionitems__c,
          {text('o_orderkey % 5')} AS numberofcompleteactionitems__c,
          CASE WHEN o_orderkey % 14 = 0 THEN '' ELSE {text('o_orderkey % 100')} || '.5' END AS percentcomplete__c,
          'R' || {text('o_orderkey % 3')} AS recordtypeid,
          CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' END AS isdeleted,
          CASE o_orderkey % 10 WHEN 0 THEN '1' WHEN 1 THEN NULL ELSE '0' END AS istestdata__c,
          o_orderpriority AS description__c, o_orderstatus AS progoals__c
        FROM @orders"""

    t["plan_users"] = f"""
        SELECT 'U' || {text('c_custkey')} AS crm_user_id, c_mktsegment AS user_first_name,
          CASE WHEN c_nationkey <> 4 THEN c_name END AS user_last_name
        FROM @customer"""

    t["crm_contacts"] = f"""
        SELECT 'K' || {text('c_custkey')} AS id,
          CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN {text('c_custkey')} || '.6'
            ELSE {text('c_custkey')} || '.0' END AS usr_user_id__c,
          CASE c_custkey % 4 WHEN 0 THEN 'none' ELSE {text('c_custkey * 7')} END AS user_pk_id__c
        FROM @customer"""

    t["campaigns"] = """
        SELECT 'G' || cast(n_nationkey as string) AS id, n_name AS name FROM @nation"""

    t["campaign_members"] = f"""
        SELECT 'M' || {text('c_custkey')} || '-' || {text('n_nationkey')} AS id, 'K' || {text('c_custkey')} AS contactid,
          'G' || {text('n_nationkey')} AS campaignid
        FROM @customer JOIN @nation ON n_regionkey = c_nationkey % 5"""
    return t


def duckdb_texts() -> dict[str, str]:
    """The stand-ins as DuckDB SQL over the driver's views."""
    return {name: _DRIVER_TABLE.sub(r"\1", text) for name, text in _texts(DUCKDB).items()}


class Standins:
    """Stand-in tables of one scale factor as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._texts = spark, sf_dir, _texts(SPARK)

    def driver(self, name: str) -> DataFrame:
        return read_table(self.spark, self._dir, name)

    def __call__(self, name: str) -> DataFrame:
        tables = sorted(set(_DRIVER_TABLE.findall(self._texts[name])))
        text = _DRIVER_TABLE.sub(r"{\1}", self._texts[name])
        return self.spark.sql(text, **{t: self.driver(t) for t in tables})

