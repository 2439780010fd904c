"""The end-to-end datasets and their steps, on the stand-in tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from checks import standins as si
from checks.registry import query
from checks.standins import Standins
from opsloom.functions import calendar as cal
from opsloom.operators.bitmaps import distinct_ids, id_bitmaps
from opsloom.operators.generators import month_spine
from opsloom.operators.relations import union_by_position, zero_fill
from opsloom.plans import activity, agents, cases, chat, crm, experiments, phone, productivity, profitability, weekly
from opsloom.session import fresh_dir
from opsloom.sources.companions import save_companion, touched_on, touched_since
from opsloom.sources.tables import present, read_dataset, save_bucketed, save_dataset

EVENTS = {"as_of": si.EVENTS_AS_OF}
LONG = {**EVENTS, "look_back": si.LONG_LOOK_BACK}
SHORT = {**EVENTS, "look_back": si.SHORT_LOOK_BACK}
ORDERS = {"as_of": si.ORDERS_AS_OF}


# --- activity -------------------------------------------------------------------------------------


@query(
    "month_spine",
    sql="""SELECT index_month, count(bid_id) AS requests FROM month_spine LEFT JOIN (
             SELECT bid_id, cast(date_trunc('month', request_create_time) AS date) AS month FROM contacts) c
           ON month = index_month GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    """Every month of the range with its requests."""
    monthly = t("contacts").groupBy(
        cal.month_of(cal.utc_date(F.col("request_create_time"))).alias("index_month")
    ).agg(F.count("bid_id").alias("requests"))
    spine = month_spine(t.spark, si.PANEL_START, si.ORDERS_AS_OF)
    return spine.join(monthly, "index_month", "left").select("index_month", *zero_fill(["requests"]))


@query("monthly_activity", relation="monthly_activity")
def _(t: Standins) -> DataFrame:
    return activity.monthly_activity(t("contacts"), t("markets"), si.PANEL_START)


@query("first_activity", relation="first_activity")
def _(t: Standins) -> DataFrame:
    return activity.first_activity(t("contacts"), t("markets"))


@query("activity_panel", relation="activity_panel")
def activity_panel(t: Standins) -> DataFrame:
    return activity.activity_panel(t("contacts"), t("markets"), start=si.PANEL_START, **ORDERS)


# --- stints ---------------------------------------------------------------------------------------


def phone_stints(t: Standins) -> DataFrame:
    return agents.phone_stints(t("phone_roster"))


def chat_stints(t: Standins) -> DataFrame:
    return agents.chat_stints(t("weekly_roster"), t("crm_users"))


query("stints_parsed", relation="phone_stints")(phone_stints)
query("stints_weekly", relation="chat_stints")(chat_stints)


@query("agent_day_index", relation="phone_days")
def _(t: Standins) -> DataFrame:
    return agents.agent_days(phone_stints(t), si.EVENTS_AS_OF, si.LONG_LOOK_BACK)


@query("agent_day_index_weekly", relation="chat_days")
def _(t: Standins) -> DataFrame:
    return agents.agent_days(chat_stints(t), si.EVENTS_AS_OF, si.SHORT_LOOK_BACK)


# --- phone ----------------------------------------------------------------------------------------


@query("closed_cases_by_stint", relation="phone_closed")
def _(t: Standins) -> DataFrame:
    return phone.closed_cases(phone_stints(t), t("cases"), **LONG)


@query(
    "status_classifier",
    sql="""SELECT event_time, liveops_system_name_email, agent_presence_state, agent_state_modifier,
           unavailable_reason, work_type, time_bucket, event_date_mt, total_time FROM status_rows""",
)
def _(t: Standins) -> DataFrame:
    rows = phone.classify_status(t("status_log"), corrections=si.CORRECTIONS, **LONG)
    return rows.select(
        "event_time", "liveops_system_name_email", "agent_presence_state", "agent_state_modifier",
        "unavailable_reason", "work_type", "time_bucket", "event_date_mt", "total_time",
    )


@query("bucket_pivot", relation="phone_time")
def _(t: Standins) -> DataFrame:
    return phone.time_in_bucket(phone_stints(t), t("status_log"), corrections=si.CORRECTIONS, **LONG)


@query("survey_histogram", relation="phone_scores")
def _(t: Standins) -> DataFrame:
    return phone.survey_scores(phone_stints(t), t("csat"), **SHORT)


@query("ledger_by_stint", relation="phone_ledger")
def _(t: Standins) -> DataFrame:
    return phone.ledger(phone_stints(t), t("credit_log"), **SHORT)


@query("agent_scorecard", relation="phone_scorecard")
def phone_scorecard(t: Standins) -> DataFrame:
    return phone.phone_scorecard(
        phone_stints(t), t("cases"), t("status_log"), t("csat"), t("credit_log"), corrections=si.CORRECTIONS,
        long_look_back=si.LONG_LOOK_BACK, short_look_back=si.SHORT_LOOK_BACK, **EVENTS,
    )


@query("phone_case_detail", relation="phone_case_detail")
def _(t: Standins) -> DataFrame:
    return cases.phone_case_detail(phone_stints(t), t("cases"), t("case_links"), **SHORT)


# --- chat -----------------------------------------------------------------------------------------


@query("closed_cases_by_day", relation="chat_closed")
def _(t: Standins) -> DataFrame:
    return chat.closed_cases(t("cases"), **SHORT)


@query("bucket_pivot_prefix", relation="chat_time")
def _(t: Standins) -> DataFrame:
    return chat.presence_time(t("presence"), t("presence_status"), **SHORT)


@query("survey_precedence", relation="chat_scores")
def _(t: Standins) -> DataFrame:
    return chat.survey_scores(t("csat"), **SHORT)


@query("ledger_by_type", relation="chat_ledger")
def _(t: Standins) -> DataFrame:
    return chat.ledger(t("credit_log"), **SHORT)


@query("contractor_hours", relation="contractor_hours")
def _(t: Standins) -> DataFrame:
    return chat.contractor_hours(t("contractor_log"))


def chat_scorecard(t: Standins, **demo) -> DataFrame:
    return chat.chat_scorecard(
        chat_stints(t), t("cases"), t("presence"), t("presence_status"), t("csat"), t("credit_log"),
        t("contractor_log"), **SHORT, **demo,
    )


def demo_scorecard(t: Standins) -> DataFrame:
    return chat_scorecard(t, demo_of=si.DEMO_OF, demo_identity=si.DEMO_IDENTITY)


@query("chat_scorecard", relation="chat_scorecard")
def _(t: Standins) -> DataFrame:
    return chat_scorecard(t)


@query("agent_scorecard_cloned", relation="chat_scorecard_cloned")
def _(t: Standins) -> DataFrame:
    return present(demo_scorecard(t), ("index_date", False), "specialist_name")


@query("chat_case_detail", relation="chat_case_detail")
def _(t: Standins) -> DataFrame:
    return cases.chat_case_detail(chat_stints(t), t("cases"), t("case_links"), **SHORT)


@query("case_detail", relation="case_detail")
def _(t: Standins) -> DataFrame:
    """The general form: phone agents with times of the second zone and the long look-back."""
    return cases.case_detail(
        phone_stints(t), t("cases"), t("case_links"), zone_suffix="pht", stint_columns=agents.PHONE_STINT, **LONG
    )


# --- the same datasets over typed companions of the text-dated sources ----------------------------


def case_companion(t: Standins) -> str:
    """Written by a job of its own in use; one companion serves the look-backs of every zone."""
    path = fresh_dir(t.spark, "cases-companion")
    stamps = [f"{n}_time_{z}" for n in ("created", "closed") for z in ("mt", "pht")]
    save_companion(
        t("cases"), path, formats=dict.fromkeys(stamps, cal.ISO_STAMP), touched=["created_time", "closed_time", *stamps]
    )
    return path


def companion_cases(t: Standins, look_back: int) -> DataFrame:
    return touched_since(t.spark, case_companion(t), cal.days_before(si.EVENTS_AS_OF, look_back))


def companion_presence(t: Standins) -> DataFrame:
    path = fresh_dir(t.spark, "presence-companion")
    save_companion(t("presence"), path, formats={"createddate": cal.US_STAMP}, touched=["createddate"])
    return touched_since(t.spark, path, cal.days_before(si.EVENTS_AS_OF, si.SHORT_LOOK_BACK))


@query("closed_cases_by_stint_pruned", relation="phone_closed")
def _(t: Standins) -> DataFrame:
    return phone.closed_cases(phone_stints(t), companion_cases(t, si.LONG_LOOK_BACK), **LONG)


@query("bucket_pivot_prefix_pruned", relation="chat_time")
def _(t: Standins) -> DataFrame:
    return chat.presence_time(companion_presence(t), t("presence_status"), **SHORT)


@query("phone_case_detail_pruned", relation="phone_case_detail")
def _(t: Standins) -> DataFrame:
    return cases.phone_case_detail(phone_stints(t), companion_cases(t, si.SHORT_LOOK_BACK), t("case_links"), **SHORT)


@query("chat_case_detail_pruned", relation="chat_case_detail")
def _(t: Standins) -> DataFrame:
    return cases.chat_case_detail(chat_stints(t), companion_cases(t, si.SHORT_LOOK_BACK), t("case_links"), **SHORT)


@query("agent_scorecard_pruned", relation="phone_scorecard")
def _(t: Standins) -> DataFrame:
    return phone.phone_scorecard(
        phone_stints(t), companion_cases(t, si.LONG_LOOK_BACK), t("status_log"), t("csat"), t("credit_log"),
        corrections=si.CORRECTIONS, long_look_back=si.LONG_LOOK_BACK, short_look_back=si.SHORT_LOOK_BACK, **EVENTS,
    )


@query("chat_scorecard_pruned", relation="chat_scorecard")
def _(t: Standins) -> DataFrame:
    return chat.chat_scorecard(
        chat_stints(t), companion_cases(t, si.SHORT_LOOK_BACK), companion_presence(t), t("presence_status"), t("csat"),
        t("credit_log"), t("contractor_log"), **SHORT,
    )


@query(
    "cases_on_team_start_days",
    sql="""SELECT c.case_id, c.case_number FROM cases c JOIN (SELECT DISTINCT date_team_start AS d FROM phone_stints WHERE emp_lvl = '1') s
           ON s.d = cast(greatest(c.created_time, c.closed_time, strptime(c.created_time_mt, '%Y-%m-%d %H:%M:%S'),
             strptime(c.closed_time_mt, '%Y-%m-%d %H:%M:%S'), strptime(c.created_time_pht, '%Y-%m-%d %H:%M:%S'),
             strptime(c.closed_time_pht, '%Y-%m-%d %H:%M:%S')) AS date)""",
)
def _(t: Standins) -> DataFrame:
    """Cases last touched on a day that a first-level agent joined a team; partitions are picked at run time."""
    starts = phone_stints(t).filter(F.col("emp_lvl") == "1")
    return touched_on(t.spark, case_companion(t), starts, "date_team_start").select("case_id", "case_number")


# --- productivity and weekly board ----------------------------------------------------------------


def team_days(t: Standins, surveys: bool = True) -> DataFrame:
    """Each scorecard is read by one branch, cut down to the columns that the roll-up needs."""
    return productivity.team_days(
        phone_scorecard(t), demo_scorecard(t), excluded_emails=si.EXCLUDED_EMAILS, surveys=surveys
    )


@query("team_productivity", relation="team_days")
def _(t: Standins) -> DataFrame:
    return present(team_days(t), "team_name", "index_date")


def _visitors(t: Standins) -> DataFrame:
    return weekly.weekly_visitors(t("visits"), start=si.BOARD_START)


def _requests(t: Standins) -> DataFrame:
    return weekly.weekly_requests(t("site_requests"), start=si.BOARD_START)


def _contacts(t: Standins) -> DataFrame:
    return weekly.weekly_contacts(t("site_contacts"), start=si.BOARD_START)


def _case_mix(t: Standins) -> DataFrame:
    return weekly.weekly_case_mix(t("cases"), start=si.BOARD_START)


def _top_two(t: Standins) -> DataFrame:
    return weekly.weekly_top_two(t("cases"), start=si.SURVEY_START)


def _cases_per_hour(t: Standins) -> DataFrame:
    return weekly.weekly_cases_per_hour(team_days(t, surveys=False))


query("weekly_visitors", relation="weekly_visitors")(_visitors)
query("weekly_requests", relation="weekly_requests")(_requests)
query("weekly_contacts", relation="weekly_contacts")(_contacts)
query("weekly_case_mix", relation="weekly_case_mix")(_case_mix)
query("weekly_top2_rate", relation="weekly_top2_rate")(_top_two)
query("weekly_cph", relation="weekly_cph")(_cases_per_hour)


@query("weekly_board", relation="weekly_board")
def _(t: Standins) -> DataFrame:
    board = weekly.weekly_board(
        _visitors(t), _requests(t), _contacts(t), _case_mix(t), _top_two(t), _cases_per_hour(t),
        t("support_costs"), start=si.BOARD_START, **EVENTS,
    )
    return present(board, "week")


# --- the same from stored bitmaps and bucketed scorecards -----------------------------------------


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, label)
    save_dataset(df, path)
    return read_dataset(df.sparkSession, path)


@query("weekly_visitors_from_bitmaps", relation="weekly_visitors")
def _(t: Standins) -> DataFrame:
    """Daily bitmaps written by one job and merged into weeks by the next."""
    return weekly.weekly_visitors_from_bitmaps(_stored(weekly.visitor_bitmaps(t("visits"), start=si.BOARD_START), "visitors"))


@query(
    "visitors_by_period",
    sql="""SELECT 'day' AS period, visit_date AS first_day, count(DISTINCT visitor_pk) AS visitors FROM visits WHERE ip_sessions < 100 GROUP BY 2
        UNION ALL SELECT 'week', date_trunc('week', visit_date)::date, count(DISTINCT visitor_pk) FROM visits WHERE ip_sessions < 100 GROUP BY 2
        UNION ALL SELECT 'month', date_trunc('month', visit_date)::date, count(DISTINCT visitor_pk) FROM visits WHERE ip_sessions < 100 GROUP BY 2""",
)
def _(t: Standins) -> DataFrame:
    """Days, weeks and months from one set of daily bitmaps."""
    daily = _stored(weekly.visitor_bitmaps(t("visits"), start=date(2000, 1, 1)), "visitors")
    day = F.col("visit_date")
    periods = {"day": day, "week": cal.week_of(day), "month": cal.month_of(day)}
    counts = [distinct_ids(daily, [p.alias("first_day")], "visitors").select(F.lit(n).alias("period"), "first_day", "visitors") for n, p in periods.items()]
    return union_by_position(*counts)


@query(
    "exposed_users_rolled_up",
    sql="""SELECT experiment_id, bucket_id, count(DISTINCT user_id) AS users FROM user_assignments WHERE user_id IS NOT NULL GROUP BY ALL
        UNION ALL SELECT experiment_id, 'all buckets', count(DISTINCT user_id) FROM user_assignments WHERE user_id IS NOT NULL GROUP BY ALL""",
)
def _(t: Standins) -> DataFrame:
    """Users per arm, and per experiment over all arms, from the arms' bitmaps."""
    arms = _stored(id_bitmaps(t("user_assignments"), ["experiment_id", "bucket_id"], "user_id"), "arms")
    per_arm = distinct_ids(arms, ["experiment_id", "bucket_id"], "users")
    per_experiment = distinct_ids(arms, ["experiment_id"], "users")
    return union_by_position(per_arm, per_experiment.select("experiment_id", F.lit("all buckets"), "users"))


def bucketed(df: DataFrame, label: str) -> DataFrame:
    """A scorecard stored by a job of its own, dealt out by day."""
    path = fresh_dir(df.sparkSession, label)
    table = "opsloom_" + path.rsplit("/", 1)[1].replace("-", "_")
    save_bucketed(df, table, by=["index_date"], buckets=8, path=path)
    return df.sparkSession.table(table)


def stored_team_days(t: Standins, surveys: bool = True) -> DataFrame:
    return productivity.team_days(
        bucketed(phone_scorecard(t), "phone-card"), bucketed(demo_scorecard(t), "chat-card"),
        excluded_emails=si.EXCLUDED_EMAILS, surveys=surveys,
    )


@query("team_productivity_bucketed", relation="team_days")
def _(t: Standins) -> DataFrame:
    return present(stored_team_days(t), "team_name", "index_date")


@query("weekly_board_bucketed", relation="weekly_board")
def _(t: Standins) -> DataFrame:
    per_hour = weekly.weekly_cases_per_hour(stored_team_days(t, surveys=False))
    board = weekly.weekly_board(
        _visitors(t), _requests(t), _contacts(t), _case_mix(t), _top_two(t), per_hour, t("support_costs"),
        start=si.BOARD_START, **EVENTS,
    )
    return present(board, "week")


# --- experiments ----------------------------------------------------------------------------------


def all_cases(t: Standins) -> DataFrame:
    columns = ["user_id", "created_time", "case_id", "first_contact_channel", "auto_response", "case_subcategory"]
    return t("cases").select(*columns).unionByName(t("order_cases").select(*columns))


@query("experiment_bounds", relation="experiment_bounds")
def _(t: Standins) -> DataFrame:
    return experiments.experiment_bounds(t("user_assignments"))


@query("user_buckets", relation="user_buckets")
def _(t: Standins) -> DataFrame:
    return experiments.user_buckets(t("user_assignments"))


@query("experiment_user_arms", relation="experiment_user_arms")
def _(t: Standins) -> DataFrame:
    return experiments.user_arms(t("user_assignments"), all_cases(t))


@query("request_users", relation="request_users")
def _(t: Standins) -> DataFrame:
    return experiments.request_exposure(t("request_assignments"), t("request_quotes"))


@query("unified_exposure", relation="unified_exposure")
def _(t: Standins) -> DataFrame:
    return experiments.unified_exposure(t("request_assignments"), t("request_quotes"))


@query("exposure_weights", relation="exposure_weights")
def _(t: Standins) -> DataFrame:
    return experiments.exposure_weights(experiments.unified_exposure(t("request_assignments"), t("request_quotes")))


@query("experiment_request_arms", relation="experiment_request_arms")
def _(t: Standins) -> DataFrame:
    return experiments.request_arms(t("request_assignments"), t("request_quotes"), all_cases(t))


@query("experiment_report", relation="experiment_report")
def _(t: Standins) -> DataFrame:
    return experiments.experiment_report(
        t("user_assignments"), t("request_assignments"), t("request_quotes"), all_cases(t)
    )


# --- profitability --------------------------------------------------------------------------------


@query("pro_measures", relation="pro_measures")
def _(t: Standins) -> DataFrame:
    return profitability.pro_measures(t("quotes"), si.ORDERS_AS_OF)


@query("support_volume", relation="support_volume")
def _(t: Standins) -> DataFrame:
    return profitability.support_volume(t("order_cases"), si.ORDERS_AS_OF)


@query("reference_prices", relation="reference_prices")
def _(t: Standins) -> DataFrame:
    return profitability.reference_prices(t("quotes"), si.ORDERS_AS_OF)


def profits(t: Standins) -> DataFrame:
    return profitability.profitability(t("pros"), t("quotes"), t("order_cases"), **ORDERS)


query("profitability", relation="profitability")(profits)


@query("unprofitable_flags", relation="unprofitable_flags")
def _(t: Standins) -> DataFrame:
    return profitability.unprofitable_flags(profits(t), t("segments"), **ORDERS)


# --- CRM ------------------------------------------------------------------------------------------


@query("typed_plan", relation="typed_plan")
def _(t: Standins) -> DataFrame:
    return crm.typed_plans(t("action_plans"), t("plan_users"))


def typed_plan_view(t: Standins) -> DataFrame:
    return crm.typed_plans_view(
        t("action_plans"), t("plan_users"), t("crm_contacts"), t("crm_contacts"), t("campaigns"),
        t("campaign_members"), excluded_templates=si.EXCLUDED_TEMPLATES,
    )


query("typed_plan_view", relation="typed_plan_view")(typed_plan_view)
