"""Stints, scorecards, case detail, productivity and the weekly board on hand-made rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.plans import agents, cases as case_plans, chat, phone, productivity, weekly
from opsloom.plans.agents import CHAT_STINT, PHONE_STINT
from opsloom.plans.phone import PHONE_MEASURES
from tests.conftest import one, rows

AS_OF = date(2018, 6, 30)
STINTS = (
    "specialist_name string, email_address string, liveops bigint, tt_admin_id string, salesforce_id_18 string,"
    " manager_name string, date_team_start date, date_team_end date, emp_lvl string, team_name string"
)


def stint(agent="A1", start=date(2018, 6, 1), end=date(2018, 6, 30), liveops=1, admin="1", manager="M", **more):
    row = dict(specialist_name=agent, email_address=f"{agent}@desk.example", liveops=liveops, tt_admin_id=admin,
               salesforce_id_18=agent, manager_name=manager, date_team_start=start, date_team_end=end, emp_lvl="1",
               team_name="T", **more)
    return tuple(row[c] for c in PHONE_STINT)


CASE_FIELDS = {
    "case_id": "string", "case_number": "bigint", "user_id": "bigint", "created_time": "timestamp_ntz",
    "closed_time": "timestamp_ntz", "created_time_mt": "string", "closed_time_mt": "string",
    "created_time_pht": "string", "closed_time_pht": "string", "first_contact_channel": "string",
    "auto_response": "boolean", "case_category": "string", "case_subcategory": "string",
    "case_owner_agent_id": "string", "case_owner_agent_team": "string", "duplicate_case_id": "string",
    "pro_segment_group_id": "bigint", "csat_id": "string", "csat_owner_agent_id": "string",
    "csat_survey_offered": "boolean", "csat_survey_not_offered_reason": "string", "csat_created_time_mt": "string",
    "csat_created_time_pht": "string", "csat_offered_time": "timestamp_ntz", "csat_offered_time_mt": "string",
    "csat_offered_time_pht": "string", "csat_response_time": "timestamp_ntz", "csat_response_time_mt": "string",
    "csat_response_time_pht": "string", "csat_score": "bigint", "likely_continue_using_score": "bigint",
    "easy_to_handle_issue_score": "bigint", "less_time_than_expected_score": "bigint", "issue_resolved_score": "bigint",
    "number_interactions_to_resolution": "bigint", "csat_audit_exception_reason": "string",
    "pro_contact_info_captured": "boolean", "csat_comments": "string",
}


@pytest.fixture
def make_cases(make):
    def build(*given):
        base = {"first_contact_channel": "Phone", "auto_response": False, "case_owner_agent_id": "A1"}
        return make(
            ", ".join(f"{k} {v}" for k, v in CASE_FIELDS.items()),
            *[tuple({**base, **g}.get(c) for c in CASE_FIELDS) for g in given],
        )

    return build


# --- stints ---------------------------------------------------------------------------------------


def test_weekly_snapshots_bridge_gaps_and_absorb_repeats(make):
    weeks = [date(2018, 1, 1) + timedelta(weeks=w) for w in range(5)]
    schema = (
        "week_start date, empID bigint, name string, shortname string, email string, hired_date date, manager string,"
        " manager_three string, tier string, upwork string"
    )

    def agent(week, tier="TPH Chat", manager="boss"):
        return (week, 1, "Ann", "ann", "ann@x", date(2017, 1, 1), manager, "head", tier, "Ann W")

    def boss(week, above):
        return (week, 9, "Bo", "boss", "bo@x", date(2016, 1, 1), above, "head", "Lead", None)

    roster = make(
        schema,
        agent(weeks[0]), agent(weeks[1]), agent(weeks[4]),        # weeks 3 and 4 missing: one stint all the same
        agent(weeks[2], tier="TPH SMS"),                          # another team in between
        boss(weeks[0], "chief"), boss(weeks[0], "chief"),         # short name listed twice
        boss(weeks[1], "chief"), boss(weeks[4], "chief"),
    )
    users = make("id string, email string, isactive string", ("U1", "ann@x", "1"), ("U2", "ann@x", "0"), ("U9", "bo@x", "0"))
    got = rows(agents.chat_stints(roster, users).select(*CHAT_STINT))
    ann = (1, "Ann", "ann@x", "U1", date(2017, 1, 1))
    assert got == [
        (*ann, "chief", "TPH Chat", "ann w", weeks[0], weeks[4] + timedelta(days=6)),
        (*ann, "head", "TPH SMS", "ann w", weeks[2], weeks[2] + timedelta(days=6)),
    ]


def test_two_users_with_one_email_give_two_stints(make):
    roster = make(
        "week_start date, empID bigint, name string, shortname string, email string, hired_date date, manager string,"
        " manager_three string, tier string, upwork string",
        (date(2018, 1, 1), 1, "Ann", "ann", "ann@x", None, None, "head", "TPH Chat", None),
    )
    users = make("id string, email string, isactive string", ("U1", "ann@x", "1"), ("U2", "ann@x", "1"))
    assert [r[3] for r in rows(agents.chat_stints(roster, users).select(*CHAT_STINT))] == ["U1", "U2"]


def test_listed_stints_keep_listed_teams_and_open_ends(make):
    roster = make(
        "preferred_first_name string, preferred_last_name string, email_address string, liveops_id string,"
        " tt_admin_id string, salesforce_id_18 string, manager_name string, team_start_date string,"
        " team_end_date string, emp_lvl string, team_name string, team_id string",
        ("Ann", "Low", "a@x", "12", "x1", "A1", None, "2018-1-5", "2018-02-01", "1", "T", "8"),
        ("Ben", None, "b@x", None, None, "A2", None, "2018-01-05", None, "1", "T", "16"),
        ("Cat", "Low", "c@x", "13", "3", "A3", None, "2018-01-05", "2018-02-01", "1", "T", "7"),
    )
    got = rows(agents.phone_stints(roster).select("salesforce_id_18", "specialist_name", "liveops", "date_team_start", "date_team_end"))
    assert got == [
        ("A1", "Ann Low", 12, date(2018, 1, 5), date(2018, 2, 1)), ("A2", None, None, date(2018, 1, 5), None),
    ]


# --- status log -----------------------------------------------------------------------------------

ARMS = [
    # presence, modifier, reason, work type, bucket
    ("BUSY", "None", None, None, "Talk"),
    ("BUSY", "Paused", None, None, "Wrap"),
    ("IDLE", None, "Logged On as Unavailable", "Inbound", "Wrap"),   # also fits the idle rule: wrap comes first
    ("BUSY", "Hold+Pinned", None, None, "Hold"),
    ("IDLE", "Hold", "Lunch", "Inbound", "Hold"),                    # also fits idle and lunch
    ("IDLE", "None", None, "Inbound", "Idle"),
    ("IDLE", "None", "Break", "Inbound", "Idle"),                    # idle wins over the reason
    ("IDLE", None, None, "Outbound", "Idle Dialout"),
    ("IDLE", None, None, "Dial-out", "Idle Dialout"),
    ("BUSY", "Pinned", None, None, "Idle Dialout"),
    ("NOTREADY", None, "No Phone Connection", None, "Other - Unavailable"),
    ("SIGNON", None, None, None, "Idle Dialout"),
    ("OFFLINE", "None", None, None, "Idle Dialout"),
    ("NOTREADY", None, "Special_Projects", None, "Special_Projects"),
    ("BUSY", "None", "Lunch", None, "Lunch"),                        # not talk: a reason is given
    ("NOTREADY", None, "Unheard Of", None, "Other - Unavailable"),
    (None, None, None, None, "Other - Unavailable"),
]
LOG = (
    "agent_system_name string, agent_presence_state string, agent_state_modifier string, unavailable_reason string,"
    " work_type string, event_time timestamp_ntz, total_time double"
)


def test_every_classifier_arm(make):
    log = make(LOG, *[("a@x (desk)", p, m, r, w, datetime(2018, 6, 1, 12), float(i)) for i, (p, m, r, w, _) in enumerate(ARMS)])
    got = phone.classify_status(log, as_of=AS_OF, look_back=40, corrections={}).orderBy("total_time").collect()
    assert [r.time_bucket for r in got] == [bucket for *_, bucket in ARMS]


def test_label_correction_and_local_day(make):
    log = make(
        LOG,
        ("cut@x.co (desk)", "BUSY", "None", None, None, datetime(2018, 6, 21, 5, 59), 1.0),  # still 20 June in Denver
        ("cut@x.co (desk)", "BUSY", "None", None, None, datetime(2018, 6, 21, 6, 0), 2.0),
        ("plain@x", "BUSY", "None", None, None, datetime(2018, 6, 22, 6, 0), 4.0),
    )
    got = phone.classify_status(log, as_of=AS_OF, look_back=9, corrections={"cut@x.co": "cut@x.com"})
    assert rows(got, "liveops_system_name_email", "event_date_mt", "total_time") == [
        ("cut@x.com", date(2018, 6, 21), 2.0), ("plain@x", date(2018, 6, 22), 4.0),
    ]


def test_buckets_add_up_to_the_total(make):
    log = make(LOG, *[("A1@desk.example x", p, m, r, w, datetime(2018, 6, 5, 12), i + 1.0) for i, (p, m, r, w, _) in enumerate(ARMS)])
    got = one(phone.time_in_bucket(make(STINTS, stint()), log, as_of=AS_OF, look_back=60, corrections={}))
    assert got["total_lops_time"] == sum(range(1, len(ARMS) + 1)) == sum(got[c] for c, _ in phone.TIME_BUCKETS)


# --- scorecards -----------------------------------------------------------------------------------

CSAT = (
    "csat_owner_id string, csat_created_time timestamp_ntz, csat_response_time timestamp_ntz,"
    " csat_response_time_mt string, csat_score bigint, likely_continue_using_score bigint, csat_case_origin string"
)
LEDGER = (
    "cre_credit_log_id bigint, cre_usr_user_id bigint, cre_performing_usr_user_id bigint, cre_timestamp bigint,"
    " cre_transaction_type bigint, cre_adjustment_paid_cents bigint, cre_adjustment_promotional_cents bigint"
)


def survey(created, answered, origin, score=5):
    return ("A1", created, answered, str(answered), score, score, origin)


def test_in_product_surveys_differ_between_the_scorecards(make):
    new, old = datetime(2018, 6, 20), datetime(2018, 4, 1)
    surveys = make(
        CSAT,
        survey(new, datetime(2018, 6, 21), "In-Product", 5),   # created in the look-back
        survey(old, datetime(2018, 6, 21), "In-Product", 4),   # only answered in it
        survey(old, datetime(2018, 6, 21), None, 3),
        survey(old, datetime(2018, 5, 1), "Phone", 2),         # 60 days back
    )
    in_chat = one(chat.survey_scores(surveys, as_of=AS_OF, look_back=45))
    assert (in_chat["csat_responses"], in_chat["csat_5"], in_chat["csat_4"], in_chat["csat_3"]) == (2, 1, 0, 1)
    in_phone = one(phone.survey_scores(make(STINTS, stint()), surveys, as_of=AS_OF, look_back=45))
    assert (in_phone["csat_responses"], in_phone["csat_5"], in_phone["csat_3"], in_phone["csat_top2"]) == (1, 0, 1, 0)


def ms(ts):
    return int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)


def test_ledger_signs_types_and_own_account(make):
    noon = ms(datetime(2018, 6, 10, 18))
    log = make(
        LEDGER,
        (1, 50, 1, noon, 3, 100, 5), (2, 50, 1, noon, 5, 100, 5), (3, 50, 1, noon, 8, 7, None), (4, 50, 1, noon, 7, 9, 9),
        (5, 1, 1, noon, 3, 1000, 0),  # own account
        (6, 50, 1, ms(datetime(2018, 6, 11, 3)), 4, 20, 0),  # 10 June in Denver, 11 June in UTC
    )
    got = {r.cre_date_mt: r for r in phone.ledger(make(STINTS, stint(admin="1"), stint("A2", admin="x1"), stint("A3", admin=None)), log, as_of=AS_OF, look_back=45).collect()}
    row = got[date(2018, 6, 10)]
    assert len(got) == 1 and row.salesforce_id_18 == "A1"
    assert (row.num_refunds, row.refunds_amount, row.num_grants, row.grants_amount) == (1, 105, 1, 20)
    assert (row.num_monetary_refunds, row.monetary_refunds_amount, row.num_cc_refunds, row.cc_refunds_amount) == (1, -105, 1, 0)
    by_day = {r.cre_date: r for r in chat.ledger(log, as_of=AS_OF, look_back=45).collect()}
    assert by_day[date(2018, 6, 10)].num_grants == 0 and by_day[date(2018, 6, 11)].num_grants == 1


def phone_card(make, make_cases, stints, *, cases=(), log=(), surveys=(), ledger=()):
    return phone.phone_scorecard(
        make(STINTS, *stints), make_cases(*cases), make(LOG, *log), make(CSAT, *surveys), make(LEDGER, *ledger),
        as_of=AS_OF, corrections={},
    )


def closed_on(day, **more):
    stamp = f"2018-06-{day:02d} 10:00:00"
    return {"created_time_mt": stamp, "closed_time_mt": stamp, "case_number": day, **more}


def test_overlapping_stints_repeat_each_others_rows(make, make_cases):
    stints = [stint(end=date(2018, 6, 10)), stint(start=date(2018, 6, 5), manager="N")]
    card = phone_card(make, make_cases, stints, cases=[closed_on(7)])
    seventh = card.filter(F.col("index_date") == F.lit(date(2018, 6, 7)))
    assert len(card.columns) == len(set(card.columns)) == 49
    assert rows(seventh, "manager_name", "closed_cases") == [("M", 1), ("M", 1), ("N", 1), ("N", 1)]
    assert card.count() == 10 + 26 + 2


def test_agents_without_phone_id_lose_logged_time(make, make_cases):
    log = [("A1@desk.example x", "BUSY", "None", None, None, datetime(2018, 6, 5, 18), 30.0)]
    spent = {
        liveops: phone_card(make, make_cases, [stint(liveops=liveops)], log=log).agg(F.sum("total_lops_time")).first()[0]
        for liveops in (1, None)
    }
    assert spent == {1: 30.0, None: 0.0}


def test_days_beyond_the_short_look_back_show_zero_surveys(make, make_cases):
    old = datetime(2018, 4, 20)
    surveys = [("A1", old, old, "2018-04-20 00:00:00", 5, 5, None)]
    card = phone_card(
        make, make_cases, [stint(start=date(2018, 1, 1))], surveys=surveys,
        cases=[{"created_time_mt": "2018-04-20 09:00:00", "closed_time_mt": "2018-04-20 10:00:00"}],
    )
    row = one(card.filter(F.col("index_date") == F.lit(date(2018, 4, 20))))
    assert (row["closed_cases"], row["csat_responses"]) == (1, 0)
    assert card.count() == 121 and all(card.filter(F.col(m).isNull()).isEmpty() for m in PHONE_MEASURES[:4])


def test_cases_that_do_not_count(make, make_cases):
    kept = closed_on(8)
    dropped = [
        closed_on(8, auto_response=None), closed_on(8, auto_response=True), closed_on(8, duplicate_case_id="x"),
        closed_on(8, case_category="Marketplace Integrity"), closed_on(8, first_contact_channel="Fax"),
        closed_on(8, first_contact_channel=None), {"created_time_mt": "2018-06-08 00:00:00"},
    ]
    got = one(phone.closed_cases(make(STINTS, stint()), make_cases(kept, *dropped), as_of=AS_OF, look_back=45))
    assert (got["closed_cases"], got["closed_date_mt"]) == (1, date(2018, 6, 8))


CHAT_SCHEMA = (
    "tt_admin_id bigint, specialist_name string, email_address string, salesforce_id_18 string, hired_date date,"
    " manager_name string, team_name string, upwork_lower string, date_team_start date, date_team_end date"
)


def test_chat_scorecard_and_its_demo_copy(make, make_cases):
    stints = make(
        CHAT_SCHEMA,
        (1, "Ann", "ann@x", "A1", None, "M", "TPH Chat", "ann w", date(2018, 6, 4), date(2018, 6, 10)),
        (2, "Ben", "ben@x", "A2", None, "M", "Quality", None, date(2018, 6, 4), date(2018, 6, 10)),
        (3, "Cat", "cat@x", "A3", None, "M", "TPH SMS", None, date(2018, 6, 4), date(2018, 6, 4)),
    )
    presence = make(
        "createddate string, ownerid string, servicepresencestatusid string, statusduration string",
        ("6/5/2018 1:00:00", "A1", "S1", "3600"), ("06/05/2018 02:00:00", "A1", "S2", "1800"),
        ("06/05/2018 03:00:00", "A1", "S3", "900"), ("06/05/2018 04:00:00", "A1", "S9", "90"),
    )
    statuses = make("id string, masterlabel string", ("S1", "Online - Chat"), ("S2", "Lunch"), ("S3", "Away (Deprecated)"))
    closed = datetime(2018, 6, 6, 1)
    cases = make_cases({"created_time": closed, "closed_time": closed, "closed_time_mt": "2018-06-05 19:00:00", "csat_offered_time": closed})
    hours = make("date string, full_name string, total_hours double", ("06/05/2018", "ANN W", 2.5), ("06/05/2018", "ann w", 1.0))
    card = chat.chat_scorecard(
        stints, cases, presence, statuses, make(CSAT), make(LEDGER), hours, as_of=AS_OF, demo_of="ann@x",
        demo_identity={"specialist_name": "Demo", "email_address": "demo@x", "manager_name": "Boss"},
    )
    assert len(card.columns) == len(set(card.columns)) == 52
    assert rows(card.groupBy("email_address").count()) == [("ann@x", 7), ("cat@x", 1), ("demo@x", 7)]
    fifth = one(card.filter((F.col("index_date") == F.lit(date(2018, 6, 5))) & (F.col("email_address") == "demo@x")))
    assert (fifth["specialist_name"], fifth["manager_name"], fifth["team_name"]) == ("Demo", "Boss", "TPH Chat")
    assert (fifth["total_omni_time"], fifth["total_omni_denominator"], fifth["lunch_time"]) == (6390.0, 4590.0, 1800.0)
    assert (fifth["online_time"], fifth["away_time"], fifth["null_status_time"]) == (3600.0, 900.0, 90.0)
    assert (fifth["total_omni_denominator_hours"], fifth["total_upwork_hours"], fifth["closed_cases"]) == (1.275, 3.5, 0)
    sixth = one(card.filter((F.col("index_date") == F.lit(date(2018, 6, 6))) & (F.col("email_address") == "ann@x")))
    assert (sixth["closed_cases"], sixth["pushed_surveys"]) == (1, 1)  # UTC day, not the Mountain day


# --- case detail ----------------------------------------------------------------------------------


def test_case_detail_joins_by_mountain_day_and_filters_by_its_own_zone(make, make_cases):
    links = make("id string, caseconsolelink__c string", ("C1", "https://x/1"))
    case = {"case_id": "C1", "created_time_mt": "2018-05-15 23:00:00", "created_time_pht": "2018-05-16 13:00:00"}
    other = {"case_id": "C2", "created_time_mt": "2018-05-20 01:00:00", "created_time_pht": "2018-05-20 15:00:00"}
    cases = make_cases(case, other)
    of_phone = case_plans.phone_case_detail(make(STINTS, stint(start=date(2018, 5, 1))), cases, links, as_of=AS_OF)
    assert rows(of_phone, "case_id", "case_link") == [("C2", None)]  # 15 May is a day too old in Mountain time
    chat_stints = make(
        CHAT_SCHEMA, (1, "Ann", "ann@x", "A1", None, "M", "TPH Chat", "w", date(2018, 5, 1), date(2018, 5, 15))
    )
    of_chat = case_plans.chat_case_detail(chat_stints, cases, links, as_of=AS_OF)
    assert rows(of_chat, "case_id", "case_link", "created_time_pht") == [("C1", "https://x/1", datetime(2018, 5, 16, 13))]
    assert of_phone.columns == [
        *PHONE_STINT, "case_id", "case_number", "first_contact_channel", "case_category", "case_subcategory",
        "duplicate_case_id", "created_time_mt", "closed_time_mt", "csat_id", "csat_owner_agent_id",
        "csat_survey_offered", "csat_survey_not_offered_reason", "csat_created_time_mt", "csat_offered_time_mt",
        "csat_response_time_mt", "csat_score", "likely_continue_using_score", "easy_to_handle_issue_score",
        "less_time_than_expected_score", "issue_resolved_score", "number_interactions_to_resolution",
        "csat_audit_exception_reason", "pro_contact_info_captured", "csat_comments", "case_link",
    ]


# --- productivity and board -----------------------------------------------------------------------


def test_minutes_and_seconds_make_the_same_hour_and_no_manager_is_in_house(make):
    day = date(2018, 6, 5)
    phone_days = make(
        "manager_name string, emp_lvl string, email_address string, index_date date, closed_cases bigint,"
        " total_lops_time bigint, lunch_time bigint, ltc_responses bigint, ltc_top2 bigint",
        (None, "1", "a@x", day, 1, 90, 30, 2, 1), ("IBEX", "1", "b@x", day, 2, 60, 0, 0, 0),
        ("M", "2", "c@x", day, 9, 9, 9, 9, 9), ("M", "1", "out@x", day, 9, 9, 9, 9, 9), ("M", "1", None, day, 9, 9, 9, 9, 9),
    )
    chat_days = make(
        "team_name string, email_address string, index_date date, closed_cases bigint, total_omni_time double,"
        " lunch_time double, ltc_responses bigint, ltc_top2 bigint",
        ("TPH Chat", "d@x", day, 4, 4200.0, 600.0, 1, 1),
    )
    got = productivity.team_days(phone_days, chat_days, excluded_emails=["out@x"])
    assert rows(got) == [
        ("IBEX", day, 2, 1.0, 0, 0), ("TPH Chat", day, 4, 1.0, 1, 1), ("TSL Phone", day, 1, 1.0, 2, 1),
    ]
    assert productivity.team_days(phone_days, chat_days, excluded_emails=[], surveys=False).columns == [
        "team_name", "index_date", "closed_cases", "hours_worked",
    ]


def test_board_needs_visitors_and_keeps_missing_costs_null(make, make_cases):
    monday = [date(2018, 6, 4) + timedelta(weeks=w) for w in range(4)]
    visits = make(
        "visit_date date, partition_date date, visitor_pk bigint, ip_sessions bigint",
        (monday[0], monday[0], 1, 5), (monday[0] + timedelta(days=6), monday[0], 1, 5), (monday[0], monday[0], 2, 100),
        (monday[2], monday[2], 3, 99), (monday[3], monday[3], 3, 1),
        (monday[0], date(2016, 12, 31), 7, 1),  # old partition
    )
    stamp = datetime(2018, 6, 12)
    requests = make("request_id bigint, create_time timestamp_ntz", (1, stamp), (None, datetime(2018, 6, 18)))
    contacts = make("bid_id bigint, first_customer_contact_time timestamp_ntz", (1, stamp))
    answered = datetime(2018, 6, 18)
    cases = make_cases(
        {"created_time": answered, "csat_response_time": answered, "likely_continue_using_score": 4},
        {"created_time": answered, "csat_response_time": answered, "likely_continue_using_score": 1, "pro_segment_group_id": 1},
        {"created_time": answered, "first_contact_channel": "Email", "auto_response": None},
    )
    team_days = make(
        "team_name string, index_date date, closed_cases bigint, hours_worked double",
        ("TSL Phone", monday[2], 3, 0.0), ("TPH SMS", monday[2] + timedelta(days=6), 4, 2.0),
    )
    costs = make("week date, tsl_costs bigint, ibex_costs bigint, tph_costs bigint", (monday[2], 5, None, 2))
    board = weekly.weekly_board(
        weekly.weekly_visitors(visits), weekly.weekly_requests(requests), weekly.weekly_contacts(contacts),
        weekly.weekly_case_mix(cases), weekly.weekly_top_two(cases), weekly.weekly_cases_per_hour(team_days),
        costs, as_of=AS_OF,
    )
    assert len(board.columns) == 39
    found = {r.week: r for r in board.collect()}
    assert set(found) == {monday[0], monday[2]}  # no visitors in the second week; the last one is not over
    first, third = found[monday[0]], found[monday[2]]
    assert (first.visitors, first.requests, first.total_costs, first.tsl_costs) == (1, None, 0, None)
    assert (third.requests, third.requests_100, third.cases, third.cases_email, third.cases_auto_response) == (0, 0.0, 3, 0, 0)
    assert (third.ltc_surveys, third.ltc, third.ltc_chat, third.ltc_strategic, third.ltc_unknown) == (2, 0.5, None, 0.0, 1.0)
    assert (third.cph, third.cph_tsl, third.cph_tph, third.cph_ibex) == (3.5, None, 2.0, None)
    assert (third.cases_total_team, third.cases_ibex, third.total_costs, third.ibex_costs) == (7, 0, 7, None)


def test_survey_rates_start_later_than_the_board(make_cases):
    early = datetime(2017, 3, 1)
    cases = make_cases({"created_time": early, "csat_response_time": early, "likely_continue_using_score": 5})
    assert weekly.weekly_case_mix(cases).count() == 1 and weekly.weekly_top_two(cases).isEmpty()
