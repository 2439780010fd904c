"""Experiments, profitability and CRM plans on hand-made rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from opsloom.plans import crm, experiments, profitability
from tests.conftest import one, rows


def ms(ts):
    return int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)


D = [datetime(2018, 1, d) for d in range(1, 29)]
USER = "experiment_id string, bucket_id string, user_id bigint, assignment_time bigint, experiment_stop_time bigint"
REQUEST = "experiment_id string, bucket_id string, request_id bigint, assignment_time bigint, experiment_stop_time bigint"
QUOTES = "request_id bigint, pro_user_id bigint, customer_id bigint"
CASES = (
    "user_id bigint, created_time timestamp_ntz, case_id string, first_contact_channel string, auto_response boolean,"
    " case_subcategory string"
)


def case(user, when, case_id, channel="Phone", auto=False, sub=None):
    return (user, when, case_id, channel, auto, sub)


@pytest.fixture
def users(make):
    stop = ms(D[20])
    return make(
        USER,
        ("e1", "a", 1, ms(D[2]), None), ("e1", "a", 1, ms(D[4]), stop),
        ("e1", "a", 2, ms(D[3]), stop), ("e1", "b", 2, ms(D[5]), stop),   # two buckets
        ("e1", "b", 3, ms(D[25]), stop),                                  # only after the stop
        ("e1", "b", 4, ms(D[6]), stop), ("e1", "a", 4, ms(D[26]), stop),  # second bucket after the stop
        ("e2", "a", 1, ms(D[9]), None),
    )


def test_contaminated_users_get_one_label(users):
    got = rows(experiments.user_buckets(users), "experiment_id", "bucket_id", "user_id", "min_assignment_time", "max_assignment_time")
    assert got == [
        ("e1", "a", 1, D[2], D[4]), ("e1", "b", 4, D[6], D[6]), ("e1", "multiple", 2, D[3], D[5]), ("e2", "a", 1, D[9], D[9]),
    ]


def test_user_arms_count_cases_from_exposure_to_stop(make, users):
    cases = make(
        CASES,
        case(1, D[1], "c0"), case(1, D[2], "c1"), case(1, D[20], "c2"), case(1, D[21], "c3"),
        case(2, D[4], "c4", auto=None), case(2, D[4], "c5", channel="Fax"), case(2, D[4], "c6", sub="Noise"),
        case(4, D[7], None), case(4, D[7], "c7", channel=None),
    )
    got = rows(experiments.user_arms(users, cases), "experiment_id", "bucket_id", "tot_bucket_users", "contact_bucket_users", "num_cases")
    assert got == [("e1", "a", 1, 1, 2), ("e1", "b", 1, 0, 0), ("e1", "multiple", 1, 0, 0), ("e2", "a", 1, 1, 2)]


@pytest.fixture
def requests(make):
    return make(
        REQUEST,
        ("e1", "a", 10, ms(D[2]), None), ("e1", "a", 11, ms(D[4]), None), ("e1", "b", 12, ms(D[6]), ms(D[10])),
        ("e1", "b", 13, ms(D[1]), None),  # request without quotes
    )


@pytest.fixture
def quotes(make):
    return make(
        QUOTES,
        (10, 1, 50), (10, 2, 50), (10, 3, 50), (11, 1, 51), (12, 2, None), (12, 60, None), (12, 50, 50), (99, 1, 1),
    )


def test_exposure_and_weights(requests, quotes):
    exposure = experiments.unified_exposure(requests, quotes)
    assert exposure.columns == [
        "experiment_id", "bucket_id", "min_assignment_time", "max_assignment_time", "experiment_start_time",
        "experiment_stop_time", "request_id", "user_id",
    ]
    weights = experiments.exposure_weights(exposure)
    got = {(r.request_id, r.user_id): r for r in weights.collect()}
    assert set(got) == {(10, 1), (10, 2), (10, 3), (10, 50), (11, 1), (11, 51), (12, 2), (12, 60), (12, 50)}
    two = got[(12, 2)]
    assert (two.min_assignment_time, two.max_assignment_time, two.experiment_stop_time) == (ms(D[2]), ms(D[6]), ms(D[10]))
    assert (two.num_user_buckets, two.num_user_exp_requests, two.num_user_bucket_requests) == (2, 2, 1)
    one_ = got[(11, 1)]
    assert (one_.num_user_buckets, one_.num_user_exp_requests, one_.num_user_bucket_requests) == (1, 2, 2)


def test_request_arms_round_per_request_then_sum(make, requests, quotes):
    cases = make(
        CASES,
        case(1, D[3], "x1"), case(1, D[5], "x2"), case(3, D[1], "early"), case(50, D[3], "x3"), case(2, D[5], "x4"),
        # one id on rows of two users of one request, one id twice for one user, and a row without an id
        case(1, D[4], "shared"), case(50, D[4], "shared"), case(51, D[5], "twice"), case(51, D[6], "twice"),
        case(60, D[7], None),
    )
    arms = {r.bucket_id: r for r in experiments.request_arms(requests, quotes, cases).collect()}
    # request 10: 4 users, 3 contacting, ids x1 x2 x3 x4 shared; largest request count 2 (users 1, 2 and 50)
    # request 11: 2 users, both contacting, ids x1 x2 shared twice; 2 requests -> 1, 1, 2
    # request 12: 3 users, contacting 50, 2 and 60, ids x3 x4 shared; over 2 -> 2 (1.5), 2 (1.5), 2 (1.5)
    assert (arms["a"].tot_bucket_users, arms["a"].contact_bucket_users, arms["a"].num_cases) == (2 + 1, 2 + 1, 3 + 2)
    assert (arms["b"].tot_bucket_users, arms["b"].contact_bucket_users, arms["b"].num_cases) == (2, 2, 2)


def test_report_unions_both_kinds(make, users, requests, quotes):
    report = experiments.experiment_report(users, requests, quotes, make(CASES, case(1, D[3], "x1")))
    assert report.columns == [
        "experiment_id", "bucket_id", "experiment_start_time", "experiment_stop_time", "tot_bucket_users",
        "contact_bucket_users", "num_cases", "assignment_type",
    ]
    assert rows(report.groupBy("assignment_type").count()) == [("request", 2), ("user", 4)]


# --- profitability --------------------------------------------------------------------------------

AS_OF = date(2018, 6, 30)
QUOTE = (
    "bid_id bigint, pro_user_id bigint, pay_per_customer_contact boolean, first_intentful_ppc_contact_time timestamp_ntz,"
    " first_positive_customer_interaction_time timestamp_ntz, refunded boolean, revenue bigint, revenue_ppq bigint,"
    " revenue_ppc bigint, sent_time timestamp_ntz"
)
SUPPORT = (
    "user_id bigint, case_number bigint, created_time timestamp_ntz, first_contact_channel string, auto_response boolean,"
    " case_owner_agent_team string"
)
NOW, THEN = datetime(2018, 6, 1), datetime(2016, 1, 1)


def test_pro_measures(make):
    quotes = make(
        QUOTE,
        (1, 1, True, NOW, None, False, 10, None, 10, NOW),
        (2, 1, True, None, NOW, False, 0, None, 0, NOW),      # no ppc contact: not a contact, not a free contact
        (3, 1, False, NOW, None, True, 0, 0, None, NOW),      # refunded: not a free quote
        (4, 1, False, None, NOW, False, 0, 0, None, THEN),    # free quote, long ago
        (5, 1, None, NOW, NOW, None, 0, None, None, NOW),     # kind unknown: positive interaction counts
        (None, 1, True, NOW, None, False, 0, None, 0, datetime(2017, 6, 30)),  # free contact exactly a year ago
    )
    got = one(profitability.pro_measures(quotes, AS_OF))
    assert (got["quotes"], got["customer_contacts"], got["refunded"]) == (5, 4, 1)
    assert (got["revenue_all_time"], got["revenue_ppq_all_time"], got["revenue_ppc_last_year"]) == (10, 0, 10)
    assert (got["free_quotes_all_time"], got["free_quotes_last_year"]) == (1, 0)
    assert (got["free_customer_contacts_all_time"], got["free_customer_contacts_last_year"]) == (1, 1)


def profit_inputs(make, quotes, support=()):
    pros = make("pro_user_id bigint, first_service_create_time timestamp_ntz", *[(i, THEN) for i in (1, 2, 3)])
    return profitability.profitability(pros, make(QUOTE, *quotes), make(SUPPORT, *support), as_of=AS_OF)


def test_one_missing_price_loses_the_whole_imputed_value(make):
    free = [(1, 1, False, None, None, False, 0, 0, None, NOW), (2, 1, True, NOW, None, False, 0, None, 0, NOW)]
    paid_quote, paid_contact = (3, 2, False, None, None, False, 8, 8, None, NOW), (4, 2, True, NOW, None, False, 20, None, 20, NOW)
    with_both = {r.pro_user_id: r for r in profit_inputs(make, [*free, paid_quote, paid_contact]).collect()}
    assert with_both[1].est_free_all_time == 28.0 and with_both[1].profitability_incl_free_all_time == 28.0
    without = {r.pro_user_id: r for r in profit_inputs(make, [*free, paid_quote]).collect()}
    assert without[1].avg_ppc_price_all_time is None and without[1].est_free_all_time == 0.0
    assert without[3].revenue_all_time == 0 and len(without) == 3 and len(without[1]) == 33


def test_flags_waves_and_missing_segments(make):
    columns = ["profitability_all_time", "profitability_last_year", "profitability_incl_free_all_time",
               "profitability_incl_free_last_year", "revenue_all_time", "revenue_last_year", "est_free_all_time",
               "est_free_last_year", "cost_all_time", "cost_last_year"]
    schema = "pro_user_id bigint, first_service_create_time timestamp_ntz, " + ", ".join(f"{c} double" for c in columns)
    loss = (-1.0,) * 4 + (0.0,) * 6
    profits = make(
        schema, (11, THEN, *loss), (12, THEN, *loss), (20, THEN, *loss), (15, THEN, *loss),
        (16, datetime(2018, 1, 1), *loss), (17, THEN, -1.0, 1.0, 0.0, -1.0, *loss[4:]), (18, None, *loss), (19, THEN, *loss),
    )
    segments = make("pro_user_id bigint, group_id bigint", *[(i, 4) for i in (11, 12, 20, 16, 17, 18)], (19, 2), (15, None), (17, 5))
    got = profitability.unprofitable_flags(profits, segments, as_of=AS_OF)
    assert len(got.columns) == 17
    found = rows(got, "pro_user_id", "group_id", "unprofitable_rollout_wave", "unprofitable_flag_all_time", "unprofitable_flag_last_year")
    assert found == [
        (11, 4, 1, 1, 1), (12, 4, 2, 1, 1), (15, None, 0, 0, 0), (16, 4, 0, 0, 0), (17, 4, 0, 1, 0), (17, 5, 0, 1, 0),
        (18, 4, 0, 0, 0), (19, 2, 0, 0, 0), (20, 4, 3, 1, 1),
    ]


def test_support_volume_keeps_unnamed_teams_and_drops_unknown_flags(make):
    got = one(profitability.support_volume(make(
        SUPPORT, (1, 1, NOW, "Phone", False, None), (1, 2, THEN, "SMS", False, "Desk"), (1, 3, NOW, "Phone", None, "Desk"),
        (1, 4, NOW, "Phone", False, "Noise"), (1, 5, NOW, "Fax", False, "Desk"), (1, None, NOW, "Chat", False, "Desk"),
    ), AS_OF))
    assert got == {"user_id": 1, "cases_all_time": 2, "cases_phone_all_time": 1, "cases_other_all_time": 1,
                   "cases_last_year": 1, "cases_phone_last_year": 1, "cases_other_last_year": 0}


# --- CRM ------------------------------------------------------------------------------------------

PLAN = [
    "id", "actionplannumber__c", "createddate", "planstartdate__c", "planenddate__c", "expirationdate__c",
    "actionplantemplate__c", "actionplantemplatename__c", "actionplantype__c", "playbookurl__c", "status__c",
    "campaign__c", "createdbyid", "ownerid", "contact__c", "parentaccount__c", "account__c", "lead__c", "service__c",
    "totalnumberofactionitems__c", "numberofcompleteactionitems__c", "percentcomplete__c", "lastcheckindate__c",
    "lastattempt__c", "nextcallscheduled__c", "lastmodifiedbyid", "lastmodifieddate", "lastactivitydate",
    "lastreferenceddate", "lastvieweddate", "systemmodstamp", "recordtypeid", "isdeleted", "istestdata__c",
    "name", "description__c", "strengths__c", "progoals__c",
]


def plan(**given):
    base = {"actionplantemplate__c": "t1", "istestdata__c": "0", "createddate": "1/2/2018 03:04:05", "name": "private"}
    return tuple({**base, **given}.get(c) for c in PLAN)


def test_typed_plans(make):
    plans = make(
        ", ".join(f"{c} string" for c in PLAN),
        plan(id="1", createdbyid="u1", ownerid="u2", totalnumberofactionitems__c="3.0", percentcomplete__c="x", isdeleted="0"),
        plan(id="2", istestdata__c="1"), plan(id="3", istestdata__c=None), plan(id="4", actionplantemplate__c=None),
        plan(id="5", actionplantemplate__c="t9", contact__c="k1", campaign__c="g1", parentaccount__c="a1", account__c="a2"),
    )
    users = make("crm_user_id string, user_first_name string, user_last_name string", ("u1", "Ann", "Low"), ("u2", "Ben", None))
    typed = crm.typed_plans(plans, users)
    first = one(typed.filter("action_plan_id = '1'"))
    assert first["action_plan_created_time"] == datetime(2018, 1, 2, 3, 4, 5)
    assert (first["created_by_crm_user_name"], first["owner_crm_user_name"]) == ("Ann Low", None)
    assert (first["total_action_plan_items"], first["percent_action_plan_complete"], first["action_plan_is_deleted"]) == (3.0, None, 0)
    assert rows(typed, "action_plan_id") == [("1",), ("5",)] and len(typed.columns) == 34

    people = make(
        "id string, usr_user_id__c string, user_pk_id__c string", ("k1", "123.0", "7"), ("a1", "12.5", "x"), ("a2", "x", None)
    )
    view = crm.typed_plans_view(
        plans, users, people, people, make("id string, name string", ("g1", "Spring")),
        make("id string, contactid string, campaignid string", ("m1", "k1", "g1"), ("m2", "k1", "g1"), ("m3", "k1", "g2")),
        excluded_templates=["t1"],
    )
    assert rows(view, "action_plan_id", "campaign_name", "campaign_member_id") == [("5", "Spring", "m1"), ("5", "Spring", "m2")]
    got = view.first()
    assert (got.crm_contact_user_id, got.crm_contact_user_pk, got.crm_parent_account_user_id, got.crm_account_user_id) == (123, 7, 13, None)
    assert got.crm_parent_account_user_pk is None and len(view.columns) == 44
    for private in ("name", "description__c", "strengths__c", "progoals__c"):
        assert private not in view.columns and private not in typed.columns


def test_column_prefix_is_an_argument(make):
    plans = make(", ".join(f"{c} string" for c in PLAN), plan(id="1", createdbyid="u1"))
    users = make("desk_user_id string, user_first_name string, user_last_name string", ("u1", "Ann", "Low"))
    got = one(crm.typed_plans(plans, users, prefix="desk"))
    assert got["created_by_desk_user_name"] == "Ann Low" and "desk_contact_id" in got


def test_bad_stamp_text_fails_the_query(make):
    plans = make(", ".join(f"{c} string" for c in PLAN), plan(id="1", createddate="not a date"))
    users = make("crm_user_id string, user_first_name string, user_last_name string")
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        crm.typed_plans(plans, users).select(F.max("action_plan_created_time")).collect()
