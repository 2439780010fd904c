from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from opsloom.plans import activity
from tests.conftest import rows

CONTACTS = (
    "bid_id int, pro_user_id int, first_customer_contact_time timestamp_ntz, request_create_time timestamp_ntz,"
    " revenue bigint, category_id int, cbsa_id int"
)
START, AS_OF = date(2018, 1, 1), date(2018, 6, 20)


@pytest.fixture
def inputs(make):
    jan, mar, may, early = datetime(2018, 1, 9), datetime(2018, 3, 31, 23), datetime(2018, 5, 2), datetime(2017, 4, 5)
    contacts = make(
        CONTACTS,
        (1, 1, jan, jan, 100, 1, 1),     # enabled market listed twice: counts twice
        (2, 1, mar, jan, 10, 1, 1),
        (3, 1, may, may, 7, 2, 2),       # no market row
        (4, 1, early, early, 1000, 2, 2),  # before the start: only the first month sees it
        (5, 2, None, may, None, 3, 3),   # never contacted: a pair of zeros; market row without enabled time
        (6, 3, early, early, 5, 1, 1),   # no request in scope: no pair
        (7, None, may, may, 9, 2, 2),    # no pro: zeros
    )
    markets = make(
        "category_id int, cbsa_id int, enabled_timestamp timestamp_ntz",
        (1, 1, datetime(2016, 1, 1)), (1, 1, datetime(2019, 1, 1)), (3, 3, None),
    )
    return contacts, markets


def test_panel(inputs):
    panel = activity.activity_panel(*inputs, start=START, as_of=AS_OF)
    assert panel.count() == 6 * 4  # months x pairs
    one = rows(panel.filter("pro_user_id = 1 AND im_enabled_market = 1").orderBy("month"))
    # month, contacts, revenue, running, total, previous, next 1, 2, 5, first month
    assert [(r[0].month, *r[3:]) for r in one] == [
        (1, 2, 200, 2, 4, 0, 0, 2, 2, date(2018, 1, 1)),
        (2, 0, 0, 2, 4, 2, 2, 2, None, date(2018, 1, 1)),
        (3, 2, 20, 4, 4, 0, 0, 0, None, date(2018, 1, 1)),
        (4, 0, 0, 4, 4, 2, 0, 0, None, date(2018, 1, 1)),
        (5, 0, 0, 4, 4, 0, 0, None, None, date(2018, 1, 1)),
        (6, 0, 0, 4, 4, 0, None, None, None, date(2018, 1, 1)),
    ]
    other = rows(panel.filter("pro_user_id = 1 AND im_enabled_market = 0"), "contacts", "first_contact_month")
    assert other == [(0, date(2017, 4, 1))] * 5 + [(1, date(2017, 4, 1))]
    silent = rows(panel.filter("pro_user_id = 2").select("im_enabled_market", "total_contacts", "first_contact_month").distinct())
    assert silent == [(0, 0, None)]
    assert panel.filter("pro_user_id = 3").isEmpty()
    assert rows(panel.filter("pro_user_id IS NULL").select("total_contacts", "revenue", "first_contact_month").distinct()) == [(0, 0, None)]


def test_last_running_value_is_the_total(inputs):
    panel = activity.activity_panel(*inputs, start=START, as_of=AS_OF)
    last = panel.filter(F.col("month") == F.lit(date(2018, 6, 1)))
    assert last.filter("running_contacts <> total_contacts").isEmpty()


def test_panel_shuffles_contacts_only_after_summing_them(inputs):
    panel = activity.activity_panel(*inputs, start=START, as_of=AS_OF)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # month-level sums, then one row per pro and flag: scans in its arrays, no window, no sort of the exploded months
    assert "Window" not in plan and "Sort [pro_user_id" not in plan
    assert "Exchange" not in plan.split("Generate")[0] and plan.count("Exchange hashpartitioning(pro_user_id") == 1


def test_monthly_and_first(inputs):
    monthly = rows(activity.monthly_activity(*inputs, START))
    assert (date(2018, 1, 1), 1, 1, 2, 200) in monthly and (None, 2, 0, 0, None) in monthly and len(monthly) == 5
    first = {(r[0], r[1]): r[2] for r in rows(activity.first_activity(*inputs))}
    assert first == {(1, 1): date(2018, 1, 1), (1, 0): date(2017, 4, 1), (2, 0): None, (3, 1): date(2017, 4, 1),
                     (None, 0): date(2018, 5, 1)}
