"""One small query per predicate, join, aggregate, window, set and scalar operator, on driver and stand-in tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from checks import standins as si
from checks.datasets import all_cases, chat_stints, phone_stints
from checks.oracles import AS_OF, CHANNELS, COUNTABLE, ORDERS_AS_OF, SHORT
from checks.registry import query
from checks.standins import Standins
from opsloom.functions import calendar as cal, casts, conditions as cond, measures as ms
from opsloom.functions.conditions import CHANNELS as CHANNEL_NAMES
from opsloom.operators import generators, panel, relations
from opsloom.operators.intervals import count_in_intervals, join_in_interval, join_on_days
from opsloom.plans import experiments, profitability
from opsloom.sources.tables import present, register_view

CUT = date(1998, 6, 1)

# --- predicates -----------------------------------------------------------------------------------


@query(
    "pred_compare",
    sql="""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH'
           AND o_totalprice >= 1000 AND o_totalprice < 300000 AND o_orderdate > TIMESTAMP '1996-02-29 00:00:00'
           AND o_orderdate <= TIMESTAMP '1998-06-01 00:00:00'""",
)
def _(t: Standins) -> DataFrame:
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    return (
        t.driver("orders")
        .filter((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") == "2-HIGH"))
        .filter((price >= 1000) & (price < 300000))
        .filter((day > cal.midnight(date(1996, 2, 29))) & (day <= cal.midnight(CUT)))
        .select("o_orderkey", "o_orderpriority")
    )


@query("pred_in_list", sql="SELECT case_id FROM cases WHERE first_contact_channel IN ('Phone', 'Chat')")
def _(t: Standins) -> DataFrame:
    return t("cases").filter(F.col("first_contact_channel").isin("Phone", "Chat")).select("case_id")


@query("pred_not_in", sql="SELECT case_id FROM cases WHERE first_contact_channel NOT IN ('Phone', 'Chat')")
def _(t: Standins) -> DataFrame:
    return t("cases").filter(cond.not_in(F.col("first_contact_channel"), ["Phone", "Chat"])).select("case_id")


@query("pred_null_safe_in", sql="SELECT case_id FROM cases WHERE coalesce(case_category, '') NOT IN ('Marketplace Integrity')")
def _(t: Standins) -> DataFrame:
    return t("cases").filter(cond.not_in_or_null(F.col("case_category"), ["Marketplace Integrity"])).select("case_id")


@query(
    "pred_null_dropping_in",
    sql=f"""SELECT case_id, coalesce(first_contact_channel, '') IN {CHANNELS} AS supported FROM cases""",
)
def _(t: Standins) -> DataFrame:
    return t("cases").select("case_id", cond.in_not_null(F.col("first_contact_channel"), CHANNEL_NAMES).alias("supported"))


@query("pred_is_null", sql="SELECT case_id, closed_time IS NULL AS still_open FROM cases WHERE duplicate_case_id IS NOT NULL")
def _(t: Standins) -> DataFrame:
    return (
        t("cases").filter(F.col("duplicate_case_id").isNotNull())
        .select("case_id", F.col("closed_time").isNull().alias("still_open"))
    )


@query(
    "pred_is_false",
    sql="""SELECT case_id, auto_response IS NOT DISTINCT FROM true AS automatic,
           auto_response IS NOT DISTINCT FROM false AS answered FROM cases""",
)
def _(t: Standins) -> DataFrame:
    flag = F.col("auto_response")
    return t("cases").select("case_id", cond.is_true(flag).alias("automatic"), cond.is_false(flag).alias("answered"))


@query(
    "pred_equals_true",
    sql="SELECT case_id, auto_response = true AS automatic, auto_response = false AS answered FROM cases",
)
def _(t: Standins) -> DataFrame:
    flag = F.col("auto_response")
    return t("cases").select("case_id", (flag == F.lit(True)).alias("automatic"), (flag == F.lit(False)).alias("answered"))


@query(
    "pred_between",
    sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
)
def _(t: Standins) -> DataFrame:
    return t.driver("lineitem").filter(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "pred_like_prefix",
    sql="""SELECT ownerid, createddate, masterlabel FROM presence JOIN presence_status ON id = servicepresencestatusid
           WHERE masterlabel LIKE 'Online%'""",
)
def _(t: Standins) -> DataFrame:
    online = t("presence_status").filter(F.col("masterlabel").startswith("Online"))
    return (
        t("presence").join(online, F.col("servicepresencestatusid") == F.col("id"))
        .select("ownerid", "createddate", "masterlabel")
    )


@query("pred_lookback", sql=f"SELECT event_id FROM events WHERE ts::date >= {SHORT}")
def _(t: Standins) -> DataFrame:
    lower = cal.days_before(si.EVENTS_AS_OF, si.SHORT_LOOK_BACK)
    return t.driver("events").filter(F.col("ts") >= cal.midnight(lower)).select("event_id")


@query(
    "pred_either_lookback",
    sql=f"SELECT case_id FROM cases WHERE created_time::date >= {SHORT} OR closed_time::date >= {SHORT}",
)
def _(t: Standins) -> DataFrame:
    lower = cal.midnight(cal.days_before(si.EVENTS_AS_OF, si.SHORT_LOOK_BACK))
    return t("cases").filter(cond.either_since(F.col("created_time"), F.col("closed_time"), lower)).select("case_id")


@query(
    "pred_open_end",
    sql="""SELECT experiment_id, user_id, assignment_time FROM user_assignments
           WHERE make_timestamp(assignment_time * 1000)
             <= coalesce(make_timestamp(experiment_stop_time * 1000), TIMESTAMP '2999-01-01')""",
)
def _(t: Standins) -> DataFrame:
    moment, stop = cal.from_millis(F.col("assignment_time")), cal.from_millis(F.col("experiment_stop_time"))
    return t("user_assignments").filter(cond.open_until(moment, stop)).select("experiment_id", "user_id", "assignment_time")


@query(
    "pred_complete_weeks",
    sql=f"""SELECT cast(date_trunc('week', ts) AS date) AS week, count(*) AS n FROM events
            WHERE date_trunc('week', ts) < date_trunc('week', {AS_OF}) GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    week = cal.week_of(cal.utc_date(F.col("ts")))
    return (
        t.driver("events").filter(week < cal.week_of(F.lit(si.EVENTS_AS_OF)))
        .groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"))
    )


@query("pred_test_rows", sql="SELECT id FROM action_plans WHERE istestdata__c = '0'")
def _(t: Standins) -> DataFrame:
    return t("action_plans").filter(F.col("istestdata__c") == "0").select("id")


@query("pred_heavy_source", sql="SELECT visitor_pk, visit_date, ip_sessions FROM visits WHERE ip_sessions < 100")
def _(t: Standins) -> DataFrame:
    return t("visits").filter(F.col("ip_sessions") < 100).select("visitor_pk", "visit_date", "ip_sessions")


@query(
    "pred_self_dealing",
    sql="SELECT cre_credit_log_id FROM credit_log WHERE cre_usr_user_id <> cre_performing_usr_user_id",
)
def _(t: Standins) -> DataFrame:
    return (
        t("credit_log").filter(F.col("cre_usr_user_id") != F.col("cre_performing_usr_user_id")).select("cre_credit_log_id")
    )


@query("pred_countable_case", sql=f"SELECT case_id FROM cases WHERE {COUNTABLE}")
def _(t: Standins) -> DataFrame:
    return t("cases").filter(cond.countable_case()).select("case_id")


@query("pred_user_contact", relation="contact_cases")
def _(t: Standins) -> DataFrame:
    return experiments.contact_cases(all_cases(t))


# --- joins ----------------------------------------------------------------------------------------


@query(
    "join_inner",
    sql="SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey",
)
def _(t: Standins) -> DataFrame:
    return (
        t.driver("orders").join(t.driver("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name")
    )


@query(
    "join_left_single",
    sql="""SELECT c.case_id, l.caseconsolelink__c AS link FROM cases c LEFT JOIN case_links l ON l.id = c.case_id""",
)
def _(t: Standins) -> DataFrame:
    links = t("case_links")
    cases = t("cases").select("case_id")
    return cases.join(links, cases.case_id == links.id, "left").select("case_id", F.col("caseconsolelink__c").alias("link"))


@query(
    "join_left_composite",
    sql="""SELECT c.bid_id, m.enabled_timestamp FROM contacts c
           LEFT JOIN markets m ON m.category_id = c.category_id AND m.cbsa_id = c.cbsa_id""",
)
def _(t: Standins) -> DataFrame:
    return t("contacts").join(t("markets"), ["category_id", "cbsa_id"], "left").select("bid_id", "enabled_timestamp")


@query(
    "join_role_lookups",
    sql="""SELECT a.id, c.user_pk_id__c AS contact_pk, p.user_pk_id__c AS parent_pk FROM action_plans a
           LEFT JOIN crm_contacts c ON c.id = a.contact__c LEFT JOIN crm_contacts p ON p.id = a.parentaccount__c""",
)
def _(t: Standins) -> DataFrame:
    plans, people = t("action_plans").alias("a"), t("crm_contacts")
    for role, column in (("c", "contact__c"), ("p", "parentaccount__c")):
        plans = plans.join(people.alias(role), F.col(f"a.{column}") == F.col(f"{role}.id"), "left")
    return plans.select("a.id", F.col("c.user_pk_id__c").alias("contact_pk"), F.col("p.user_pk_id__c").alias("parent_pk"))


_STINT_DAYS = """SELECT user_id, min(ts)::date + 3 AS first_day, min(ts)::date + 9 AS last_day FROM events GROUP BY 1"""


def _first_weeks(t: Standins) -> DataFrame:
    first = F.min(cal.utc_date(F.col("ts")))
    return t.driver("events").groupBy("user_id").agg(
        F.date_add(first, 3).alias("first_day"), F.date_add(first, 9).alias("last_day")
    )


def _events_in_weeks(t: Standins, how: str) -> DataFrame:
    events = t.driver("events").select(
        F.col("user_id").alias("actor"), "event_id", cal.utc_date(F.col("ts")).alias("day")
    )
    return join_in_interval(
        _first_weeks(t), events, key=F.col("user_id") == F.col("actor"), at=F.col("day"),
        start=F.col("first_day"), end=F.col("last_day"), how=how,
    ).select("user_id", "first_day", "last_day", "event_id")


def _interval_sql(kind: str) -> str:
    return f"""SELECT s.user_id, first_day, last_day, event_id FROM ({_STINT_DAYS}) s
        {kind} JOIN events e
        ON e.user_id = s.user_id AND e.ts::date BETWEEN first_day AND last_day"""


@query("interval_join_inner", sql=_interval_sql("INNER"))
def _(t: Standins) -> DataFrame:
    return _events_in_weeks(t, "inner")


@query("interval_join_left", sql=_interval_sql("LEFT"))
def _(t: Standins) -> DataFrame:
    return _events_in_weeks(t, "left")


@query("interval_join_on_days", sql=_interval_sql("INNER"))
def _(t: Standins) -> DataFrame:
    """The same as an equi-join on user and day."""
    events = t.driver("events").select(F.col("user_id").alias("actor"), "event_id", cal.utc_date(F.col("ts")).alias("day"))
    return join_on_days(
        _first_weeks(t), events, key="user_id", fact_key="actor", day="day", start="first_day", end="last_day",
        first=date(1970, 1, 1), last=date(2100, 1, 1),
    ).select("user_id", "first_day", "last_day", "event_id")


@query(
    "interval_join_cast_key",
    sql="""SELECT a.tt_admin_id, a.date_team_start, l.cre_credit_log_id FROM phone_stints a JOIN credit_log l
           ON try_cast(a.tt_admin_id AS bigint) = l.cre_performing_usr_user_id
           AND make_timestamp(l.cre_timestamp * 1000)::date BETWEEN a.date_team_start AND a.date_team_end""",
)
def _(t: Standins) -> DataFrame:
    return join_in_interval(
        phone_stints(t), t("credit_log"), key=casts.safe_long(F.col("tt_admin_id")) == F.col("cre_performing_usr_user_id"),
        at=cal.utc_date(cal.from_millis(F.col("cre_timestamp"))), start=F.col("date_team_start"), end=F.col("date_team_end"),
    ).select("tt_admin_id", "date_team_start", "cre_credit_log_id")


@query(
    "interval_counts",
    sql=f"""SELECT s.user_id, first_day, last_day, count(event_id) AS n, cast(coalesce(sum(event_id), 0) AS bigint) AS ids
        FROM ({_STINT_DAYS}) s LEFT JOIN events e ON e.user_id = s.user_id
        AND e.ts BETWEEN first_day::timestamp + INTERVAL 9 HOUR AND last_day::timestamp + INTERVAL 15 HOUR
        GROUP BY 1, 2, 3""",
)
def _(t: Standins) -> DataFrame:
    spans = _first_weeks(t).select(
        "user_id", "first_day", "last_day",
        (F.col("first_day").cast("timestamp_ntz") + F.expr("interval 9 hours")).alias("since"),
        (F.col("last_day").cast("timestamp_ntz") + F.expr("interval 15 hours")).alias("until"),
    )
    return count_in_intervals(
        spans, t.driver("events"), key="user_id", start="since", stop="until", at="ts",
        measures={"n": F.lit(1), "ids": F.col("event_id")},
    ).drop("since", "until")


@query(
    "join_cancelled_left",
    sql="""SELECT r.request_id, q.pro_user_id FROM request_assignments r LEFT JOIN request_quotes q
           ON q.request_id = r.request_id WHERE q.pro_user_id IS NOT NULL""",
)
def _(t: Standins) -> DataFrame:
    quoted = t("request_quotes").filter(F.col("pro_user_id").isNotNull())
    return t("request_assignments").join(quoted, "request_id").select("request_id", "pro_user_id")


@query(
    "join_self_parent",
    sql="""SELECT r.empID, r.week_start, boss.name AS boss_name, boss.manager AS upper_manager FROM weekly_roster r
           LEFT JOIN weekly_roster boss ON boss.week_start = r.week_start AND boss.shortname = r.manager""",
)
def _(t: Standins) -> DataFrame:
    roster = t("weekly_roster")
    boss = roster.select(
        "week_start", F.col("shortname").alias("manager"), F.col("name").alias("boss_name"),
        F.col("manager").alias("upper_manager"),
    )
    return (
        roster.select("empID", "week_start", "manager").join(boss, ["week_start", "manager"], "left")
        .select("empID", "week_start", "boss_name", "upper_manager")
    )


@query(
    "spine_pairs",
    sql="""SELECT index_month, c_custkey FROM month_spine CROSS JOIN customer""",
)
def _(t: Standins) -> DataFrame:
    months = generators.months_between(si.PANEL_START, si.ORDERS_AS_OF)
    return t.driver("customer").select(F.explode(months).alias("index_month"), "c_custkey")


@query(
    "scalar_attach",
    sql="""SELECT o_orderkey, cast(round(o_totalprice * 100) AS bigint) - lowest AS above_lowest FROM orders
           CROSS JOIN (SELECT min(cast(round(o_totalprice * 100) AS bigint)) AS lowest FROM orders) x""",
)
def _(t: Standins) -> DataFrame:
    orders = t.driver("orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    lowest = orders.select(F.min("cents")).scalar()
    return orders.select("o_orderkey", (F.col("cents") - lowest).alias("above_lowest"))


@query(
    "join_outer_chain",
    sql="""SELECT n.n_nationkey, c.customers, s.suppliers FROM nation n
        LEFT JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) c ON c.k = n_nationkey
        LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.k = n_nationkey""",
)
def _(t: Standins) -> DataFrame:
    customers = (
        t.driver("customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    suppliers = (
        t.driver("supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("suppliers"))
    )
    return (
        t.driver("nation").select("n_nationkey").join(customers, "n_nationkey", "left")
        .join(suppliers, "n_nationkey", "left")
    )


@query(
    "join_derived_key",
    sql="""SELECT s.specialist_name, s.date_team_start, h.date, h.total_hours FROM chat_stints s
           JOIN (SELECT strptime(date, '%m/%d/%Y')::date AS date, lower(full_name) AS name, sum(total_hours) AS total_hours
                 FROM contractor_log GROUP BY 1, 2) h
           ON h.name = s.upwork_lower AND h.date = s.date_team_start""",
)
def _(t: Standins) -> DataFrame:
    hours = t("contractor_log").groupBy(
        cal.parse_us_date(F.col("date")).alias("date"), F.lower("full_name").alias("name")
    ).agg(F.sum("total_hours").alias("total_hours"))
    return (
        chat_stints(t).join(hours, (F.col("name") == F.col("upwork_lower")) & (F.col("date") == F.col("date_team_start")))
        .select("specialist_name", "date_team_start", "date", "total_hours")
    )


# --- aggregates -----------------------------------------------------------------------------------


@query(
    "group_by_expression",
    sql="""SELECT cast(date_trunc('month', o_orderdate) AS date) AS month, o_totalprice > 250000 AS large, count(*) AS n
           FROM orders GROUP BY 1, 2""",
)
def _(t: Standins) -> DataFrame:
    return t.driver("orders").groupBy(
        cal.month_of(F.col("o_orderdate")).alias("month"), (F.col("o_totalprice") > 250000).alias("large")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct_rows", sql="SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t: Standins) -> DataFrame:
    return t.driver("lineitem").select("l_suppkey", "l_returnflag").distinct()


@query(
    "agg_counts",
    sql="""SELECT event_type, count(*) AS n, count(pro_segment) AS segmented, count(DISTINCT user_id) AS users,
           count(DISTINCT user_id) FILTER (value > 50) AS large_users, count(value) FILTER (value > 50) AS large
           FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN user_id END AS pro_segment FROM events) x GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    large, user = F.col("value") > 50, F.col("user_id")
    return t.driver("events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(user % 3 == 0, user)).alias("segmented"),
        F.count_distinct(user).alias("users"),
        ms.distinct_when(large, user).alias("large_users"),
        ms.count_when(large, F.col("value")).alias("large"),
    )


@query(
    "agg_conditional_sums",
    sql="""SELECT l_suppkey, cast(sum(CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END) AS bigint) AS returned,
           cast(sum(qty) - sum(CASE WHEN l_returnflag = 'R' THEN qty ELSE 0 END) AS bigint) AS kept,
           cast(sum(CASE WHEN l_linestatus = 'O' THEN -(qty + 1) ELSE 0 END) AS bigint) AS owed,
           count(*) FILTER (l_linenumber = 99) AS none_match,
           count(CASE WHEN l_linestatus = 'O' THEN nullif(qty, 1) ELSE nullif(qty, 2) END) AS either_way
           FROM (SELECT *, cast(l_quantity AS bigint) AS qty FROM lineitem) x GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    qty, opened = F.col("l_quantity").cast("bigint"), F.col("l_linestatus") == "O"
    returned = ms.sum_when(F.col("l_returnflag") == "R", qty)
    return t.driver("lineitem").groupBy("l_suppkey").agg(
        returned.alias("returned"),
        (F.sum(qty) - returned).alias("kept"),
        ms.sum_when(opened, -(qty + 1)).alias("owed"),
        ms.count_when(F.col("l_linenumber") == 99).alias("none_match"),
        F.count(F.when(opened, F.nullif(qty, F.lit(1))).otherwise(F.nullif(qty, F.lit(2)))).alias("either_way"),
    )


@query(
    "agg_ratio",
    sql="""SELECT user_id, count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'click'), 0) AS rate
           FROM events GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    kind = F.col("event_type")
    return t.driver("events").groupBy("user_id").agg(
        ms.share(ms.count_when(kind == "purchase"), ms.count_when(kind == "click")).alias("rate")
    )


@query(
    "agg_rounded_ratio",
    sql="""SELECT o_custkey, round(count(DISTINCT l_suppkey) / max(l_linenumber)) AS spread
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    return (
        t.driver("lineitem").join(t.driver("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.round(F.count_distinct("l_suppkey") / F.max("l_linenumber"), 0).alias("spread"))
    )


@query(
    "agg_min_max",
    sql="""SELECT l_suppkey, min(l_shipdate) AS first_shipped, max(l_shipdate) AS last_shipped, min(l_returnflag) AS flag
           FROM lineitem GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    return t.driver("lineitem").groupBy("l_suppkey").agg(
        F.min("l_shipdate").alias("first_shipped"), F.max("l_shipdate").alias("last_shipped"),
        F.min("l_returnflag").alias("flag"),
    )


@query(
    "agg_average_when",
    sql="""SELECT l_returnflag, avg(cast(l_quantity AS bigint)) FILTER (l_linestatus = 'O') AS open_mean,
           avg(cast(l_quantity AS bigint)) FILTER (l_linenumber > 90) AS empty_mean FROM lineitem GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    qty = F.col("l_quantity").cast("bigint")
    return t.driver("lineitem").groupBy("l_returnflag").agg(
        ms.avg_when(F.col("l_linestatus") == "O", qty).alias("open_mean"),
        ms.avg_when(F.col("l_linenumber") > 90, qty).alias("empty_mean"),
    )


@query(
    "agg_global",
    sql="""SELECT count(*) AS n, max(o_totalprice) AS highest, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders""",
)
def _(t: Standins) -> DataFrame:
    return t.driver("orders").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("highest"),
        ms.count_when(F.col("o_orderstatus") == "F").alias("filled"),
    )


@query(
    "agg_two_level",
    sql="""SELECT o_custkey, cast(sum(per_order) AS bigint) AS lines, max(per_order) AS largest FROM orders
           JOIN (SELECT l_orderkey, count(*) AS per_order FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    per_order = t.driver("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("per_order"))
    return (
        t.driver("orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey")
        .agg(F.sum("per_order").alias("lines"), F.max("per_order").alias("largest"))
    )


@query(
    "agg_relabelled",
    sql="""SELECT label, count(*) AS users, cast(sum(n) AS bigint) AS events FROM (
             SELECT user_id, CASE WHEN n_kinds > 4 THEN 'multiple' ELSE kind END AS label, n FROM (
               SELECT user_id, count(DISTINCT event_type) AS n_kinds, min(event_type) AS kind, count(*) AS n
               FROM events GROUP BY 1) x) y GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    per_user = t.driver("events").groupBy("user_id").agg(
        F.count_distinct("event_type").alias("n_kinds"), F.min("event_type").alias("kind"), F.count(F.lit(1)).alias("n")
    )
    label = F.when(F.col("n_kinds") > 4, F.lit("multiple")).otherwise(F.col("kind"))
    return per_user.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"))


@query(
    "score_histogram",
    sql="""SELECT case_owner_agent_id, count(csat_score) AS csat_responses,
        count(*) FILTER (csat_score >= 4) AS csat_top2, count(*) FILTER (csat_score = 5) AS csat_5,
        count(*) FILTER (csat_score = 4) AS csat_4, count(*) FILTER (csat_score = 3) AS csat_3,
        count(*) FILTER (csat_score = 2) AS csat_2, count(*) FILTER (csat_score = 1) AS csat_1 FROM cases GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    return t("cases").groupBy("case_owner_agent_id").agg(*ms.score_histogram(F.col("csat_score"), "csat"))


# --- windows --------------------------------------------------------------------------------------


@query(
    "win_count",
    sql="""SELECT DISTINCT experiment_id, bucket_id, user_id, count(user_id) OVER (PARTITION BY experiment_id, user_id) AS buckets
           FROM (SELECT DISTINCT experiment_id, bucket_id, user_id FROM user_assignments) x""",
)
def _(t: Standins) -> DataFrame:
    rows = t("user_assignments").select("experiment_id", "bucket_id", "user_id").distinct()
    return rows.withColumn("buckets", F.count("user_id").over(Window.partitionBy("experiment_id", "user_id")))


@query(
    "win_group_bounds",
    sql="""SELECT event_id, min(ts) OVER (PARTITION BY user_id) AS first_ts, max(value) OVER (PARTITION BY user_id) AS top_value
           FROM events""",
)
def _(t: Standins) -> DataFrame:
    return relations.with_group_values(
        t.driver("events").select("event_id", "user_id", "ts", "value"), ["user_id"],
        {"first_ts": F.min("ts"), "top_value": F.max("value")},
    ).select("event_id", "first_ts", "top_value")


@query(
    "win_count_distinct",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, count(DISTINCT l_suppkey) OVER (PARTITION BY l_orderkey) AS suppliers,
           count(DISTINCT l_returnflag) OVER (PARTITION BY l_orderkey) AS flags FROM lineitem""",
)
def _(t: Standins) -> DataFrame:
    rows = t.driver("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return relations.with_group_values(
        rows, ["l_orderkey"], {"suppliers": F.count_distinct("l_suppkey"), "flags": F.count_distinct("l_returnflag")}
    ).select("l_orderkey", "l_linenumber", "l_partkey", "suppliers", "flags")


_MONTHLY = """SELECT o_custkey, cast(date_trunc('month', o_orderdate) AS date) AS month,
    cast(date_trunc('year', o_orderdate) AS date) AS year, count(*) AS n FROM orders GROUP BY ALL"""


@query(
    "win_running_peers",
    sql=f"""SELECT o_custkey, month, cast(sum(n) OVER (PARTITION BY o_custkey ORDER BY year) AS bigint) AS through_year,
        cast(sum(n) OVER (PARTITION BY o_custkey) AS bigint) AS in_all,
        coalesce(lag(n) OVER (PARTITION BY o_custkey ORDER BY month), 0) AS before,
        cast(sum(n) OVER (PARTITION BY o_custkey ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS bigint) AS ahead
        FROM ({_MONTHLY}) x""",
)
def _(t: Standins) -> DataFrame:
    # One row per customer and month: the windows are bounded by the number of months.
    monthly = t.driver("orders").groupBy(
        "o_custkey", cal.month_of(F.col("o_orderdate")).alias("month"), F.trunc("o_orderdate", "year").alias("year")
    ).agg(F.count(F.lit(1)).alias("n"))
    customer = Window.partitionBy("o_custkey")
    by_month = customer.orderBy("month")
    return monthly.select(
        "o_custkey", "month", panel.running(F.col("n"), customer.orderBy("year")).alias("through_year"),
        panel.total(F.col("n"), ["o_custkey"]).alias("in_all"), panel.previous(F.col("n"), by_month).alias("before"),
        panel.next_rows(F.col("n"), by_month, 2).alias("ahead"),
    )


@query(
    "win_distinct_min",
    sql="""SELECT DISTINCT o_custkey, o_orderstatus = 'O' AS opened,
           min(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus = 'O') AS first_date FROM orders""",
)
def _(t: Standins) -> DataFrame:
    return t.driver("orders").groupBy("o_custkey", (F.col("o_orderstatus") == "O").alias("opened")).agg(
        F.min("o_orderdate").alias("first_date")
    )


# --- sorts, unions, projections -------------------------------------------------------------------


@query("sorted_report", sql="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1 DESC, 2")
def _(t: Standins) -> DataFrame:
    rows = t.driver("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return present(rows, ("l_returnflag", False), "l_linestatus")


@query(
    "union_positional",
    sql="""SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer""",
)
def _(t: Standins) -> DataFrame:
    return relations.union_by_position(
        t.driver("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")),
        t.driver("customer").select("c_custkey", "c_nationkey"),
    )


@query(
    "union_widening",
    sql="""SELECT l_returnflag AS k, sum(cast(l_quantity AS bigint))::double / 2 AS amount, 'half' AS kind FROM lineitem GROUP BY 1
           UNION ALL SELECT o_orderstatus, count(*), 'count' FROM orders GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    halves = t.driver("lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) / 2).alias("amount")
    )
    counts = t.driver("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return relations.union_by_position(relations.tagged(halves, kind="half"), relations.tagged(counts, kind="count"))


@query(
    "union_altered_copy",
    sql="""SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
           UNION ALL SELECT c_custkey, 'Somebody', 'NONE', c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(t: Standins) -> DataFrame:
    rows = t.driver("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return relations.clone_rows(
        rows, F.col("c_mktsegment") == "BUILDING", {"c_name": "Somebody", "c_mktsegment": "NONE"}
    )


@query(
    "zero_filled",
    sql="""SELECT c_custkey, coalesce(n, 0) AS n, coalesce(cents, 0) AS cents FROM customer LEFT JOIN (
             SELECT o_custkey, count(*) AS n, cast(sum(round(o_totalprice * 100)) AS bigint) AS cents FROM orders
             WHERE o_orderdate >= DATE '2001-06-01' GROUP BY 1) x ON o_custkey = c_custkey""",
)
def _(t: Standins) -> DataFrame:
    recent = (
        t.driver("orders").filter(F.col("o_orderdate") >= cal.midnight(date(2001, 6, 1))).groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    )
    joined = t.driver("customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", *relations.zero_fill(["n", "cents"]))


@query(
    "projection_star_extra",
    sql="""SELECT s.*, s.s_acctbal > 0 AS in_credit, 'supplier' AS kind, 60 AS unit_cost FROM supplier s""",
)
def _(t: Standins) -> DataFrame:
    with_flag = t.driver("supplier").withColumn("in_credit", F.col("s_acctbal") > 0)
    return relations.tagged(with_flag, kind="supplier", unit_cost=60)


@query("projection_allow_list", sql="SELECT id, status__c, ownerid FROM action_plans")
def _(t: Standins) -> DataFrame:
    return relations.keep_only(t("action_plans"), ["id", "status__c", "ownerid"])


@query("view_scan", relation="typed_plan_view")
def _(t: Standins) -> DataFrame:
    from checks.datasets import typed_plan_view

    return register_view(typed_plan_view(t), "action_plan_view")


# --- scalar functions -----------------------------------------------------------------------------


@query(
    "fn_parse_text_dates",
    sql="""SELECT id, strptime(createddate, '%m/%d/%Y %H:%M:%S') AS stamp,
           strptime(expirationdate__c, '%m/%d/%Y %H:%M:%S') AS sparse_stamp,
           strptime(createddate, '%m/%d/%Y %H:%M:%S')::date AS day FROM action_plans""",
)
def _(t: Standins) -> DataFrame:
    return t("action_plans").select(
        "id", cal.parse_us_stamp(F.col("createddate")).alias("stamp"),
        cal.parse_us_stamp(F.col("expirationdate__c")).alias("sparse_stamp"),
        cal.parse_us_date(F.split_part("createddate", F.lit(" "), F.lit(1))).alias("day"),
    )


@query(
    "fn_parse_iso_text",
    sql="""SELECT case_id, strptime(created_time_mt, '%Y-%m-%d %H:%M:%S') AS stamp,
           strptime(closed_time_pht, '%Y-%m-%d %H:%M:%S')::date AS day FROM cases""",
)
def _(t: Standins) -> DataFrame:
    return t("cases").select(
        "case_id", cal.parse_iso_stamp(F.col("created_time_mt")).alias("stamp"),
        cal.utc_date(cal.parse_iso_stamp(F.col("closed_time_pht"))).alias("day"),
    )


@query(
    "week_identity",
    sql="""SELECT day, cast(date_trunc('week', day) AS date) AS week,
           cast(date_trunc('week', day) AS date) AS shifted FROM (SELECT DISTINCT o_orderdate::date AS day FROM orders) x""",
)
def _(t: Standins) -> DataFrame:
    days = t.driver("orders").select(cal.utc_date(F.col("o_orderdate")).alias("day")).distinct()
    return days.select(
        "day", cal.week_of(F.col("day")).alias("week"), cal.week_of_sunday_shift(F.col("day")).alias("shifted")
    )


@query(
    "fn_date_arithmetic",
    sql="""SELECT o_orderkey, d + 6 AS plus_days, d - 45 AS minus_days, cast(d - INTERVAL 5 MONTH AS date) AS minus_months,
           cast(d - INTERVAL 1 YEAR AS date) AS minus_year, cast(date_trunc('month', d) AS date) AS month_start
           FROM (SELECT o_orderkey, o_orderdate::date AS d FROM orders) x""",
)
def _(t: Standins) -> DataFrame:
    day = cal.utc_date(F.col("o_orderdate"))
    return t.driver("orders").select(
        "o_orderkey", F.date_add(day, 6).alias("plus_days"), F.date_sub(day, 45).alias("minus_days"),
        cal.months_before(day, 5).alias("minus_months"), cal.months_before(day, 12).alias("minus_year"),
        cal.month_of(day).alias("month_start"),
    )


@query(
    "local_day_rollup",
    sql="""SELECT cast(moment AT TIME ZONE 'UTC' AT TIME ZONE 'America/Denver' AS date) AS day_mt,
           cast(moment AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Manila' AS date) AS day_pht, moment::date AS day_utc,
           count(*) AS n
           FROM (SELECT o_orderdate + to_hours(cast(o_orderkey % 24 AS int)) AS moment FROM orders
                 UNION ALL SELECT ts FROM events) x GROUP BY 1, 2, 3""",
)
def _(t: Standins) -> DataFrame:
    hours = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    moments = t.driver("orders").select((F.col("o_orderdate") + hours).alias("moment")).union(
        t.driver("events").select("ts")
    )
    moment = F.col("moment")
    return moments.groupBy(
        cal.local_date(moment, "America/Denver").alias("day_mt"), cal.local_date(moment, "Asia/Manila").alias("day_pht"),
        cal.utc_date(moment).alias("day_utc"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_millis",
    sql="""SELECT cre_credit_log_id, make_timestamp(cre_timestamp * 1000) AS moment,
           make_timestamp(cre_timestamp * 1000)::date AS day FROM credit_log""",
)
def _(t: Standins) -> DataFrame:
    moment = cal.from_millis(F.col("cre_timestamp"))
    return t("credit_log").select("cre_credit_log_id", moment.alias("moment"), cal.utc_date(moment).alias("day"))


@query(
    "day_spine",
    sql=f"""SELECT index_date, count(event_id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25',
            {AS_OF}::timestamp, INTERVAL 1 DAY))::date AS index_date) d LEFT JOIN events ON ts::date = index_date GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    spine = generators.day_spine(t.spark, date(2023, 12, 25), si.EVENTS_AS_OF)
    daily = t.driver("events").groupBy(cal.utc_date(F.col("ts")).alias("index_date")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(daily, "index_date", "left").select("index_date", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "fn_text",
    sql="""SELECT c_custkey, split_part(c_name, '#', 1) AS token, lower(c_mktsegment) AS lowered,
           right(cast(c_custkey AS varchar), 1) AS last_digit,
           CASE WHEN c_nationkey <> 7 THEN c_mktsegment END || ' ' || c_name AS whole FROM customer""",
)
def _(t: Standins) -> DataFrame:
    first = F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment"))
    return t.driver("customer").select(
        "c_custkey", casts.first_token(F.col("c_name"), "#").alias("token"), F.lower("c_mktsegment").alias("lowered"),
        casts.last_char(F.col("c_custkey")).alias("last_digit"), casts.full_name(first, F.col("c_name")).alias("whole"),
    )


@query(
    "safe_casts",
    sql="""SELECT id, try_cast(round(try_cast(usr_user_id__c AS double)) AS bigint) AS via_double,
           try_cast(user_pk_id__c AS bigint) AS whole, try_cast(usr_user_id__c AS double) AS amount FROM crm_contacts""",
)
def _(t: Standins) -> DataFrame:
    user = F.col("usr_user_id__c")
    return t("crm_contacts").select(
        "id", casts.long_via_double(user).alias("via_double"), casts.safe_long(F.col("user_pk_id__c")).alias("whole"),
        casts.safe_double(user).alias("amount"),
    )


@query(
    "strict_casts",
    sql="""SELECT user_pk::bigint AS pk, duration::double AS seconds FROM (
           SELECT cast(c_custkey AS varchar) AS user_pk, cast(c_acctbal AS varchar) AS duration FROM customer) x""",
)
def _(t: Standins) -> DataFrame:
    rows = t.driver("customer").select(
        F.col("c_custkey").cast("string").alias("user_pk"), F.col("c_acctbal").cast("string").alias("duration")
    )
    return rows.select(
        casts.strict_long(F.col("user_pk")).alias("pk"), casts.strict_double(F.col("duration")).alias("seconds")
    )


@query(
    "fn_ratio_and_round",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS int) / nullif(l_linenumber - 1, 0) AS safe_ratio,
           l_linenumber / 2 AS halves, round(l_linenumber / 2) AS rounded, round(-l_linenumber / 2) AS rounded_down,
           -1 * (l_linenumber + NULL::int) AS lost FROM lineitem""",
)
def _(t: Standins) -> DataFrame:
    line = F.col("l_linenumber")
    return t.driver("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ms.share(F.col("l_quantity").cast("int"), line - 1).alias("safe_ratio"), (line / 2).alias("halves"),
        F.round(line / 2, 0).alias("rounded"), F.round(-line / 2, 0).alias("rounded_down"),
        (-1 * (line + F.lit(None).cast("int"))).alias("lost"),
    )


@query(
    "fn_case_cascade",
    sql="""SELECT event_id, CASE WHEN event_type = 'click' THEN 'a' WHEN value > 50 THEN 'b'
           WHEN event_type = 'view' THEN 'c' ELSE 'd' END AS first_rule,
           CASE WHEN nullif(user_id % 3, 0) > 1 THEN 'yes' ELSE 'no' END AS when_null, coalesce(nullif(user_id % 3, 0), -1) AS filled
           FROM events""",
)
def _(t: Standins) -> DataFrame:
    kind, third = F.col("event_type"), F.nullif(F.col("user_id") % 3, F.lit(0))
    cascade = F.when(kind == "click", "a").when(F.col("value") > 50, "b").when(kind == "view", "c").otherwise("d")
    return t.driver("events").select(
        "event_id", cascade.alias("first_rule"), F.when(third > 1, "yes").otherwise("no").alias("when_null"),
        F.coalesce(third, F.lit(-1)).alias("filled"),
    )


@query(
    "fn_literal_bounds",
    sql=f"""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT} 00:00:00'
            AND o_orderdate <= coalesce(CASE WHEN o_orderstatus = 'F' THEN {ORDERS_AS_OF}::timestamp END, TIMESTAMP '2999-01-01')""",
)
def _(t: Standins) -> DataFrame:
    stop = F.when(F.col("o_orderstatus") == "F", cal.midnight(si.ORDERS_AS_OF))
    return (
        t.driver("orders").filter(F.col("o_orderdate") >= cal.midnight(CUT))
        .filter(cond.open_until(F.col("o_orderdate"), stop)).select("o_orderkey")
    )


@query(
    "wave_digits",
    sql="""SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 1 WHEN c_custkey % 10 IN (2, 3, 4) THEN 2 ELSE 3 END AS wave
           FROM customer""",
)
def _(t: Standins) -> DataFrame:
    digit = casts.last_char(F.col("c_custkey"))
    wave = F.lit(0)
    for number, digits in profitability.WAVES:
        wave = F.when(digit.isin(list(digits)), number).otherwise(wave)
    return t.driver("customer").select("c_custkey", wave.alias("wave"))
