"""Every registered query against its DuckDB equivalent, and plan rules that hold for all of them."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, expected_rows, oracle_connection
from checks.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
DATASETS = [n for n in QUERIES if n in (
    "activity_panel", "monthly_activity", "first_activity", "stints_weekly", "agent_scorecard", "agent_scorecard_cloned",
    "phone_case_detail", "chat_case_detail", "team_productivity", "weekly_board", "user_buckets", "experiment_user_arms",
    "request_users", "unified_exposure", "exposure_weights", "experiment_request_arms", "profitability",
    "unprofitable_flags", "typed_plan_view", "interval_counts", "win_group_bounds", "win_count_distinct",
)]


@pytest.fixture(scope="module")
def plain():
    return oracle_connection(SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 120


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_oracle(spark, plain, name):
    result = QUERIES[name](spark, SMALL)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert slow not in plan
    assert difference(result, expected_rows(plain, ORACLES[name])) is None


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The small tables with a third of the rows of each fact table on one user, customer, part or order."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    source = oracle_connection(SMALL)
    changed = {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM events",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 1 THEN 11 ELSE o_custkey END AS o_custkey) FROM orders",
        "lineitem": """SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey,
                       CASE WHEN l_linenumber % 3 = 1 THEN 9 ELSE l_partkey END AS l_partkey) FROM lineitem""",
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        sql = changed.get(name, f"SELECT * FROM {name}")
        source.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", DATASETS)
def test_equals_oracle_on_skewed_tables(spark, skewed, name):
    expected = expected_rows(oracle_connection(skewed), ORACLES[name])
    assert difference(QUERIES[name](spark, skewed), expected) is None


def test_entry_runs(spark):
    assert not entry.entry(spark).isEmpty()
