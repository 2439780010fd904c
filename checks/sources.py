"""Sources, sinks and the feed, over files that Spark derives from the driver tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, functions as F

from checks.datasets import demo_scorecard, phone_scorecard
from checks.registry import query
from checks import standins as si
from checks.standins import Standins
from opsloom.plans import productivity
from opsloom.session import fresh_dir
from opsloom.sources import feeds, tables
from opsloom.streaming.feeds import load_arrived
from opsloom.streaming.inbox import load_files, load_inbox, make_feed_tables, read_published

STATUS_SQL = """SELECT 'agent' || user_id AS agent, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS timestamp,
    CASE WHEN event_type <> 'error' THEN event_type END AS state, CASE WHEN value > 20 THEN 'said "yes", then' || chr(10) || 'left' END
    AS reason_code, cast(user_id AS varchar) AS agent_id, CAST(NULL AS varchar) AS skill_availability FROM events"""
CALL_SQL = """SELECT cast(o_orderkey AS varchar) AS call_id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS skill,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS disposition, cast(o_custkey AS varchar) AS contact_id,
    CAST(NULL AS varchar) AS custom_queue FROM orders"""


def _feed_rows(t: Standins, feed: str) -> DataFrame:
    """All columns of the feed, those without a source left blank."""
    if feed == "status":
        rows = t.driver("events")
        given = {
            "agent": F.concat(F.lit("agent"), F.col("user_id")),
            "date": F.date_format("ts", "yyyy-MM-dd"),
            "timestamp": F.date_format("ts", "HH:mm:ss"),
            "state": F.when(F.col("event_type") != "error", F.col("event_type")),
            "reason_code": F.when(F.col("value") > 20, F.lit('said "yes", then\nleft')),
            "agent_id": F.col("user_id").cast("string"),
        }
    else:
        rows = t.driver("orders")
        given = {
            "call_id": F.col("o_orderkey").cast("string"),
            "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
            "skill": F.col("o_orderpriority"),
            "disposition": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
            "contact_id": F.col("o_custkey").cast("string"),
        }
    blank = F.lit(None).cast("string")
    # Header names differ from the schema on purpose: columns are taken by position.
    return rows.select(
        *[given.get(c, blank).alias(f"Column {i}") for i, c in enumerate(feeds.FEEDS[feed][1])]
    )


def _deliver(t: Standins, inbox: str, feed: str, label: str, rows: DataFrame | None = None) -> None:
    """Write a delivery whose name starts with the feed's prefix."""
    path = f"{inbox}/{feeds.FEEDS[feed][0]} {label}.csv"
    (_feed_rows(t, feed) if rows is None else rows).write.option("header", True).option("escape", '"').csv(path)


@query("feed_load_status", sql=STATUS_SQL)
def _(t: Standins) -> DataFrame:
    inbox, target = fresh_dir(t.spark, "inbox"), fresh_dir(t.spark, "status")
    _deliver(t, inbox, "status", "log")
    _deliver(t, inbox, "call", "log")
    feeds.load_feeds(t.spark, inbox, {"status": target, "call": fresh_dir(t.spark, "calls")})
    return tables.read_dataset(t.spark, target).select(
        "agent", "date", "timestamp", "state", "reason_code", "agent_id", "skill_availability"
    )


@query("feed_load", sql=CALL_SQL)
def _(t: Standins) -> DataFrame:
    inbox, target = fresh_dir(t.spark, "inbox"), fresh_dir(t.spark, "calls")
    _deliver(t, inbox, "call", "log")
    feeds.load_feed(t.spark, inbox, "call", target, quoted_newlines=False)
    return tables.read_dataset(t.spark, target).select(
        "call_id", "date", "skill", "disposition", "contact_id", "custom_queue"
    )


@query("feed_stream_once", sql=STATUS_SQL + " UNION ALL " + STATUS_SQL)
def _(t: Standins) -> DataFrame:
    """Two deliveries of the same rows under different names, offered three times in all."""
    inbox, target, state = (fresh_dir(t.spark, x) for x in ("inbox", "status", "stream"))
    _deliver(t, inbox, "status", "log - 1")
    for _ in range(2):
        load_arrived(t.spark, inbox, "status", target, state)
    _deliver(t, inbox, "status", "log - 2")
    load_arrived(t.spark, inbox, "status", target, state)
    return tables.read_dataset(t.spark, target).select(
        "agent", "date", "timestamp", "state", "reason_code", "agent_id", "skill_availability"
    )


@query("feed_mixed_load", sql=STATUS_SQL + " UNION ALL " + STATUS_SQL)
def _(t: Standins) -> DataFrame:
    """One dataset takes a batch load of the first delivery and the stream's load of the second."""
    first, second, target, state = (fresh_dir(t.spark, x) for x in ("inbox", "inbox", "status", "stream"))
    _deliver(t, first, "status", "log - 1")
    _deliver(t, second, "status", "log - 2")
    feeds.load_feed(t.spark, first, "status", target)
    load_arrived(t.spark, second, "status", target, state)
    load_arrived(t.spark, second, "status", target, state)
    return tables.read_dataset(t.spark, target).select(
        "agent", "date", "timestamp", "state", "reason_code", "agent_id", "skill_availability"
    )


def _loaded_inbox(t: Standins) -> tuple[dict[str, str], str]:
    """Two deliveries of both feeds, offered in three stream runs; the first once more as a batch load that was made before."""
    root, label = fresh_dir(t.spark, "loads"), uuid.uuid4().hex[:8]
    inbox, state, log = f"{root}/inbox", f"{root}/state", f"loads_{label}"
    named = {"status": f"status_{label}", "call": f"calls_{label}"}
    make_feed_tables(t.spark, named, log, folder=root)
    for delivery in (1, 2):
        for feed in named:
            _deliver(t, inbox, feed, f"log - {delivery}")
        load_inbox(t.spark, inbox, named, log, state)
    load_inbox(t.spark, inbox, named, log, state)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{inbox}/Call log - 1.csv")
    for _ in range(2):
        load_files(t.spark, inbox, [r["path"] for r in files.select("path").collect()], named, log, "first-delivery-again")
    return named, log


@query("feed_inbox_status", sql=STATUS_SQL + " UNION ALL " + STATUS_SQL)
def _(t: Standins) -> DataFrame:
    """Named tables filled by one stream for all feeds, each file once."""
    named, log = _loaded_inbox(t)
    return read_published(t.spark, named["status"], log).select(
        "agent", "date", "timestamp", "state", "reason_code", "agent_id", "skill_availability"
    )


@query("feed_inbox_calls", sql=CALL_SQL + " UNION ALL " + CALL_SQL + " UNION ALL " + CALL_SQL)
def _(t: Standins) -> DataFrame:
    """The other feed of the same loads, which also takes a batch load, once however often it is tried."""
    named, log = _loaded_inbox(t)
    return read_published(t.spark, named["call"], log).select(
        "call_id", "date", "skill", "disposition", "contact_id", "custom_queue"
    )


@query(
    "feed_lineage",
    sql="""SELECT delivery, count(*) AS n FROM (SELECT unnest(['log - 1', 'log - 2']) AS delivery) d, orders GROUP BY 1""",
)
def _(t: Standins) -> DataFrame:
    """Rows of equally shaped deliveries stay apart by the file they came from (paths are percent-encoded)."""
    inbox = fresh_dir(t.spark, "inbox")
    for label in ("log - 1", "log - 2"):
        _deliver(t, inbox, "call", label)
    rows = feeds.read_feed(t.spark, inbox, "call", quoted_newlines=False)
    delivery = F.regexp_extract(F.url_decode(feeds.LINEAGE), r"Call (log - \d)\.csv", 1)
    return rows.groupBy(delivery.alias("delivery")).agg(F.count(F.lit(1)).alias("n"))


@query("append_sink", sql="SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders")
def _(t: Standins) -> DataFrame:
    """Appending the same rows twice keeps both; the table is made on first use."""
    name = "opsloom_append_" + fresh_dir(t.spark, "t").rsplit("-", 1)[1]
    path = fresh_dir(t.spark, "append")
    rows = t.driver("orders").select("o_orderkey", "o_custkey")
    for _ in range(2):
        tables.append_table(rows, name, path=path)
    t.spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder
    return tables.read_dataset(t.spark, path)


@query(
    "partition_pruned_scan",
    sql="SELECT visitor_pk, ip_sessions, partition_date FROM visits WHERE partition_date >= DATE '2024-01-20'",
)
def _(t: Standins) -> DataFrame:
    path = fresh_dir(t.spark, "visits")
    tables.save_dataset(t("visits"), path, partition_by="partition_date")
    return tables.read_since(t.spark, path, "partition_date", date(2024, 1, 20)).select(
        "visitor_pk", "ip_sessions", "partition_date"
    )


@query("materialised_dataset", relation="team_days")
def _(t: Standins) -> DataFrame:
    """Team days from scorecards written by one job and read by the next."""
    phone_path, chat_path = fresh_dir(t.spark, "phone-card"), fresh_dir(t.spark, "chat-card")
    tables.save_dataset(phone_scorecard(t), phone_path)
    tables.save_dataset(demo_scorecard(t), chat_path)
    return productivity.team_days(
        tables.read_dataset(t.spark, phone_path), tables.read_dataset(t.spark, chat_path),
        excluded_emails=si.EXCLUDED_EMAILS,
    )


@query(
    "generated_scan",
    sql="""SELECT unnest(generate_series(TIMESTAMP '2000-02-25', TIMESTAMP '2000-03-02', INTERVAL 1 DAY))::date AS day,
           (SELECT count(*) FROM orders) AS orders""",
)
def _(t: Standins) -> DataFrame:
    """An array of days as rows beside a total over the orders."""
    total = t.driver("orders").agg(F.count(F.lit(1)).alias("orders"))
    return total.select(
        F.explode(F.sequence(F.lit(date(2000, 2, 25)), F.lit(date(2000, 3, 2)))).alias("day"), "orders"
    )
