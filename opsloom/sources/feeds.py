"""Call-centre CSV feeds: positional, all text, header ignored, blank means NULL."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Columns of the agent-status feed, in file order.
STATUS_COLUMNS = """
agent agent_email agent_first_name agent_group agent_id agent_last_name agent_name date timestamp agent_states
available_for_all available_for_call available_for_vm media_availability reason_code skill_availability state
unavailable_for_calls unavailable_for_vm agent_state_time login_timestamp logout_timestamp on_call_time
on_voicemail_time paid_time ready_time ringing_time unpaid_time video_time vm_in_progress_time wait_time
agent_disconnects_first call_id call_type campaign campaign_type handle_time extension on_acw_time
not_ready_time manual_time talk_time after_call_work_time
""".split()

# Columns of the call-log feed, in file order.
CALL_COLUMNS = """
date date_hour day_of_month day_of_week half_hour hour hour_of_day month quarter_hour time time_interval
timestamp year abandoned abandon_rate ani ani_area_code ani_country ani_country_code ani_state call_id
call_survey_result call_type calls calls_completed_in_ivr calls_timed_out_in_ivr campaign campaign_type
contacted customer_name disconnected_from_hold disposition dnis dnis_area_code dnis_country dnis_country_code
dnis_state ivr_path list_name live_connect no_party_contact notes parent_session_id recordings service_level
session_id skill speed_of_answer third_party_talk_time after_call_work_time bill_time call_time
conference_time conferences consult_time cost dial_time handle_time hold_time holds ivr_time manual_time
park_time parks preview_interrupted preview_interrupted_by_call preview_interrupted_by_skill_vm preview_time
queue_callback_wait_time queue_wait_time rate ring_time talk_time talk_time_less_hold_park time_to_abandon
total_queue_time transfers video_time voicemails voicemails_declined voicemails_deleted
voicemails_handle_time voicemails_handled voicemails_returned_call voicemails_transferred agent agent_email
agent_first_name agent_group agent_last_name agent_name dest_agent dest_agent_email dest_agent_extension
dest_agent_first_name dest_agent_group dest_agent_last_name dest_agent_name extension call_back city company
contact_create_timestamp contact_id contact_modified_timestamp email first_name last_agent last_call_date
last_name number_1 number_2 number_3 state street zip custom_caller_ani custom_campaign custom_queue
""".split()

# File-name prefix of each feed.
FEEDS = {"status": ("Stat", STATUS_COLUMNS), "call": ("Call", CALL_COLUMNS)}

LINEAGE = "source_file"
LOAD = "load_id"


def feed_schema(feed: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in FEEDS[feed][1]])


def feed_glob(inbox: str, feed: str) -> str:
    """Files of a feed in the inbox, told apart by their name's first four characters."""
    return f"{inbox.rstrip('/')}/{FEEDS[feed][0]}*"


def csv_options(quoted_newlines: bool = True) -> dict[str, str]:
    """Options of both batch and stream reads.

    Rows with too few or too many fields fail the load instead of being padded or cut; column pruning
    is off because it would hide them. ``quoted_newlines`` lets a quoted field span lines, which makes
    a file one task; large feeds known to have none can turn it off and have their files split.
    """
    return {
        "header": "true",
        "enforceSchema": "true",
        "quote": '"',
        "escape": '"',
        "nullValue": "",
        "mode": "FAILFAST",
        "columnPruning": "false",
        "multiLine": str(quoted_newlines).lower(),
    }


def with_lineage(df: DataFrame) -> DataFrame:
    """Add the file each row came from, so files of one name in different deliveries stay apart."""
    return df.select("*", F.col("_metadata.file_path").alias(LINEAGE))


def read_feed(spark: SparkSession, inbox: str, feed: str, *, quoted_newlines: bool = True) -> DataFrame:
    """All files of one feed as one relation."""
    reader = spark.read.schema(feed_schema(feed)).options(**csv_options(quoted_newlines))
    return with_lineage(reader.csv(feed_glob(inbox, feed)))


def save_load(rows: DataFrame, target: str, load_id: str) -> None:
    """Write one load into its own partition of a dataset. A load that is tried again replaces itself.

    Batch and stream both append through here, so one dataset may take both.
    """
    rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{LOAD}={load_id}")


def load_feed(
    spark: SparkSession, inbox: str, feed: str, target: str, *, quoted_newlines: bool = True
) -> None:
    """Append a feed's files to a parquet dataset; made on first use. Loading a file twice doubles its rows."""
    save_load(read_feed(spark, inbox, feed, quoted_newlines=quoted_newlines), target, f"batch-{uuid.uuid4().hex}")


def load_feeds(spark: SparkSession, inbox: str, targets: Mapping[str, str], *, quoted_newlines: bool = True) -> None:
    """Append every feed of the inbox to its dataset: ``{"status": path, "call": path}``."""
    for feed, target in targets.items():
        load_feed(spark, inbox, feed, target, quoted_newlines=quoted_newlines)
