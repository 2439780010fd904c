"""Support contacts of users exposed to experiments.

Experiments can hold any share of the assignments, and users any share of the cases, so nothing here
gathers an experiment or a user in one task: per-experiment and per-user values come from grouped
aggregates that are joined back, and cases are counted with ``count_in_intervals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsloom.functions.calendar import far_future, from_millis
from opsloom.functions.conditions import open_until, user_contact_case
from opsloom.functions.measures import count_when
from opsloom.operators.intervals import count_in_intervals
from opsloom.operators.relations import same_key, tagged, union_by_position, with_group_values
from opsloom.session import settle

MIXED = "multiple"
ROLES = ("pro", "customer")
MEMBER = ["experiment_id", "user_id", "roles"]
ARM = ["experiment_id", "bucket_id", "experiment_start_time", "experiment_stop_time"]


def experiment_bounds(assignments: DataFrame) -> DataFrame:
    """First assignment and stop time of each experiment."""
    return assignments.groupBy("experiment_id").agg(
        from_millis(F.min("assignment_time")).alias("experiment_start_time"),
        from_millis(F.max("experiment_stop_time")).alias("experiment_stop_time"),
    )


def user_buckets(assignments: DataFrame) -> DataFrame:
    """One row per experiment and user with first and last assignment; users in several buckets get one label.

    Assignments after the experiment's stop are ignored. The bounds are written first: one row per
    experiment, so Catalyst sees their size and needs no shuffle of the assignments to look them up.
    """
    bounds = settle(experiment_bounds(assignments), "experiment-bounds")
    per_bucket = (
        assignments.select("experiment_id", "bucket_id", "user_id", "assignment_time")
        .join(bounds, "experiment_id", "left")
        .filter(open_until(from_millis(F.col("assignment_time")), F.col("experiment_stop_time")))
        .groupBy("experiment_id", "bucket_id", "user_id", "experiment_start_time", "experiment_stop_time")
        .agg(
            from_millis(F.min("assignment_time")).alias("min_assignment_time"),
            from_millis(F.max("assignment_time")).alias("max_assignment_time"),
        )
    )
    # At most one row per bucket in each partition of this window.
    n_buckets = F.count("user_id").over(Window.partitionBy("experiment_id", "user_id"))
    return (
        per_bucket.withColumn("num_buckets", n_buckets)
        .withColumn("bucket_id", F.when(F.col("num_buckets") > 1, F.lit(MIXED)).otherwise(F.col("bucket_id")))
        .groupBy("experiment_id", "user_id", "bucket_id", "experiment_start_time", "experiment_stop_time")
        .agg(
            F.min("min_assignment_time").alias("min_assignment_time"),
            F.max("max_assignment_time").alias("max_assignment_time"),
            F.avg("num_buckets").alias("num_buckets"),
        )
    )


def contact_cases(cases: DataFrame) -> DataFrame:
    """Cases that count as a user contacting support."""
    return cases.filter(user_contact_case()).select("user_id", "created_time", "case_id")


def user_arms(assignments: DataFrame, cases: DataFrame) -> DataFrame:
    """Users, users with a case and cases after exposure, per arm of user-level experiments."""
    return _user_arms(assignments, contact_cases(cases))


def _user_arms(assignments: DataFrame, found: DataFrame) -> DataFrame:
    until = F.coalesce(F.col("experiment_stop_time"), far_future())
    exposed = user_buckets(assignments).select(*ARM, "user_id", "min_assignment_time", until.alias("until"))
    counted = count_in_intervals(
        exposed,
        found.filter(F.col("case_id").isNotNull()),
        key="user_id", start="min_assignment_time", stop="until", at="created_time",
        measures={"n_cases": F.lit(1)},
    )
    return counted.groupBy(*ARM).agg(
        F.count("user_id").alias("tot_bucket_users"),
        count_when(F.col("n_cases") > 0).alias("contact_bucket_users"),
        F.sum("n_cases").alias("num_cases"),
    )


def request_members(assignments: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per experiment, bucket, request and user, with the user's roles on the request.

    Carries how often the user stands in each role and the request's first and last assignment and stop
    time, in epoch milliseconds. ``leads`` marks one bucket of each request in the experiment, so that
    requests can be counted without a distinct. Assignments and quotes are both reduced before they meet.
    """
    # At most one row per bucket in each partition of this window.
    buckets = Window.partitionBy("experiment_id", "request_id").orderBy("bucket_id")
    assigned = assignments.groupBy("experiment_id", "bucket_id", "request_id").agg(
        F.min("assignment_time").alias("first_time"),
        F.max("assignment_time").alias("last_time"),
        F.max("experiment_stop_time").alias("stop_time"),
        F.count(F.lit(1)).alias("n_assigned"),
    ).withColumn("leads", F.when(F.row_number().over(buckets) == 1, 1).otherwise(0))
    users = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(column).cast("bigint").alias("user_id"))
            for role, column in (("pro", "pro_user_id"), ("customer", "customer_id"))
        ]
    )
    touched = (
        quotes.select("request_id", F.inline(users))
        .filter(F.col("user_id").isNotNull())
        .groupBy("request_id", "user_id")
        .agg(*[count_when(F.col("role") == role).alias(f"n_{role}") for role in ROLES])
    )
    roles = F.when((F.col("n_pro") > 0) & (F.col("n_customer") > 0), "both").otherwise(
        F.when(F.col("n_pro") > 0, "pro").otherwise("customer")
    )
    return assigned.join(touched, "request_id").withColumn("roles", roles)


def _role_bounds(members: DataFrame) -> DataFrame:
    """Start and stop of each experiment over the requests that have users of a role; one row per experiment."""
    return members.groupBy("experiment_id").agg(
        *[
            agg(F.when(F.col(f"n_{role}") > 0, F.col(source))).alias(f"{role}_{name}")
            for role in ROLES
            for name, agg, source in (("start", F.min, "first_time"), ("stop", F.max, "stop_time"))
        ]
    )


def _bounds_of(roles: Column) -> list[Column]:
    """Experiment start and stop as the user's roles see them; they differ when requests lack a role."""

    def over(pick, name: str) -> Column:
        return pick(*[F.when(roles.isin(role, "both"), F.col(f"b.{role}_{name}")) for role in ROLES])

    return [
        over(F.least, "start").alias("experiment_start_time"),
        over(F.greatest, "stop").alias("experiment_stop_time"),
    ]


def request_exposure(assignments: DataFrame, quotes: DataFrame) -> DataFrame:
    """Users touched by each assigned request, once per role, with the times of user and experiment in that role.

    Rows that would repeat are kept once with their ``row_count``. Times are epoch milliseconds. Nothing
    is written and no job runs here: the branches share the exchanges of assignments and quotes.
    """
    members = request_members(assignments, quotes)
    per_role = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"n_{r}").alias("n_quotes")) for r in ROLES])
    rows = members.select("*", F.inline(per_role)).filter("n_quotes > 0")
    rows = with_group_values(
        rows,
        ["experiment_id", "role", "user_id"],
        {"min_assignment_time": F.min("first_time"), "max_assignment_time": F.max("last_time")},
    )
    return (
        rows.alias("r")
        .join(_role_bounds(members).alias("b"), same_key("r", "b", ["experiment_id"]))
        .select(
            "r.experiment_id", "bucket_id", "role", "min_assignment_time", "max_assignment_time",
            *_bounds_of(F.col("r.role")), "request_id", "user_id",
            (F.col("n_assigned") * F.col("n_quotes")).alias("row_count"),
        )
    )


def unified_exposure(assignments: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per experiment, bucket, request and user over both roles.

    First and last assignment are the user's over the whole experiment. Like ``request_exposure``, this
    writes nothing and runs no job.
    """
    members = request_members(assignments, quotes)
    timed = with_group_values(
        members,
        ["experiment_id", "user_id"],
        {"min_assignment_time": F.min("first_time"), "max_assignment_time": F.max("last_time")},
    )
    return (
        timed.alias("m")
        .join(_role_bounds(members).alias("b"), same_key("m", "b", ["experiment_id"]))
        .select(
            "m.experiment_id", "bucket_id", "min_assignment_time", "max_assignment_time",
            *_bounds_of(F.col("m.roles")), "request_id", "user_id",
        )
    )


def exposure_weights(exposure: DataFrame) -> DataFrame:
    """Exposure rows with distinct buckets and requests of the user in the experiment and in the bucket.

    ``exposure`` has one row per experiment, bucket, request and user, so within a bucket rows are requests
    and per user grouped buckets are buckets; only a user's requests over all buckets need a distinct count.
    """
    exposure = settle(exposure, "exposure")
    per_bucket = exposure.groupBy("experiment_id", "bucket_id", "user_id").agg(
        F.count("request_id").alias("num_user_bucket_requests")
    )
    buckets = per_bucket.groupBy("experiment_id", "user_id").agg(F.count("bucket_id").alias("num_user_buckets"))
    requests = exposure.groupBy("experiment_id", "user_id").agg(
        F.count_distinct("request_id").alias("num_user_exp_requests")
    )
    per_user = buckets.alias("b").join(
        requests.alias("r"), same_key("b", "r", ["experiment_id", "user_id"], never_null=["user_id"])
    ).select("b.*", "r.num_user_exp_requests")
    weights = per_bucket.alias("k").join(
        per_user.alias("u"), same_key("k", "u", ["experiment_id", "user_id"], never_null=["user_id"])
    ).select("k.*", "u.num_user_buckets", "u.num_user_exp_requests")
    return exposure.alias("e").join(
        weights.alias("w"), same_key("e", "w", ["experiment_id", "bucket_id", "user_id"], never_null=["user_id"])
    ).select("e.*", "w.num_user_buckets", "w.num_user_exp_requests", "w.num_user_bucket_requests")


def _user_spans(members: DataFrame) -> DataFrame:
    """Per experiment, user and combination of roles (three at most): bounds, counting interval and requests."""
    kinds = [*ROLES, "both"]
    users = members.groupBy("experiment_id", "user_id").agg(
        F.min("first_time").alias("first_time"),
        F.sum("leads").alias("n_requests"),
        *[F.bool_or(F.col("roles") == kind).alias(f"is_{kind}") for kind in kinds],
    )
    present = F.array_compact(F.array(*[F.when(F.col(f"is_{kind}"), F.lit(kind)) for kind in kinds]))
    rows = users.select("experiment_id", "user_id", "first_time", "n_requests", F.explode(present).alias("roles"))
    bounded = rows.alias("s").join(settle(_role_bounds(members), "role-bounds").alias("b"), same_key("s", "b", ["experiment_id"])).select(
        "s.*", *_bounds_of(F.col("s.roles"))
    )
    stop = from_millis(F.col("experiment_stop_time"))
    return bounded.select(
        "experiment_id", "user_id", "roles", "n_requests",
        from_millis(F.col("first_time")).alias("since"),
        F.coalesce(stop, far_future()).alias("until"),
        from_millis(F.col("experiment_start_time")).alias("experiment_start_time"),
        stop.alias("experiment_stop_time"),
    )


def _repeated_reached(spans: DataFrame, repeated: DataFrame) -> DataFrame:
    """The repeated case ids that each user span reached, once each.

    Counted like all cases, with user and case id as the key, so a much repeated id is not met row by row.
    """
    owned = repeated.withColumn("case_key", F.struct("user_id", "case_id"))
    candidates = spans.join(owned.select("user_id", "case_id", "case_key").distinct(), "user_id").select(
        *MEMBER, "experiment_start_time", "experiment_stop_time", "n_requests", "since", "until", "case_id", "case_key"
    )
    counted = count_in_intervals(
        candidates, owned, key="case_key", start="since", stop="until", at="created_time", measures={"n": F.lit(1)}
    )
    return counted.filter("n > 0").select(
        *MEMBER, "experiment_start_time", "experiment_stop_time", "n_requests", "case_id"
    )


def _same_member(left: str, right: str) -> Column:
    return same_key(left, right, MEMBER, never_null=["user_id", "roles"])


def _counted_again(members: DataFrame, reached: DataFrame) -> DataFrame:
    """Per request, how often adding up its users' ids counts an id again that another of its users reached.

    Of the users sharing an id, the one with the most requests is only looked up on the requests of the
    others, so a user on a large share of the requests is not paired with all of its ids there.
    """
    scope = ["experiment_id", "experiment_start_time", "experiment_stop_time", "case_id"]
    shared = reached.groupBy(*scope).agg(
        F.max(F.struct("n_requests", "user_id")).getField("user_id").alias("main_user"),
        F.min("user_id").alias("lowest"),
        F.max("user_id").alias("highest"),
    ).filter("lowest < highest")
    hits = reached.alias("h").join(shared.alias("s"), same_key("h", "s", scope)).select("h.*", "s.main_user")
    hits = settle(hits, "shared-hits")
    beside = (
        members.alias("m")
        .join(hits.filter("user_id <> main_user").alias("h"), _same_member("m", "h"))
        .groupBy("m.bucket_id", "m.request_id", *[F.col(f"h.{c}").alias(c) for c in scope], "h.main_user")
        .agg(F.count(F.lit(1)).alias("n_others"))
    )
    main_hits = hits.filter("user_id = main_user").select(*scope, "roles", F.lit(True).alias("main_reached"))
    looked_up = beside.alias("k").join(
        members.select("experiment_id", "bucket_id", "request_id", "user_id", "roles").alias("m"),
        same_key("k", "m", ["experiment_id", "bucket_id", "request_id"], never_null=["request_id"]) & (F.col("k.main_user") == F.col("m.user_id")),
        "left",
    ).select("k.*", "m.roles")
    found = looked_up.alias("k").join(
        main_hits.alias("h"), same_key("k", "h", scope) & (F.col("k.roles") == F.col("h.roles")), "left"
    )
    again = F.col("n_others") + F.when(F.col("main_reached"), 1).otherwise(0) - 1
    return found.select(
        *[f"k.{c}" for c in [*ARM, "request_id"]],
        F.lit(0).alias("users"), F.lit(0).alias("contacting"), (-again).alias("n_ids"), F.lit(0).alias("n_requests"),
    )


def request_arms(assignments: DataFrame, quotes: DataFrame, cases: DataFrame) -> DataFrame:
    """Users, users with a case and cases per arm of request-level experiments.

    Each request counts its users, contacting users and distinct cases over the largest number of
    requests any of its users has in the experiment, rounded; requests are then summed per arm.

    A user's cases are counted once per experiment instead of once per request, and added up over the
    users of a request. That equals the distinct count as long as a case id stands on one row. Ids that
    stand on several rows are counted distinctly per user, and what users of one request share is taken
    off again.
    """
    return _request_arms(assignments, quotes, settle(contact_cases(cases), "contact-cases"))


def _request_arms(assignments: DataFrame, quotes: DataFrame, found: DataFrame) -> DataFrame:
    members = settle(request_members(assignments, quotes), "request-members")
    spans = settle(_user_spans(members), "user-spans")
    repeated_ids = settle(
        found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("case_id").isNotNull() & (F.col("n") > 1)).select("case_id"),
        "repeated-case-ids",
    )
    flagged = found.join(repeated_ids.withColumn("repeated", F.lit(True)), "case_id", "left")
    counted_once = F.col("case_id").isNotNull() & F.col("repeated").isNull()
    per_span = count_in_intervals(
        spans, flagged, key="user_id", start="since", stop="until", at="created_time",
        measures={"n_rows": F.lit(1), "n_ids": F.when(counted_once, 1).otherwise(0)},
    )
    repeated = settle(found.join(repeated_ids, "case_id", "left_semi"), "repeated-cases")
    reached = settle(_repeated_reached(spans, repeated), "repeated-reached")
    more = reached.groupBy(*MEMBER).agg(F.count(F.lit(1)).alias("n_more"))
    per_span = (
        per_span.alias("s").join(more.alias("r"), _same_member("s", "r"), "left")
        .select("s.*", F.coalesce("r.n_more", F.lit(0)).alias("n_more"))
        .withColumn("n_ids", F.col("n_ids") + F.col("n_more"))
    )
    request = [*ARM, "request_id"]
    rows = (
        members.alias("m")
        .join(per_span.alias("s"), _same_member("m", "s"))
        .select(
            "m.experiment_id", "m.bucket_id", "s.experiment_start_time", "s.experiment_stop_time", "m.request_id",
            F.lit(1).alias("users"), F.when(F.col("s.n_rows") > 0, 1).otherwise(0).alias("contacting"),
            F.col("s.n_ids").alias("n_ids"), F.col("s.n_requests").alias("n_requests"),
        )
    )
    per_request = (
        rows.unionByName(_counted_again(members, reached)).groupBy(*request)
        .agg(
            F.sum("users").alias("users"), F.sum("contacting").alias("contacting"),
            F.sum("n_ids").alias("ids"), F.max("n_requests").alias("weight"),
        )
    )

    def rounded(count: str) -> Column:
        return F.sum(F.round(F.col(count) / F.col("weight"), 0))

    return per_request.groupBy(*ARM).agg(
        rounded("users").alias("tot_bucket_users"),
        rounded("contacting").alias("contact_bucket_users"),
        rounded("ids").alias("num_cases"),
    )


def experiment_report(
    user_assignments: DataFrame, request_assignments: DataFrame, quotes: DataFrame, cases: DataFrame
) -> DataFrame:
    """Arms of request-level and of user-level experiments, tagged; counts widen to double."""
    found = settle(contact_cases(cases), "contact-cases")
    return union_by_position(
        tagged(_request_arms(request_assignments, quotes, found), assignment_type="request"),
        tagged(_user_arms(user_assignments, found), assignment_type="user"),
    )
