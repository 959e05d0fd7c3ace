"""Case state: derivation, projection, change-only upsert, notices and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import join_optional
from docketry.operators.routing import applicant_name
from docketry.operators.triage import with_priority
from docketry.sources import fixed


def derive_state(classification: Column, completion: Column, generation: Column, result: Column, routing: Column,
                 completed_notices: Column, notices: Column) -> Column:
    """Lifecycle state. Notice counts: how many audiences exist, how many are done."""
    differs = lambda col, value: ~F.coalesce(col == value, F.lit(False))
    return (
        F.when(differs(classification, "classified"), "needs_review")
        .when(completion.isNull(), "extracting")
        .when(completion.isin("missing_information", "invalid_information"), "waiting_for_user")
        .when(generation == "failed", "failed")
        .when(generation.isNull() | generation.isin("queued", "processing"), "ready_for_processing")
        .when(result == "review_required", "needs_review")
        .when(differs(routing, "routed"), "draft_prepared")
        .when((notices == 2) & (completed_notices == 2), "completed")
        .otherwise("notification_pending"))


def next_start_action(classification: Column, completion: Column, generation: Column, attempts: Column) -> Column:
    ready = F.coalesce((classification == "classified") & (completion == "complete"), F.lit(False))
    return (
        F.when(~ready, "none")
        .when(generation.isNull(), F.when(attempts == 0, "start").otherwise("none"))
        .when(generation == "failed", F.when(attempts < fixed.MAX_START_ATTEMPTS, "retry").otherwise("terminal_failure"))
        .otherwise("none"))


def next_start_job(state: Column, attempts: Column, generation: Column, now: Column) -> Column:
    """struct<state, next_attempt_at, error_code> of a waiting start job after its draft ended."""
    retry = attempts < fixed.MAX_START_ATTEMPTS
    later = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(fixed.RETRY_COOLDOWN_SECONDS)))
    row = lambda s, t, e: F.struct(s.alias("state"), t.alias("next_attempt_at"), e.alias("error_code"))
    none, text = F.lit(None).cast("timestamp_ntz"), lambda v: F.lit(v).cast("string")
    return (
        F.when((generation == "completed") & state.isin("pending", "claimed", "waiting"), row(text("completed"), none, text(None)))
        .when((generation == "failed") & (state == "waiting") & retry, row(text("pending"), later.cast("timestamp_ntz"), text(None)))
        .when((generation == "failed") & (state == "waiting"), row(text("failed"), none, text("F04_TERMINAL_FAILURE")))
        .otherwise(row(state, none, text(None))))


def project_cases(classification: DataFrame, validation: DataFrame, generations: DataFrame, routes: DataFrame, notifications: DataFrame,
                  start_jobs: DataFrame, intake: DataFrame, **priority) -> DataFrame:
    """Current projection of every classified case (one row per case)."""
    c = F.col
    rev = c("source_case_revision").alias("_rev")  # of the validation: without one, no route, notice or job belongs to the case
    notices = notifications.groupBy("case_id", "source_case_revision").agg(
        F.count_distinct("audience").alias("_notices"), F.count_distinct(F.when(c("generation_status") == "completed", c("audience"))).alias("_done"))
    # The text is rated where it lies; only its priority travels through the joins.
    rated = with_priority(intake.select("case_id", "original_text"), "original_text", **priority).drop("original_text")
    joined = (
        classification.select("case_id", c("status").alias("classification_status"))
        .join(rated, "case_id", "left")
        .join(validation.select("case_id", c("revision").alias("_rev"), "completion_status", "current_generation_id"), "case_id", "left"))
    joined = join_optional(joined, generations.select("generation_id", "generation_status", "result_status"), "current_generation_id", "case_id", "generation_id")
    joined = (
        joined.join(routes.select("case_id", rev, "routing_status"), ["case_id", "_rev"], "left")
        .join(notices.select("case_id", rev, "_notices", "_done"), ["case_id", "_rev"], "left")
        .join(start_jobs.select("case_id", rev, "attempt_count"), ["case_id", "_rev"], "left")
        .withColumn("revision", F.coalesce("_rev", F.lit(1).cast("bigint"))))
    state = derive_state(c("classification_status"), c("completion_status"), c("generation_status"), c("result_status"), c("routing_status"),
                         F.coalesce("_done", F.lit(0)), F.coalesce("_notices", F.lit(0)))
    failed = F.coalesce(c("generation_status") == "failed", F.lit(False))
    terminal = failed & (F.coalesce("attempt_count", F.lit(0)) >= fixed.MAX_START_ATTEMPTS)
    steps = F.array_compact(F.array(
        F.lit("F-01"), F.lit("F-02"), F.when(c("completion_status") == "complete", "F-03"),
        F.when(c("generation_status") == "completed", "F-04"), F.when(c("routing_status") == "routed", "F-05")))
    projected = (
        joined.withColumn("state", F.when(failed & ~terminal, "ready_for_processing").otherwise(state))
        .withColumn("completed_steps", steps).withColumn("last_error_code", F.when(terminal, "F04_TERMINAL_FAILURE")))
    level, score, reason = priority.get("default", fixed.DEFAULT_PRIORITY)
    return projected.select(
        "case_id", "revision", "state", "completed_steps", "last_error_code", F.coalesce("priority_level", F.lit(level)).alias("priority_level"),
        F.coalesce("priority_score", F.lit(score)).alias("priority_score"), F.coalesce("priority_reason", F.lit(reason)).alias("priority_reason"))


STATE_COLUMNS = ("revision", "state", "completed_steps", "last_error_code", "priority_level", "priority_score", "priority_reason")


def apply_projection(previous: DataFrame, projected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, changes). A completed case stays completed at its revision
    and rows that would not differ are left alone."""
    p, n = previous.alias("p"), projected.alias("n")
    joined = p.join(n, F.col("p.case_id") == F.col("n.case_id"), "full_outer")
    old, new = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"n.{c}"))
    sticky = F.coalesce((old("state") == "completed") & (old("revision") == new("revision")), F.lit(False))
    value = {c: new(c) for c in STATE_COLUMNS}
    value["state"] = F.when(sticky, "completed").otherwise(new("state"))
    value["last_error_code"] = F.when(~sticky, new("last_error_code"))
    differs = F.lit(False)
    for c in STATE_COLUMNS:
        differs = differs | ~old(c).eqNullSafe(value[c])
    changed = F.when(F.col("n.case_id").isNull(), False).when(F.col("p.case_id").isNull(), True).otherwise(differs)
    full = joined.select(
        F.coalesce("p.case_id", "n.case_id").alias("case_id"),
        *[F.when(changed, value[c]).otherwise(old(c)).alias(c) for c in STATE_COLUMNS],
        changed.alias("changed"), F.col("p.case_id").isNull().alias("is_new"))
    return full.select("case_id", *STATE_COLUMNS), full.where("changed").drop("changed")


def action_log_rows(changes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Append-only log rows of a change set; ``carry`` keeps further columns of it, so
    that a reader of the log need not join the change set again."""
    return changes.select("case_id", F.lit("state_projected").alias("action_type"), F.lit("system").alias("actor"),
                          F.struct("revision", "state", "completed_steps", "last_error_code").alias("facts"), *carry)


def case_notices(validation: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Applicant notices for missing or invalid fields, once per case, revision and kind."""
    c = F.col
    gaps = validation.where(c("completion_status").isin("missing_information", "invalid_information"))
    ids = lambda name: F.transform(name, lambda f: f["id"])
    rows = gaps.select("case_id", c("revision").alias("source_case_revision"), F.lit("applicant").alias("audience"), c("completion_status").alias("kind"),
                       F.when(c("completion_status") == "missing_information", ids("missing_fields")).otherwise(ids("invalid_fields")).alias("fields"))
    rows = rows.dropDuplicates(["case_id", "source_case_revision", "kind"])
    if existing is None:
        return rows
    return rows.join(existing.select("case_id", "source_case_revision", "kind"), ["case_id", "source_case_revision", "kind"], "left_anti")


def ticket_reference(case_id: Column) -> Column:
    return F.concat(F.lit("CA-"), F.upper(F.substring(F.replace(case_id.cast("string"), F.lit("-"), F.lit("")), 1, 8)))


def applicant_reference(case_id: Column) -> Column:
    compact = F.upper(F.replace(case_id, F.lit("-"), F.lit("")))
    return F.when(F.length(compact) >= 8, F.concat(F.lit("DB-"), F.substring(compact, 1, 4), F.lit("-"), F.substring(compact, 5, 4))).otherwise(F.upper(case_id))


def metadata_text(metadata: Column, key: str) -> Column:
    """String entry of a JSON metadata object; other types and "" read as absent."""
    raw = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")
    text = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "string")
    return F.when((F.schema_of_variant(raw) == "STRING") & (text != ""), text)


ROLE_COLUMNS = {
    "USER": ("case_id", "state", "validation_status", "routing_status", "applicant_notifications"),
    "ADMIN": ("case_id", "state", "validation_status", "routing_status", "applicant_notifications", "validated_fields", "target_notification"),
}


def project_for_role(df: DataFrame, role: str) -> DataFrame:
    if role not in ROLE_COLUMNS:
        raise ValueError("role must be USER or ADMIN")
    return df.select(*[c for c in ROLE_COLUMNS[role] if c in df.columns])


def correspondence_view(validation: DataFrame, generations: DataFrame) -> DataFrame:
    """Per case the current draft; details only once it is completed."""
    c = F.col
    joined = validation.select("case_id", c("revision").alias("case_revision"), c("current_generation_id").alias("generation_id")).join(generations, "generation_id", "left")
    done, failed = c("generation_status") == "completed", c("generation_status") == "failed"
    return joined.select(
        "case_id", "case_revision", F.coalesce("generation_status", F.lit("not_requested")).alias("generation_status"),
        F.when(done | failed, c("generation_id")).alias("generation_id"), F.when(failed, c("error_code")).alias("error_code"),
        *[F.when(done, c(n)).alias(n) for n in ("source_status", "result_status", "document_summary", "correspondence_type", "draft_text")])


def routing_view(validation: DataFrame, routes: DataFrame, notifications: DataFrame) -> DataFrame:
    c = F.col
    keys = ["case_id", "source_case_revision"]
    listed = notifications.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("audience", "generation_status"))).alias("notifications"))
    base = validation.select("case_id", c("revision").alias("source_case_revision"))
    return (base.join(routes.select(*keys, "routing_status", "route_kind", "target_department_id", "target_unit_id"), keys, "left")
            .join(listed, keys, "left").withColumn("routing_status", F.coalesce("routing_status", F.lit("not_routed"))))


def document_view(intake: DataFrame) -> DataFrame:
    c = F.col
    return intake.select("case_id", "document_id", "source_type", "language", metadata_text(c("source_metadata"), "title").alias("title"),
                         metadata_text(c("source_metadata"), "channel").alias("channel"), "created_at", F.coalesce("original_text", F.lit("")).alias("text"))


def action_log_view(log: DataFrame) -> DataFrame:
    """Allow-listed facts of the log; malformed facts read as absent."""
    c = F.col
    return log.where("action_type = 'state_projected'").select(
        "case_id", "action_id", c("action_type").alias("type"), "actor", c("facts.state").alias("state"),
        F.when(c("facts.revision") > 0, c("facts.revision")).alias("case_revision"),
        F.coalesce("facts.completed_steps", F.array().cast("array<string>")).alias("completed_steps"), c("facts.last_error_code").alias("last_error_code"), "occurred_at")


def case_status(states: DataFrame, validation: DataFrame, routes: DataFrame, notices: DataFrame, classification: DataFrame, assignments: DataFrame,
                behavior: DataFrame, tickets: DataFrame, log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Administrator status row of every case.

    Child lists are aggregated before they are joined; the open count of an
    owner is one grouped join instead of a correlated subquery. The behaviour
    columns of an assignment's reason override the fresh text signal.
    """
    c = F.col
    rev = c("source_case_revision").alias("revision")
    notice_list = notices.groupBy("case_id", "source_case_revision").agg(F.array_sort(F.collect_list("kind")).alias("applicant_notifications"))
    open_count = assignments.where("assignment_status = 'assigned'").groupBy("staff_id").agg(F.count("*").alias("open_assignment_count"))
    actions = log.groupBy("case_id").agg(F.count("*").alias("action_count"), F.max_by("facts.state", "action_id").alias("last_logged_state"))
    owner = assignments.select("case_id", rev, "assignment_status", "staff_id", "selection_reason")
    joined = (
        states.join(validation.select("case_id", c("completion_status").alias("validation_status"), "accepted_fields"), "case_id", "left")
        .join(classification.select("case_id", "department_id", "unit_id", "request_type_id"), "case_id", "left")
        .join(routes.select("case_id", rev, "routing_status", "target_unit_id"), ["case_id", "revision"], "left")
        .join(notice_list.select("case_id", rev, "applicant_notifications"), ["case_id", "revision"], "left")
        .join(owner, ["case_id", "revision"], "left"))
    joined = (
        join_optional(joined, open_count, "staff_id", "case_id")
        .join(behavior.select("case_id", "repeat_count", "aggression_level", "aggression_score", "marker_count", "priority_mode"), "case_id", "left")
        .join(tickets.select("case_id", "ticket_reference"), "case_id", "left").join(actions, "case_id", "left")
        .join(feedback.select("case_id", rev, c("status").alias("feedback_status")), ["case_id", "revision"], "left"))
    over = lambda name: F.coalesce(c(f"selection_reason.{name}"), c(name)).alias(name)
    return joined.select(
        "case_id", "revision", "state", "completed_steps", "last_error_code", "validation_status",
        F.coalesce("routing_status", F.lit("not_routed")).alias("routing_status"),
        F.coalesce("applicant_notifications", F.array().cast("array<string>")).alias("applicant_notifications"),
        applicant_name(c("accepted_fields")).alias("applicant_name"), "department_id", "unit_id", "request_type_id", "target_unit_id", "assignment_status", "staff_id",
        F.when(c("assignment_status").isNotNull(), F.coalesce("open_assignment_count", F.lit(0))).alias("open_assignment_count"),
        over("repeat_count"), over("aggression_level"), over("aggression_score"), over("marker_count"), "priority_mode", "ticket_reference",
        F.coalesce("action_count", F.lit(0)).alias("action_count"), "last_logged_state", "feedback_status")


def case_trace(intake: DataFrame, states: DataFrame, classification: DataFrame, validation: DataFrame, generations: DataFrame,
                   routes: DataFrame, notifications: DataFrame) -> DataFrame:
    """End-to-end trace of each document with its latest draft."""
    c = F.col
    facts = F.struct("generation_status", "source_status", "result_status", "correspondence_type", F.size("regulation_suggestions").alias("citations"))
    # Null creation times sort behind every known one.
    latest = generations.groupBy("case_id").agg(F.max_by(facts, F.struct(c("created_at").isNotNull(), "created_at", "generation_id")).alias("g"))
    route = routes.groupBy("case_id").agg(F.max_by(F.struct("routing_id", "route_kind", "target_unit_label", "routing_status"), "source_case_revision").alias("r"))
    done = notifications.where("generation_status = 'completed'").groupBy("routing_id").agg(F.count("*").alias("notifications_done"))
    traced = (
        intake.select("document_id", "case_id").join(states.select("case_id", "state"), "case_id", "left")
        .join(classification.select("document_id", "request_type_id", "confidence", c("status").alias("classification_status")), "document_id", "left")
        .join(validation.select("document_id", "completion_status"), "document_id", "left").join(latest, "case_id", "left").join(route, "case_id", "left")
        .select("document_id", "state", "request_type_id", "confidence", "classification_status", "completion_status", "g.*", "r.*"))
    return (
        join_optional(traced, done, "routing_id", "document_id")
        .withColumn("citations", F.coalesce("citations", F.lit(0))).withColumn("notifications_done", F.coalesce("notifications_done", F.lit(0))).drop("routing_id"))
