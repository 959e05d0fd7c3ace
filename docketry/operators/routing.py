"""Route selection and creation, applicant identity, overlooked work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import join_optional, lookup, spread_join
from docketry.functions.text import ascii_fold, casefold, collapse_spaces, strip
from docketry.sources import fixed


def select_routes(cases: DataFrame, tax: dict[str, DataFrame], fallback=(fixed.FALLBACK_DEPARTMENT, fixed.FALLBACK_UNIT)) -> DataFrame:
    """One active target per case, or the reason why there is none.

    cases carry classification_status, completion_status, result_status,
    department_id and unit_id. An inactive or unknown target is refused; only an
    unusable draft falls back.
    """
    c = F.col
    own, spare = c("result_status") == "draft_ready", c("result_status").isin("review_required", "not_requested")
    aimed = (
        cases.withColumn("route_kind", F.when(own, "classified").when(spare, "fallback"))
        .withColumn("target_department_id", F.when(own, c("department_id")).when(spare, fallback[0]))
        .withColumn("target_unit_id", F.when(own, c("unit_id")).when(spare, fallback[1])))
    departments = tax["departments"].select(c("department_id").alias("target_department_id"), c("department_label").alias("target_department_label"), c("active").alias("_dep_active"))
    units = tax["units"].select(c("unit_id").alias("target_unit_id"), c("unit_label").alias("target_unit_label"), c("department_id").alias("_unit_dep"), c("active").alias("_unit_active"))
    chained = aimed.join(lookup(departments), "target_department_id", "left").join(lookup(units), "target_unit_id", "left")
    invalid = c("_dep_active").isNull() | c("_unit_active").isNull() | (c("_unit_dep") != c("target_department_id"))
    code = (
        F.when(~F.coalesce(c("classification_status") == "classified", F.lit(False)), "CLASSIFICATION_NOT_ROUTEABLE")
        .when(~F.coalesce(c("completion_status") == "complete", F.lit(False)), "CASE_NOT_COMPLETE")
        .when(c("route_kind").isNull(), "CORRESPONDENCE_NOT_ROUTEABLE")
        .when(F.coalesce(invalid, F.lit(True)), "ROUTING_TARGET_INVALID")
        .when(~(c("_dep_active") & c("_unit_active")), "ROUTING_TARGET_INACTIVE"))
    judged = chained.withColumn("rejection_code", code).drop("_dep_active", "_unit_active", "_unit_dep")
    for name in ("route_kind", "target_department_id", "target_department_label", "target_unit_id", "target_unit_label"):
        judged = judged.withColumn(name, F.when(c("rejection_code").isNull(), c(name)))
    return judged


def create_routes(jobs: DataFrame, state: DataFrame, classification: DataFrame, generations: DataFrame, tax: dict[str, DataFrame],
                  existing: DataFrame | None = None, fallback=(fixed.FALLBACK_DEPARTMENT, fixed.FALLBACK_UNIT)) -> tuple[DataFrame, DataFrame]:
    """Routing jobs -> (routes or refusals, queued notifications).

    jobs(case_id, source_case_revision, source_generation_id). A job must aim at
    the current revision; each (case, revision) is routed once.
    """
    c = F.col
    # Of jobs for the same revision the one with the smallest draft id counts, none last.
    wanted = jobs.groupBy("case_id", "source_case_revision").agg(F.min("source_generation_id").alias("source_generation_id"))
    if existing is not None:
        wanted = wanted.join(existing.select("case_id", "source_case_revision"), ["case_id", "source_case_revision"], "left_anti")
    generation = generations.select(c("generation_id").alias("source_generation_id"), "generation_status", c("result_status").alias("_result"), "source_status")
    facts = (
        wanted.join(state.select("case_id", "revision", "completion_status", "request_type_id"), "case_id", "left")
        .join(classification.select("case_id", c("status").alias("classification_status"), "department_id", "unit_id"), "case_id", "left"))
    facts = join_optional(facts, generation, "source_generation_id", "case_id")
    requested = c("source_generation_id").isNotNull()
    facts = facts.withColumn("result_status", F.when(requested, c("_result")).otherwise("not_requested")).drop("_result")
    judged = select_routes(facts, tax, fallback)
    stale = c("revision").isNull() | (c("revision") != c("source_case_revision"))
    unusable = requested & ~F.coalesce((c("generation_status") == "completed") & c("result_status").isin("draft_ready", "review_required"), F.lit(False))
    routes = judged.withColumn("rejection_code", F.when(stale, "CASE_REVISION_CONFLICT").when(unusable, "CORRESPONDENCE_NOT_ROUTEABLE").otherwise(c("rejection_code")))
    routes = routes.withColumn("routing_status", F.when(c("rejection_code").isNull(), "routed"))
    for name in ("route_kind", "target_department_id", "target_department_label", "target_unit_id", "target_unit_label"):
        routes = routes.withColumn(name, F.when(c("rejection_code").isNull(), c(name)))
    queued = routes.where(c("routing_status") == "routed").select(
        "case_id", "source_case_revision", F.explode(F.array(F.lit("applicant"), F.lit("target_unit"))).alias("audience"), F.lit("queued").alias("generation_status"))
    return routes, queued


def applicant_name(fields: Column) -> Column:
    """First present applicant field of an accepted-fields map."""
    value = lambda k: F.try_element_at(fields, F.lit(k))["value"]
    return F.coalesce(*[F.when(F.length(value(k)) > 0, value(k)) for k in fixed.APPLICANT_NAME_KEYS])


def identity_key(fields: Column) -> Column:
    """Assignment variant: case-folded, blanks collapsed; "" when nobody is named."""
    value = lambda k: strip(F.try_element_at(fields, F.lit(k))["value"])
    first = F.coalesce(*[F.when(F.length(value(k)) > 0, value(k)) for k in fixed.APPLICANT_NAME_KEYS], F.lit(""))
    return collapse_spaces(casefold(first))


def folded_identity(fields: Column) -> Column:
    """History variant: diacritics folded as well; null when nobody is named."""
    return collapse_spaces(ascii_fold(applicant_name(fields)))


def repeat_counts(cases: DataFrame, identity: str = "identity", topic: str = "topic", key: str = "case_id", **spread) -> DataFrame:
    """Cases of the same applicant and topic, this one included; 0 if unnamed.

    Counted by a combined aggregation and joined back, so a name that owns a
    third of all cases never becomes one window partition.
    """
    named = cases.where(F.col(identity) != "")
    unnamed = cases.where(F.coalesce(F.col(identity) == "", F.lit(True)))  # beside the join, not one hot key of it
    counts = named.groupBy(identity, topic).agg(F.count("*").alias("repeat_count"))
    # Counting the same rows for hot keys lets Spark reuse this exchange.
    joined = spread_join(named, counts, [identity, topic], key, **{"count_on": named, **spread})
    counted = joined.withColumn("repeat_count", F.coalesce("repeat_count", F.lit(0)))
    return counted.unionByName(unnamed.withColumn("repeat_count", F.lit(0).cast("long")))


def overlooked(state: DataFrame, classification: DataFrame, generations: DataFrame, routes: DataFrame, start_jobs: DataFrame) -> DataFrame:
    """Complete, classified cases without a route whose draft is done or given up."""
    c = F.col
    ready = (
        state.where("completion_status = 'complete'")
        .join(classification.where("status = 'classified'").select("case_id"), "case_id", "left_semi")
        .join(routes.select("case_id", c("source_case_revision").alias("revision")), ["case_id", "revision"], "left_anti"))
    ready = join_optional(ready, generations.select("generation_id", "generation_status"), "current_generation_id", "case_id", "generation_id")
    given_up = start_jobs.where((c("state") == "failed") | ((c("state") == "waiting") & (c("attempt_count") >= fixed.MAX_START_ATTEMPTS)))
    given_up = given_up.select("case_id", c("source_case_revision").alias("revision")).distinct().withColumn("_given_up", F.lit(True))
    joined = ready.join(given_up, ["case_id", "revision"], "left")
    wanted = (c("generation_status") == "completed") | (c("current_generation_id").isNull() & F.coalesce("_given_up", F.lit(False)))
    return joined.where(wanted).select("case_id", c("revision").alias("source_case_revision"), c("current_generation_id").alias("source_generation_id"),
                                       F.lit("reconciliation").alias("recovery_reason"))


def unassigned_routes(routes: DataFrame, assignments: DataFrame, state: DataFrame) -> DataFrame:
    """Routed current revisions nobody owns yet."""
    keys = ["case_id", "source_case_revision"]
    current = state.select("case_id", F.col("revision").alias("source_case_revision"), "request_type_id")
    return routes.join(assignments.select(*keys), keys, "left_anti").join(current, keys).select(*keys, "target_unit_id", "request_type_id")


def close_assignments(assignments: DataFrame, changes: DataFrame) -> DataFrame:
    """Close what a state change ends: the completed revision, or older revisions.

    changes(case_id, revision, state) holds one row per changed case.
    """
    c = F.col
    joined = assignments.join(changes.select("case_id", c("revision").alias("_rev"), c("state").alias("_state")), "case_id", "left")
    done = (c("_state") == "completed") & (c("source_case_revision") == c("_rev"))
    superseded = (c("_state") != "completed") & (c("_rev") > 1) & (c("source_case_revision") < c("_rev"))
    closes = F.coalesce((c("assignment_status") == "assigned") & (done | superseded), F.lit(False))
    marked = joined.withColumn("closed_now", closes).drop("_rev", "_state")
    return marked.withColumn("assignment_status", F.when(c("closed_now"), "completed").otherwise(c("assignment_status")))
