"""Demo cases: one fixture row per case, expanded to every case table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry.operators.cases import ticket_reference
from docketry.sources import fixed

FIXTURE_SCHEMA = (
    "array<struct<slug string, name string, type string, label string, department string, department_label string, "
    "unit string, unit_label string, text string, state string, priority string, age int, aggression string, repeat int>>"
)


def derived_id(kind: str, slug: Column, prefix: str) -> Column:
    """Stable UUID-shaped id: md5 of prefix, kind and slug."""
    digest = F.md5(F.concat(F.lit(f"{prefix}-{kind}-"), slug))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def seed_cases(fixture: DataFrame, as_of: Column, prefix: str = "docketry-demo") -> dict[str, DataFrame]:
    """``fixture`` has the columns of FIXTURE_SCHEMA; ``as_of`` anchors all ages."""
    f = F.col
    row = fixture.select(
        "*",
        derived_id("case", f("slug"), prefix).alias("case_id"), derived_id("workflow", f("slug"), prefix).alias("workflow_id"),
        derived_id("generation", f("slug"), prefix).alias("generation_id"), derived_id("routing", f("slug"), prefix).alias("routing_id"),
        derived_id("assignment", f("slug"), prefix).alias("assignment_id"),
        F.concat(F.lit("demo-"), f("slug")).alias("document_id"),
        F.when(f("type") == "manual", "needs_review").otherwise("classified").alias("class_status"),
        F.when(f("priority") == "critical", 100).when(f("priority") == "high", 70).otherwise(40).alias("priority_score"),
        F.when(f("state") == "completed", F.array(*map(F.lit, ("F-01", "F-02", "F-03", "F-04", "F-05"))))
        .otherwise(F.array(F.lit("F-01"), F.lit("F-02"))).alias("completed_steps"),
        (as_of - F.make_dt_interval(f("age"))).alias("happened_at"),
    )
    classified = f("class_status") == "classified"
    fields = F.create_map(
        F.lit("applicant-name"), F.struct(f("name").alias("value"), F.lit(0.95).alias("confidence")),
        F.lit("tckn"), F.struct(F.lit("10000000146").alias("value"), F.lit(1.0).alias("confidence")),
        F.lit("phone"), F.struct(F.lit("05320000000").alias("value"), F.lit(1.0).alias("confidence")))
    waiting = f("state") == "waiting_for_user"
    done = row.where(f("state") == "completed")
    staff = F.concat("unit", F.lit("-operator-1"))
    flagged = (f("repeat") >= fixed.REPEAT_TRIGGER) | f("aggression").isin("elevated", "high")
    return {
        "intake": row.select("document_id", "case_id", "workflow_id", F.lit("text").alias("source_type"), f("text").alias("original_text"),
                             f("text").alias("normalized_text"), f("slug").alias("correlation_id"), F.lit("queued").alias("ingest_status"),
                             F.lit("tr").alias("language"), f("happened_at").alias("created_at")),
        "classification": row.select(
            "document_id", "case_id", f("class_status").alias("status"), f("department").alias("department_id"), "department_label",
            f("unit").alias("unit_id"), "unit_label", F.when(classified, f("type")).alias("request_type_id"),
            F.when(classified, f("label")).alias("request_type_label"), F.when(classified, 0.96).otherwise(0.44).alias("confidence"),
            F.lit(fixed.TAXONOMY_VERSION).alias("taxonomy_version"), F.lit(fixed.SIGNAL_CLASSIFIER_VERSION).alias("classifier_version"),
            F.when(classified, "Demo fixture: konu sinyalleri ve politika eşleşti.")
            .otherwise("Güven eşiği altında; insan incelemesi gerekli.").alias("classification_reason")),
        "validation": row.where(f("state").isin("completed", "waiting_for_user")).select(
            "case_id", "document_id", f("type").alias("request_type_id"), fields.alias("accepted_fields"),
            F.when(waiting, F.array(F.struct(F.lit("incident-address").alias("id"), F.lit("Olay adresi").alias("label"))))
            .otherwise(F.array().cast("array<struct<id:string,label:string>>")).alias("missing_fields"),
            F.when(waiting, "missing_information").otherwise("complete").alias("completion_status"), F.lit(1).cast("bigint").alias("revision")),
        "case_state": row.select(
            "case_id", F.lit(1).cast("bigint").alias("revision"), "state", "completed_steps", F.lit(None).cast("string").alias("last_error_code"),
            f("priority").alias("priority_level"), "priority_score",
            F.when(f("priority") == "critical", "Güvenlik ve hizmet kesintisi sinyali")
            .when(f("priority") == "high", "Tekrarlanan veya etkisi yüksek başvuru")
            .otherwise(fixed.DEFAULT_PRIORITY[2]).alias("priority_reason"), f("happened_at").alias("updated_at")),
        "ticket": row.select("case_id", ticket_reference(f("case_id")).alias("ticket_reference"), f("happened_at").alias("created_at")),
        "action_log": row.select("case_id", F.lit("state_projected").alias("action_type"), F.lit("system").alias("actor"),
                                 F.lit(1).cast("bigint").alias("revision"), "state", "completed_steps", f("happened_at").alias("occurred_at")),
        "case_notification": row.where(waiting).select(
            derived_id("applicant-notice", f("slug"), prefix).alias("notification_id"), "case_id", F.lit("missing_information").alias("kind"),
            F.lit("applicant").alias("audience"), F.lit("Dosyanızın ilerlemesi için eksik bilgileri tamamlayın.").alias("message")),
        "generation": done.select("generation_id", "case_id", "document_id", F.lit("completed").alias("generation_status"),
                                  F.lit("relevant_source_found").alias("source_status"), F.lit("draft_ready").alias("result_status"),
                                  F.lit("response_letter").alias("correspondence_type"), f("happened_at").alias("created_at")),
        "routing": done.select("routing_id", "case_id", "generation_id", F.lit("classified").alias("route_kind"), f("department").alias("target_department_id"),
                               f("unit").alias("target_unit_id"), F.lit("routed").alias("routing_status")),
        "assignment": done.select(
            "assignment_id", "case_id", f("unit").alias("unit_id"), staff.alias("staff_id"),
            F.replace(F.initcap(F.replace(staff, F.lit("-"), F.lit(" "))), F.lit("Operator"), F.lit("Operatörü")).alias("display_name"),
            F.when(flagged, "topic_resolution_rate").otherwise("least_open_workload").alias("policy"),
            F.when(f("aggression") == "high", 0.9).when(f("aggression") == "elevated", 0.65).otherwise(0.0).alias("aggression_score"),
            F.lit("completed").alias("assignment_status")),
        "notification": done.select("case_id", "routing_id", F.explode(F.array(
            F.struct(F.lit("applicant").alias("audience"), derived_id("notice-applicant", f("slug"), prefix).alias("notification_id")),
            F.struct(F.lit("target_unit").alias("audience"), derived_id("notice-unit", f("slug"), prefix).alias("notification_id")),
        )).alias("n")).select("n.notification_id", "n.audience", "case_id", "routing_id", F.lit("completed").alias("generation_status")),
    }
