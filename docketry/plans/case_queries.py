"""Queries over case state, queue, views, reference tables and evaluation.

``case_tables`` derives the whole set of case tables from orders and customers;
``_T`` is the same derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.scale import shared_dir
from docketry.operators import cases as C, evaluation as E, intake as I, queue as Q, classify as CL
from docketry.plans import bindings as B
from docketry.plans.registry import query, values
from docketry.sources import contracts, fixed, loaders, seeds, sinks
from docketry.sources.loaders import table

_PRIORITY = (("critical", 100, "1-urgent", "Urgent"), ("high", 70, "2-high", "High"))


def k():
    return F.col("k")


def case_tables(spark, folder):
    base = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    named = base.join(customers, "o_custkey")
    case, text = k().alias("case_id"), lambda p: F.concat(F.lit(p), k().cast("string"))
    completion = F.when(k() % 7 == 0, "missing_information").when(k() % 7 == 1, "invalid_information").otherwise("complete")
    drafted = (k() % 10 != 9) & (k() % 7 > 1) & (k() % 5 != 0)
    routed = drafted & (k() % 6 > 1) & (k() % 4 != 1) & (k() % 9 != 0)
    rev = (1 + k() % 2)
    gap = lambda on: F.when(on, F.array(F.struct(F.lit("phone").alias("id"), F.lit("Telefon").alias("label")))).otherwise(F.array().cast("array<struct<id:string,label:string>>"))
    bad = F.when(k() % 7 == 1, F.array(F.struct(F.lit("tckn").alias("id"), F.lit("Kimlik").alias("label"), F.lit("tckn_checksum").alias("code")))).otherwise(
        F.array().cast("array<struct<id:string,label:string,code:string>>"))
    name = F.map_from_arrays(F.array(F.when(k() % 11 == 0, "other").otherwise("applicant-name")), F.array(F.struct(F.col("c_name").alias("value"), F.lit(0.8).alias("confidence"))))
    routes = base.where(routed)
    return {
        "classification": named.select(
            case, text("d").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("classified").alias("status"),
            F.concat(F.lit("t"), (k() % 3).cast("string")).alias("request_type_id"), F.concat(F.lit("Type "), (k() % 3).cast("string")).alias("request_type_label"),
            F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("department_id"), F.concat(F.lit("Dep "), (F.col("c_nationkey") % 5).cast("string")).alias("department_label"),
            F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("unit_id"), F.concat(F.lit("Unit "), F.col("c_nationkey").cast("string")).alias("unit_label"),
            ((k() % 101) / 100).alias("confidence"), F.lit("signals").alias("reason")),
        "validation": named.where(k() % 10 != 9).select(
            case, text("d").alias("document_id"), F.concat(F.lit("t"), (k() % 3).cast("string")).alias("request_type_id"), rev.alias("revision"), completion.alias("completion_status"),
            F.when(drafted, text("g")).alias("current_generation_id"), name.alias("accepted_fields"), gap(k() % 7 == 0).alias("missing_fields"), bad.alias("invalid_fields")),
        "generations": base.where(drafted).select(
            text("g").alias("generation_id"), case, F.when(k() % 6 == 0, "failed").when(k() % 6 == 1, "processing").otherwise("completed").alias("generation_status"),
            F.when(k() % 4 == 1, "review_required").otherwise("draft_ready").alias("result_status"), F.when(k() % 4 == 1, "no_relevant_source").otherwise("relevant_source_found").alias("source_status"),
            F.lit("response_letter").alias("correspondence_type"), text("Summary ").alias("document_summary"), text("Draft ").alias("draft_text"), F.when(k() % 6 == 0, "STRUCTURED_OUTPUT_INVALID").alias("error_code"),
            F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k() % 3).cast("int")).alias("regulation_suggestions"), F.col("o_orderdate").alias("created_at")),
        "routes": routes.select(case, rev.alias("source_case_revision"), text("rt").alias("routing_id"), F.when(k() % 4 == 2, "fallback").otherwise("classified").alias("route_kind"), F.lit("routed").alias("routing_status"),
                                F.lit("r0").alias("target_department_id"), F.concat(F.lit("u"), (k() % 5).cast("string")).alias("target_unit_id"), F.concat(F.lit("Unit "), (k() % 5).cast("string")).alias("target_unit_label")),
        # Routes of cases without a validation: they belong to no revision of the case.
        "stray_routes": base.where((k() % 10 == 9) & (k() % 3 == 0)).select(case, F.lit(1).cast("long").alias("source_case_revision"), F.lit("routed").alias("routing_status")),
        "notifications": routes.select(case, rev.alias("source_case_revision"), text("rt").alias("routing_id"), F.explode(F.array(F.lit("applicant"), F.lit("target_unit"))).alias("audience")).withColumn(
            "generation_status", F.when((F.col("case_id") % 8 == 3) & (F.col("audience") == "target_unit"), "queued").otherwise("completed")),
        "start_jobs": base.where((k() % 10 != 9) & (k() % 7 > 1)).select(case, rev.alias("source_case_revision"), (F.floor(k() / 6) % 6).alias("attempt_count")),
        "intake": base.select(case, text("d").alias("document_id"), F.concat_ws(" ", F.lit("Order"), "o_orderpriority", "o_orderstatus").alias("original_text"), F.lit("text").alias("source_type"),
                              F.when(k() % 2 == 0, "tr").otherwise("en").alias("language"), F.col("o_orderdate").alias("created_at"),
                              F.when(k() % 4 == 0, F.concat(F.lit('{"title":"Order '), k().cast("string"), F.lit('","channel":"citizen-portal"}'))).when(k() % 4 == 1, '{"title":5,"channel":""}').otherwise("{}").alias("source_metadata")),
    }


def projected(t):
    routes = t["routes"].select("case_id", "source_case_revision", "routing_status")
    routes = routes.unionByName(t["stray_routes"]) if "stray_routes" in t else routes
    return C.project_cases(t["classification"], t["validation"], t["generations"], routes, t["notifications"], t["start_jobs"], t["intake"], rules=_PRIORITY)


_T = """o AS (SELECT o_orderkey AS k, o_orderstatus AS os, o_orderpriority AS op, o_orderdate AS od, c_name, c_nationkey AS nk FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT *, os <> 'P' AS classified, k % 10 <> 9 AS has_val, CASE WHEN k % 10 <> 9 THEN CASE k % 7 WHEN 0 THEN 'missing_information' WHEN 1 THEN 'invalid_information' ELSE 'complete' END END AS comp,
  k % 10 <> 9 AND k % 7 > 1 AND k % 5 <> 0 AS drafted FROM o),
t AS (SELECT *, CASE WHEN drafted THEN CASE k % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END END AS gen, CASE WHEN drafted THEN CASE WHEN k % 4 = 1 THEN 'review_required' ELSE 'draft_ready' END END AS res,
  drafted AND k % 6 > 1 AND k % 4 <> 1 AND k % 9 <> 0 AS routed, CASE WHEN has_val THEN 1 + k % 2 ELSE 1 END AS rev, (k // 6) % 6 AS att FROM b),
p AS (SELECT *, gen = 'failed' AND att >= 4 AS terminal, CASE WHEN NOT classified THEN 'needs_review' WHEN comp IS NULL THEN 'extracting' WHEN comp <> 'complete' THEN 'waiting_for_user' WHEN gen = 'failed' THEN 'failed'
  WHEN gen IS NULL OR gen = 'processing' THEN 'ready_for_processing' WHEN res = 'review_required' THEN 'needs_review' WHEN NOT routed THEN 'draft_prepared' WHEN k % 8 <> 3 THEN 'completed' ELSE 'notification_pending' END AS raw FROM t),
proj AS (SELECT *, CASE WHEN gen = 'failed' AND NOT terminal THEN 'ready_for_processing' ELSE raw END AS state, CASE WHEN terminal THEN 'F04_TERMINAL_FAILURE' END AS err,
  concat_ws(',', 'F-01', 'F-02', CASE WHEN comp = 'complete' THEN 'F-03' END, CASE WHEN gen = 'completed' THEN 'F-04' END, CASE WHEN routed THEN 'F-05' END) AS steps,
  CASE op WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 70 ELSE 40 END AS score, CASE op WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' ELSE 'Öncelik sinyali bulunmadı' END AS why FROM p)"""


@query("case_states", f"WITH {_T} SELECT k AS case_id, rev AS revision, state, steps, err AS last_error_code, score AS priority_score, why AS priority_reason FROM proj")
def case_states(spark, folder):
    out = projected(case_tables(spark, folder))
    return out.select("case_id", "revision", "state", F.array_join("completed_steps", ",").alias("steps"), "last_error_code", "priority_score", "priority_reason")


def _previous(current):
    """An older snapshot: some cases closed by hand, some unknown, some outdated."""
    c = F.col("case_id")
    return (current.where(c % 12 != 7).withColumn("state", F.when(c % 12 == 5, "completed").when(c % 12 == 2, "extracting").otherwise(F.col("state")))
            .withColumn("last_error_code", F.when(c % 12 != 5, F.col("last_error_code")))
            .withColumn("revision", F.when(c % 24 == 5, F.col("revision") + 1).otherwise(F.col("revision")))
            .withColumn("priority_score", F.when(c % 12 == 1, 40).otherwise(F.col("priority_score"))))


@query("case_changes", f"""
WITH {_T},
q AS (SELECT *, k % 12 = 7 AS is_new, CASE WHEN k % 12 = 5 THEN 'completed' WHEN k % 12 = 2 THEN 'extracting' ELSE state END AS old_state, CASE WHEN k % 24 = 5 THEN rev + 1 ELSE rev END AS old_rev,
  CASE WHEN k % 12 = 5 THEN NULL ELSE err END AS old_err, CASE WHEN k % 12 = 1 THEN 40 ELSE score END AS old_score FROM proj),
n AS (SELECT *, CASE WHEN old_state = 'completed' AND old_rev = rev THEN 'completed' ELSE state END AS new_state, CASE WHEN old_state = 'completed' AND old_rev = rev THEN NULL ELSE err END AS new_err FROM q)
SELECT k AS case_id, rev AS revision, CASE WHEN is_new THEN state ELSE new_state END AS state, CASE WHEN is_new THEN err ELSE new_err END AS last_error_code, score AS priority_score, is_new, 'CA-' || upper(md5(CAST(k AS VARCHAR))[1:8]) AS ticket FROM n
WHERE is_new OR rev IS DISTINCT FROM old_rev OR new_state IS DISTINCT FROM old_state OR new_err IS DISTINCT FROM old_err OR score <> old_score""")
def case_changes(spark, folder):
    """Only what really changed against the older snapshot, with its ticket."""
    current = projected(case_tables(spark, folder))
    _snapshot, changes = C.apply_projection(_previous(current), current)
    log = C.action_log_rows(changes, ("priority_score", "is_new"))
    ticket = C.ticket_reference(F.md5(F.col("case_id").cast("string"))).alias("ticket")
    return log.select("case_id", "facts.revision", "facts.state", "facts.last_error_code", "priority_score", "is_new", ticket)


@query("start_actions", f"""
WITH {_T} SELECT k AS case_id, CASE WHEN NOT classified OR comp IS DISTINCT FROM 'complete' THEN 'none' WHEN gen IS NULL THEN CASE WHEN att = 0 THEN 'start' ELSE 'none' END WHEN gen = 'failed' THEN CASE WHEN att < 4 THEN 'retry' ELSE 'terminal_failure' END ELSE 'none' END AS action,
  CASE WHEN gen = 'completed' THEN 'completed' WHEN gen = 'failed' AND att < 4 THEN 'pending' WHEN gen = 'failed' THEN 'failed' ELSE 'waiting' END AS job_state, CASE WHEN gen = 'failed' AND att < 4 THEN od + INTERVAL 30 SECOND END AS next_attempt_at FROM t""")
def start_actions(spark, folder):
    t = case_tables(spark, folder)
    joined = (t["classification"].select("case_id", "status").join(t["validation"].select("case_id", "completion_status", "current_generation_id"), "case_id", "left")
              .join(t["generations"].select(F.col("generation_id").alias("current_generation_id"), "generation_status"), "current_generation_id", "left")
              .join(t["intake"].select("case_id", "created_at"), "case_id"))
    attempts = F.floor(F.col("case_id") / 6) % 6
    job = C.next_start_job(F.lit("waiting"), attempts, F.col("generation_status"), F.col("created_at"))
    return joined.select("case_id", C.next_start_action(F.col("status"), F.col("completion_status"), F.col("generation_status"), attempts).alias("action"),
                         job["state"].alias("job_state"), job["next_attempt_at"].alias("next_attempt_at"))


@query("case_notices", f"""
WITH {_T} SELECT k AS case_id, rev AS source_case_revision, comp AS kind, CASE WHEN comp = 'missing_information' THEN 'phone' ELSE 'tckn' END AS fields FROM t WHERE comp IN ('missing_information', 'invalid_information') AND k % 3 <> 0""")
def case_notices(spark, folder):
    validation = case_tables(spark, folder)["validation"]
    sent = validation.where(F.col("case_id") % 3 == 0).select("case_id", F.col("revision").alias("source_case_revision"), F.col("completion_status").alias("kind"))
    return C.case_notices(validation, sent).select("case_id", "source_case_revision", "kind", F.array_join("fields", ",").alias("fields"))


@query("tickets", """
SELECT o_orderkey AS case_id, 'CA-' || upper(md5(CAST(o_orderkey AS VARCHAR))[1:8]) AS ticket, 'DB-' || upper(md5(CAST(o_orderkey AS VARCHAR))[1:4]) || '-' || upper(md5(CAST(o_orderkey AS VARCHAR))[5:8]) AS reference FROM orders""")
def tickets(spark, folder):
    ids = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    uuid = F.regexp_replace("h", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return ids.select("case_id", C.ticket_reference(uuid).alias("ticket"), C.applicant_reference(uuid).alias("reference"))


def list_rows(t):
    states = projected(t).join(t["intake"].select("case_id", F.col("created_at").alias("updated_at")), "case_id")
    return Q.case_rows(states, t["validation"], t["classification"], t["routes"], t["intake"])


@query("case_list_page", f"""
WITH {_T}, m AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'Order ' || k END AS title FROM proj WHERE state = 'needs_review' AND ('d' || k ILIKE '%der 1%' OR CAST(k AS VARCHAR) ILIKE '%der 1%' OR 'Type ' || (k % 3) ILIKE '%der 1%' OR coalesce(CASE WHEN k % 4 = 0 THEN 'Order ' || k END, '') ILIKE '%der 1%'
  OR coalesce(CASE WHEN has_val AND k % 11 <> 0 THEN c_name END, '') ILIKE '%der 1%'))
SELECT k AS case_id, 'd' || k AS document_id, score AS priority_score, od AS updated_at, title, CASE WHEN k % 4 = 0 THEN 'citizen-portal' END AS channel, CASE WHEN has_val AND k % 11 <> 0 THEN c_name END AS applicant_name,
  CASE WHEN routed THEN 'routed' ELSE 'not_routed' END AS routing_status, (SELECT count(*) FROM m) AS total FROM m ORDER BY score DESC, od DESC, k LIMIT 25 OFFSET 50""")
def case_list_page(spark, folder):
    """Third page of the review queue, searched without regard to case."""
    page = Q.case_list(list_rows(case_tables(spark, folder)), "needs_review", "DER 1", 25, 50)
    return page.select("case_id", "document_id", "priority_score", "updated_at", "title", "channel", "applicant_name", "routing_status", "total")


_TABS = values("tabs", "tab_ord, st, label", [(n, s, l) for n, (s, l) in enumerate(fixed.QUEUE_TABS)])


@query("queue_counts", f"WITH {_T}, {_TABS} SELECT tab_ord, st AS state, label, count(proj.k) AS cases FROM tabs LEFT JOIN proj ON st = '' OR proj.state = st GROUP BY 1, 2, 3")
def queue_counts(spark, folder):
    return Q.queue_counts(projected(case_tables(spark, folder)))


@query("automation_rate", f"WITH {_T} SELECT count(*) FILTER (WHERE state = 'completed') AS completed, count(*) AS total, CAST(floor(100.0 * count(*) FILTER (WHERE state = 'completed') / count(*) + 0.5) AS INTEGER) AS automation_percent FROM proj")
def automation_rate(spark, folder):
    return Q.automation_rate(projected(case_tables(spark, folder)))


@query("related_cases", r"""
WITH d AS (SELECT doc_id, lang AS who, list_distinct(regexp_extract_all(translate(lower(text), 'ığüşöç', 'igusoc'), '[a-z0-9]{3,}')) AS ts FROM documents),
x AS (SELECT a.doc_id, b.doc_id AS other, CASE WHEN len(a.ts) = 0 OR len(b.ts) = 0 THEN 0 ELSE CAST(round_even(100.0::DOUBLE * len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts)), 0) AS INTEGER) END AS s
  FROM d a JOIN d b ON a.who = b.who AND a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, other) AS p FROM x WHERE s >= 20)
SELECT d.doc_id AS case_id, CAST(count(r.other) AS BIGINT) AS similar_count, coalesce(string_agg(other || ':' || s, ',' ORDER BY p) FILTER (WHERE p <= 5), '') AS related FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY 1""")
def related_cases(spark, folder):
    """History of every document among all others of its language."""
    cases = table(spark, folder, "documents", spread="doc_id").select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("identity"), F.col("doc_id").alias("created_at"), "text")
    out = Q.related_cases(cases)
    return out.select("case_id", F.col("similar_count").cast("bigint").alias("similar_count"),
                      F.array_join(F.transform("related", lambda m: F.concat_ws(":", m["case_id"], m["score"].cast("string"))), ",").alias("related"))


@query("role_view", f"WITH {_T} SELECT k AS case_id, state, comp AS validation_status, CASE WHEN routed THEN 'routed' ELSE 'not_routed' END AS routing_status FROM proj")
def role_view(spark, folder):
    rows = list_rows(case_tables(spark, folder)).withColumn("validation_status", F.col("completion_status")).withColumn("validated_fields", F.col("accepted_fields"))
    return C.project_for_role(rows, "USER")


@query("admin_view", f"WITH {_T} SELECT k AS case_id, state, comp AS validation_status, CASE WHEN routed THEN 'routed' ELSE 'not_routed' END AS routing_status, CASE WHEN has_val AND k % 11 <> 0 THEN c_name END AS applicant FROM proj")
def admin_view(spark, folder):
    """What an administrator sees more than a user: the validated fields."""
    rows = list_rows(case_tables(spark, folder)).withColumn("validation_status", F.col("completion_status")).withColumn("validated_fields", F.col("accepted_fields"))
    shown = C.project_for_role(rows, "ADMIN")
    return shown.select("case_id", "state", "validation_status", "routing_status", F.try_element_at("validated_fields", F.lit("applicant-name"))["value"].alias("applicant"))


@query("event_log", "SELECT user_id, count(*) AS entries, max(event_id) AS last_event, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY 1")
def event_log(spark, folder):
    """Events appended to an immutable log in two writes, then read as one."""
    path = shared_dir(spark, "event-log")
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    sinks.append_log(events.where("event_id % 2 = 0"), path)
    sinks.append_log(events.where("event_id % 2 = 1"), path)
    log = spark.read.schema(events.schema).parquet(path)
    return log.groupBy("user_id").agg(F.count("*").alias("entries"), F.max("event_id").alias("last_event"), F.count_if(F.col("event_type") == "error").alias("errors"))


def _assignments(t):
    return t["routes"].select(
        "case_id", "source_case_revision", F.concat(F.lit("s"), (F.col("case_id") % 50).cast("string")).alias("staff_id"),
        F.when(F.col("case_id") % 8 == 3, "assigned").otherwise("completed").alias("assignment_status"),
        F.struct((F.col("case_id") % 5).cast("int").alias("repeat_count"), F.when(F.col("case_id") % 3 == 0, "elevated").otherwise("normal").alias("aggression_level"),
                 F.when(F.col("case_id") % 3 == 0, 0.35).otherwise(0.0).alias("aggression_score"), F.lit(1).alias("marker_count")).alias("selection_reason"))


@query("case_status", f"""
WITH {_T}, lg AS (SELECT l_orderkey AS k, count(*) AS n, arg_max(l_linestatus, (l_linenumber * 1000000 + l_partkey) * 10 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS last FROM lineitem GROUP BY 1),
op AS (SELECT k % 50 AS s, count(*) AS n FROM proj WHERE routed AND k % 8 = 3 GROUP BY 1)
SELECT proj.k AS case_id, rev AS revision, state, comp AS validation_status, CASE WHEN routed THEN 'routed' ELSE 'not_routed' END AS routing_status,
  CASE WHEN comp IN ('missing_information', 'invalid_information') THEN comp ELSE '' END AS notices, CASE WHEN has_val AND proj.k % 11 <> 0 THEN c_name END AS applicant_name, 'u' || nk AS unit_id,
  CASE WHEN routed THEN 's' || (proj.k % 50) END AS staff_id, CASE WHEN routed THEN coalesce(op.n, 0) END AS open_assignment_count, CASE WHEN routed THEN proj.k % 5 ELSE 7 END AS repeat_count,
  CASE WHEN routed THEN CASE WHEN proj.k % 3 = 0 THEN 'elevated' ELSE 'normal' END ELSE 'high' END AS aggression_level, 'CA-' || upper(md5(CAST(proj.k AS VARCHAR))[1:8]) AS ticket_reference,
  coalesce(lg.n, 0) AS action_count, lg.last AS last_logged_state, CASE WHEN proj.k % 14 = 0 THEN 'candidate' END AS feedback_status
FROM proj LEFT JOIN lg ON lg.k = proj.k LEFT JOIN op ON op.s = proj.k % 50""")
def case_status(spark, folder):
    t = case_tables(spark, folder)
    states = projected(t)
    lines = table(spark, folder, "lineitem")
    log = lines.select(F.col("l_orderkey").alias("case_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10 + F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("action_id"), F.struct(F.col("l_linestatus").alias("state")).alias("facts"))
    known = t["classification"].select("case_id")  # every case, without the projection
    behavior = known.select("case_id", F.lit(7).alias("repeat_count"), F.lit("high").alias("aggression_level"), F.lit(1.0).alias("aggression_score"), F.lit(2).alias("marker_count"), F.lit(True).alias("priority_mode"))
    ticket = known.select("case_id", C.ticket_reference(F.md5(F.col("case_id").cast("string"))).alias("ticket_reference"))
    feedback = known.where(F.col("case_id") % 14 == 0).join(t["validation"].select("case_id", "revision"), "case_id", "left").select(
        "case_id", F.coalesce("revision", F.lit(1).cast("bigint")).alias("source_case_revision"), F.lit("candidate").alias("status"))
    out = C.case_status(states, t["validation"], t["routes"], C.case_notices(t["validation"]), t["classification"], _assignments(t), behavior, ticket, log, feedback)
    return out.select("case_id", "revision", "state", "validation_status", "routing_status", F.array_join("applicant_notifications", ",").alias("notices"), "applicant_name", "unit_id", "staff_id",
                      "open_assignment_count", "repeat_count", "aggression_level", "ticket_reference", "action_count", "last_logged_state", "feedback_status")


@query("correspondence_views", f"""
WITH {_T} SELECT k AS case_id, rev AS case_revision, coalesce(gen, 'not_requested') AS generation_status, CASE WHEN gen IN ('failed', 'completed') THEN 'g' || k END AS generation_id, CASE WHEN gen = 'failed' THEN 'STRUCTURED_OUTPUT_INVALID' END AS error_code,
  CASE WHEN gen = 'completed' THEN res END AS result_status, CASE WHEN gen = 'completed' THEN 'Draft ' || k END AS draft_text,
  CASE WHEN routed THEN CASE WHEN k % 8 = 3 THEN 'applicant:completed,target_unit:queued' ELSE 'applicant:completed,target_unit:completed' END END AS notifications FROM t WHERE has_val""")
def correspondence_views(spark, folder):
    t = case_tables(spark, folder)
    drafts = C.correspondence_view(t["validation"], t["generations"].drop("case_id"))
    routing = C.routing_view(t["validation"], t["routes"], t["notifications"]).select(
        "case_id", F.array_join(F.transform("notifications", lambda n: F.concat_ws(":", n["audience"], n["generation_status"])), ",").alias("notifications"))
    return drafts.join(routing, "case_id").select("case_id", "case_revision", "generation_status", "generation_id", "error_code", "result_status", "draft_text", "notifications")


@query("document_views", """
SELECT o_orderkey AS case_id, 'd' || o_orderkey AS document_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Order ' || o_orderkey END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'citizen-portal' END AS channel, 'Order ' || o_orderpriority || ' ' || o_orderstatus AS text FROM orders""")
def document_views(spark, folder):
    return C.document_view(case_tables(spark, folder)["intake"]).select("case_id", "document_id", "title", "channel", "text")


@query("action_log_views", """
SELECT l_orderkey AS case_id, l_linenumber * 1000000 + l_partkey AS action_id, l_linestatus AS state, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 END AS case_revision, CASE WHEN l_returnflag = 'R' THEN 'F-01' ELSE '' END AS steps FROM lineitem WHERE l_returnflag <> 'A'""")
def action_log_views(spark, folder):
    lines = table(spark, folder, "lineitem")
    log = lines.select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("action_id"), F.when(F.col("l_returnflag") == "A", "note").otherwise("state_projected").alias("action_type"),
        F.lit("system").alias("actor"), F.col("l_shipdate").alias("occurred_at"),
        F.struct(F.col("l_linestatus").alias("state"), (F.col("l_linenumber") % 3).alias("revision"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("F-01"))).alias("completed_steps"), F.lit(None).cast("string").alias("last_error_code")).alias("facts"))
    return C.action_log_view(log).select("case_id", "action_id", "state", "case_revision", F.array_join("completed_steps", ",").alias("steps"))


_NOW = "TIMESTAMP '2001-08-02 12:00:00'"


@query("queue_measures", f"""
WITH {_T}, a AS (SELECT *, greatest(0, floor((epoch({_NOW}) - epoch(od)) / 60 + 0.5)) AS mins FROM t), h AS (SELECT *, floor(mins / 60 + 0.5) AS hrs FROM a)
SELECT k AS case_id, CASE WHEN mins < 1 THEN 'az önce' WHEN mins < 60 THEN CAST(mins AS BIGINT) || ' dk' WHEN hrs < 24 THEN CAST(hrs AS BIGINT) || ' sa' ELSE CAST(floor(hrs / 24 + 0.5) AS BIGINT) || ' gün' END AS age,
  CASE WHEN (k % 101) / 100 > 0.8 THEN 'high' WHEN (k % 101) / 100 >= 0.5 THEN 'mid' ELSE 'low' END AS tone, CASE WHEN has_val AND k % 11 <> 0 THEN 'C' ELSE '?' END AS initials,
  CASE WHEN k % 4 = 0 THEN 'Dilekçe ekranı' END AS channel_label, CASE WHEN k % 2 = 0 THEN 'Türkçe' ELSE 'İngilizce' END AS language_label FROM h""")
def queue_measures(spark, folder):
    out = Q.queue_measures(list_rows(case_tables(spark, folder)), F.lit("2001-08-02 12:00:00").cast("timestamp_ntz"))
    return out.select("case_id", "age", "tone", "initials", "channel_label", "language_label")


@query("detail_view", f"""
WITH {_T} SELECT k AS case_id, CASE WHEN k % 4 = 0 THEN 'Order ' || k WHEN k % 3 = 0 THEN 'Local ' || k ELSE 'Case detayı' END AS title, 'd' || k AS document_id, CASE WHEN k % 2 = 0 THEN 'tr' ELSE 'en' END AS language, 'Unit ' || nk AS unit_label,
  CASE WHEN k % 3 = 0 THEN 'v1' END AS classifier_version, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN 'Local text' END ELSE 'Order ' || op || ' ' || os END AS text, CASE WHEN k % 5 <> 0 THEN 'server' WHEN k % 3 = 0 THEN 'local' END AS text_origin FROM t""")
def detail_view(spark, folder):
    """Documents are missing for every fifth case, local records exist for every third."""
    t = case_tables(spark, folder)
    documents = C.document_view(t["intake"].where(F.col("case_id") % 5 != 0))
    local = t["intake"].where(F.col("case_id") % 3 == 0).select("case_id", F.concat(F.lit("Local "), F.col("case_id").cast("string")).alias("title"), F.lit("local-doc").alias("document_id"), F.lit("v1").alias("classifier_version"),
                                                                F.lit("Local text").alias("text"), F.lit("de").alias("language"))
    return Q.case_view(documents, list_rows(t), local).select("case_id", "title", "document_id", "language", "unit_label", "classifier_version", "text", "text_origin")


@query("explain_view", f"""
WITH {_T} SELECT k AS case_id, CASE WHEN NOT routed THEN 'Bekliyor' WHEN k % 4 = 2 THEN '%0' ELSE '%' || CAST(floor((k % 101) / 100 * 100 + 0.5) AS BIGINT) END AS routing_confidence,
  CASE WHEN routed THEN CASE WHEN k % 3 = 0 THEN 'elevated' ELSE 'normal' END ELSE 'high' END AS behavior_level,
  CASE WHEN routed THEN CASE WHEN k % 3 = 0 THEN 'Yükseltilmiş dil sinyali algılandı; atama uzman çözüm oranına göre desteklendi.' WHEN k % 5 >= 3 THEN (k % 5) || '. aynı konu sinyali algılandı; konu deneyimi yüksek personele öncelik verildi.'
    ELSE 'Agresiflik sinyali normal düzeyde; atama açık dosya yüküne göre yapıldı.' END ELSE 'Yüksek dil sinyali algılandı; atama uzman çözüm oranına göre önceliklendirildi.' END AS behavior_detail,
  CASE WHEN NOT routed THEN 'Aktif personel bulunamadı' ELSE 'Operatör · ' || (k % 4) || ' açık dosya · ' || CASE WHEN k % 2 = 0 THEN 'konu çözüm oranı %25' ELSE 'açık dosya yükü dengesi' END
    || CASE WHEN k % 5 >= 3 THEN ' · ' || (k % 5) || '. aynı konu' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' · agresiflik: elevated (%35)' ELSE '' END END AS assignment_detail FROM t""")
def explain_view(spark, folder):
    t = case_tables(spark, folder)
    routes, owners = t["routes"].select("case_id", "routing_status", "route_kind", "target_unit_label"), _assignments(t)
    joined = t["classification"].select("case_id", "confidence").join(routes, "case_id", "left").join(owners.select("case_id", "assignment_status", "selection_reason"), "case_id", "left")
    case = F.col("case_id")
    facts = joined.select(
        "*", F.lit("Staff").alias("display_name"), F.lit("operator").alias("role"), (case % 4).alias("open_assignment_count"), F.when(case % 2 == 0, "topic_resolution_rate").otherwise("least_open_assignments").alias("policy"),
        F.lit(0.25).alias("staff_topic_resolution_rate"), F.col("selection_reason.aggression_score").alias("reason_score"), F.col("selection_reason.aggression_level").alias("reason_level"),
        F.col("selection_reason.repeat_count").alias("reason_repeat"), F.lit(1.0).alias("signal_score"), F.lit("high").alias("signal_level"), F.lit(7).alias("signal_repeat"))
    return Q.explain_cases(facts).select("case_id", "routing_confidence", "behavior_level", "behavior_detail", "assignment_detail")


@query("case_trace", f"""
WITH {_T} SELECT 'd' || k AS document_id, state, 't' || (k % 3) AS request_type_id, round((k % 101) / 100, 6) AS confidence, comp AS completion_status, gen AS generation_status, CASE WHEN drafted THEN k % 3 ELSE 0 END AS citations,
  CASE WHEN routed THEN 'Unit ' || (k % 5) END AS target_unit_label, CASE WHEN routed THEN CASE WHEN k % 8 = 3 THEN 1 ELSE 2 END ELSE 0 END AS notifications_done FROM proj""")
def case_trace(spark, folder):
    """Each document from intake to notification, with its latest draft only."""
    t = case_tables(spark, folder)
    older = t["generations"].withColumn("created_at", F.when(F.col("case_id") % 2 == 0, F.col("created_at") - F.expr("INTERVAL 1 DAY"))).withColumn("generation_status", F.lit("queued"))
    out = C.case_trace(t["intake"], projected(t), t["classification"], t["validation"], t["generations"].unionByName(older), t["routes"], t["notifications"])
    return out.select("document_id", "state", "request_type_id", F.round("confidence", 6).alias("confidence"), "completion_status", "generation_status", "citations", "target_unit_label", "notifications_done")


# --- reference tables derived from the data ---------------------------------

def part_taxonomy(spark, folder):
    """Regions, nations and part types as a taxonomy with planted faults."""
    regions, nations, parts = (table(spark, folder, n) for n in ("region", "nation", "part"))
    departments = regions.select(F.col("r_name").alias("department_id"), F.when(F.col("r_regionkey") == 2, "").otherwise(F.initcap("r_name")).alias("department_label"), F.lit(True).alias("active"))
    units = nations.select(F.col("n_name").alias("unit_id"), F.col("n_name").alias("unit_label"), F.when(F.col("n_nationkey") == 5, "NOWHERE").otherwise(F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), F.col("n_regionkey") + 1)).alias("department_id"), F.lit(True).alias("active"))
    types = parts.select(F.col("p_partkey").alias("type_ord"), F.col("p_partkey").cast("string").alias("request_type_id"), F.col("p_type").alias("request_type_label"), F.concat(F.lit("NATION_"), (F.col("p_partkey") % 26).cast("string")).alias("unit_id"), F.lit("v").alias("taxonomy_version"))
    keywords = parts.where(F.col("p_size") > 1).select(F.col("p_partkey").cast("string").alias("request_type_id"), F.lit("en").alias("language"), F.posexplode(F.split(F.concat_ws(" ", "p_name", F.lower("p_brand"), F.split("p_name", " ")[F.when(F.col("p_size") == 7, 0).otherwise(1)]), " ")).alias("keyword_ord", "keyword"))
    return {"departments": departments, "units": units, "request_types": types, "keywords": keywords}


@query("taxonomy_check", """
WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS id, unnest(string_split(p_name || ' ' || lower(p_brand) || ' ' || string_split(p_name, ' ')[CASE WHEN p_size = 7 THEN 1 ELSE 2 END], ' ')) AS word FROM part WHERE p_size > 1)
SELECT 'department_label_required' AS rule, r_name AS id FROM region WHERE r_regionkey = 2
UNION ALL SELECT 'unit_department_reference', n_name FROM nation WHERE n_nationkey = 5
UNION ALL SELECT 'unit_department_reference', n_name FROM nation JOIN (VALUES (0, 'AFRICA'), (1, 'AMERICA'), (2, 'ASIA'), (3, 'EUROPE'), (4, 'MIDDLE EAST')) v(rk, nm) ON rk = n_regionkey WHERE n_nationkey <> 5 AND nm NOT IN (SELECT r_name FROM region)
UNION ALL SELECT 'request_type_unit_reference', CAST(p_partkey AS VARCHAR) FROM part WHERE 'NATION_' || (p_partkey % 26) NOT IN (SELECT n_name FROM nation)
UNION ALL SELECT 'request_type_keywords_required', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 1
UNION ALL SELECT 'keyword_unique', id || '/en/' || word FROM w GROUP BY id, word HAVING count(*) > 1""")
def taxonomy_check(spark, folder):
    return loaders.taxonomy_violations(part_taxonomy(spark, folder))


@query("taxonomy_flatten", """
SELECT CAST(p_partkey AS VARCHAR) AS request_type_id, 'en' AS language, x.g AS group_ord, CASE WHEN p_size % 2 = 0 AND x.g = 0 THEN p_brand ELSE string_split(p_name, ' ')[x.g + 1] END AS form
FROM part CROSS JOIN (VALUES (0), (1)) x(g) WHERE p_size % 3 <> 0 UNION ALL
SELECT CAST(p_partkey AS VARCHAR), 'tr', x.g, string_split(p_name, ' ')[x.g + 1] FROM part CROSS JOIN (VALUES (0), (1)) x(g) WHERE p_size % 3 = 0""")
def taxonomy_flatten(spark, folder):
    """One taxonomy document per part: keyword lists, keyword maps and concept groups."""
    parts = table(spark, folder, "part")
    words = F.split("p_name", " ")
    plain = F.to_json(words)
    mapped = F.to_json(F.create_map(F.lit("en"), words))
    # A group is a list of forms or a single form.
    groups = F.concat(F.lit('{"en":[["'), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(words[0]), F.lit('"],"'), words[1], F.lit('"]}'))
    entry = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("label"), F.lit("u").alias("unitId"),
                     F.when(F.col("p_size") % 3 == 0, plain).otherwise(mapped).alias("keywords"), F.when(F.col("p_size") % 3 != 0, groups).alias("signals"))
    node = F.array().cast("array<struct<id string, label string, active boolean>>".replace(" string", ":string").replace(" boolean", ":boolean"))
    docs = parts.select(F.lit("v").alias("taxonomyVersion"), node.alias("departments"),
                        F.array().cast("array<struct<id:string,label:string,active:boolean,departmentId:string>>").alias("units"), F.array(entry).alias("requestTypes"))
    return loaders.flatten_taxonomy(docs)["signals"].where("form_ord = 0").select("request_type_id", "language", "group_ord", "form")


@query("registry_check", """
SELECT 'too_many_fields' AS rule, 'o' || l_orderkey AS id FROM lineitem GROUP BY l_orderkey HAVING count(*) > 8
UNION ALL SELECT 'field_id_unique', 'o' || l_orderkey || '/f' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'field_label_required', 'o' || l_orderkey || '/f' || l_linenumber FROM lineitem WHERE l_partkey % 100 = 0
UNION ALL SELECT 'field_kind_known', 'o' || l_orderkey || '/f' || l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 50 = 1
UNION ALL SELECT 'request_type_count', CAST(count(DISTINCT l_orderkey) AS VARCHAR) FROM lineitem""")
def registry_check(spark, folder):
    """Line items read as field definitions of their order, serialised and flattened again."""
    lines = table(spark, folder, "lineitem")
    entry = F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_partkey") % 100 == 0, "").otherwise("Label").alias("label"),
                     F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 50 == 1), "colour").otherwise("free-text").alias("kind"), F.lit(True).alias("required"))
    docs = lines.groupBy("l_orderkey").agg(F.collect_list(entry).alias("fields")).select(
        F.lit(fixed.FIELD_SCHEMA_VERSION).alias("schemaVersion"), F.to_json(F.create_map(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), "fields")).alias("schemas"))
    return loaders.registry_violations(loaders.flatten_registry(docs))


@query("corpus_chunks", r"""
SELECT doc_id, 'S' || doc_id || '-chunk-' || lpad(CAST(n AS VARCHAR), 3, '0') AS chunk_id, 'Line ' || n AS locator, line[1:500] AS excerpt, md5('Source ' || source || ' Line ' || n || '. ' || line) AS content_digest
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""")
def corpus_chunks(spark, folder):
    """Documents as sources, lines as articles: chunks built, nested and flattened again."""
    docs = table(spark, folder, "documents", spread="doc_id")
    items = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(F.concat(F.lit("Line "), (i + 1).cast("string")).alias("locator"), line.alias("text")))
    articles = docs.select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("Source "), "source").alias("title"), items.alias("items"))
    chunks = loaders.build_chunks(articles)
    return chunks.select(F.substring("source_id", 2, 20).cast("bigint").alias("doc_id"), "chunk_id", "locator", "excerpt", F.md5("content").alias("content_digest"))


@query("corpus_flatten", r"""
SELECT 'S' || doc_id AS source_id, source AS title, 'law' AS source_type, 'v2' AS corpus_version, x.n AS chunk_id, md5(CASE x.n WHEN 'c1' THEN text[1:50] ELSE text END) AS content_digest FROM documents CROSS JOIN (VALUES ('c1'), ('c2')) x(n)""")
def corpus_flatten(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id")
    chunk = lambda n, text: F.struct(F.lit(n).alias("chunk_id"), F.lit("").alias("locator"), F.lit("").alias("excerpt"), text.alias("content"))
    source = F.struct(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("source_id"), F.col("source").alias("title"), F.lit("law").alias("source_type"), F.lit(None).cast("string").alias("official_source_url"),
                      F.array(chunk("c1", F.substring("text", 1, 50)), chunk("c2", F.col("text"))).alias("chunks"))
    text = docs.select(F.from_json(F.to_json(F.struct(F.lit("v2").alias("corpus_version"), F.array(source).alias("sources"))), loaders.CORPUS_SCHEMA).alias("d"))
    return loaders.flatten_corpus(text.select("d.*")).select("source_id", "title", "source_type", "corpus_version", "chunk_id", F.md5("content").alias("content_digest"))


@query("staff_registry", """
SELECT n_name || '-operator-' || x.n AS staff_id, 'Unit ' || n_nationkey || ' Operatörü ' || x.n AS display_name, CASE x.n WHEN 1 THEN 'operator' ELSE 'moderator' END AS role, n_name AS unit_id FROM nation CROSS JOIN (VALUES (1), (2)) x(n)""")
def staff_registry(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_name").alias("unit_id"), F.concat(F.lit("Unit "), F.col("n_nationkey").cast("string")).alias("unit_name"))
    return loaders.staff_registry(nations).select("staff_id", "display_name", "role", "unit_id")


@query("seed_cases", f"""
WITH c AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'completed' WHEN c_custkey % 4 = 1 THEN 'waiting_for_user' ELSE 'needs_review' END AS state, c_custkey % 5 = 4 AS manual, CASE c_custkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'normal' END AS prio,
  md5('sample-case-' || 's' || c_custkey) AS h, c_custkey % 3 + 1 AS rep FROM customer)
SELECT k, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS case_id, state, CASE prio WHEN 'critical' THEN 100 WHEN 'high' THEN 70 ELSE 40 END AS priority_score, 'CA-' || upper(h[1:8]) AS ticket,
  CASE WHEN manual THEN 'needs_review' ELSE 'classified' END AS class_status, {_NOW} - to_days(CAST(k % 20 AS INTEGER)) AS created_at, CASE WHEN state = 'completed' THEN 'complete' WHEN state = 'waiting_for_user' THEN 'missing_information' END AS completion_status,
  CASE WHEN state = 'completed' THEN CASE WHEN rep >= 3 THEN 'topic_resolution_rate' ELSE 'least_open_workload' END END AS policy, CASE WHEN state = 'completed' THEN 2 ELSE 0 END AS notices FROM c""")
def seed_cases(spark, folder):
    """One fixture row per customer, expanded to all case tables and joined back."""
    c = F.col("c_custkey")
    fixture = table(spark, folder, "customer").select(
        F.concat(F.lit("s"), c.cast("string")).alias("slug"), F.col("c_name").alias("name"), F.when(c % 5 == 4, "manual").otherwise("gurultu-sikayeti").alias("type"), F.lit("Label").alias("label"),
        F.lit("zabita").alias("department"), F.lit("Dep").alias("department_label"), F.lit("denetim").alias("unit"), F.lit("Unit").alias("unit_label"), F.lit("Text").alias("text"),
        F.when(c % 4 == 0, "completed").when(c % 4 == 1, "waiting_for_user").otherwise("needs_review").alias("state"), F.when(c % 3 == 0, "critical").when(c % 3 == 1, "high").otherwise("normal").alias("priority"),
        (c % 20).cast("int").alias("age"), F.lit("normal").alias("aggression"), (c % 3 + 1).cast("int").alias("repeat"))
    t = seeds.seed_cases(fixture, F.lit("2001-08-02 12:00:00").cast("timestamp_ntz"), "sample")
    notices = t["notification"].groupBy("case_id").agg(F.count("*").alias("notices"))
    joined = (t["case_state"].select("case_id", "state", "priority_score").join(t["ticket"].select("case_id", F.col("ticket_reference").alias("ticket")), "case_id")
              .join(t["classification"].select("case_id", F.col("status").alias("class_status")), "case_id").join(t["intake"].select("case_id", "created_at", "correlation_id"), "case_id")
              .join(t["validation"].select("case_id", "completion_status"), "case_id", "left").join(t["assignment"].select("case_id", "policy"), "case_id", "left").join(notices, "case_id", "left"))
    return joined.select(F.substring("correlation_id", 2, 20).cast("bigint").alias("k"), "case_id", "state", "priority_score", "ticket", "class_status", "created_at", "completion_status", "policy",
                         F.coalesce("notices", F.lit(0)).alias("notices"))


@query("contract_quarantine", """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'Invalid JSON' WHEN event_id % 13 = 0 THEN 'Invalid request fields' WHEN event_id % 11 = 0 THEN 'schemaVersion must be 2.0' WHEN event_id % 7 = 0 THEN 'documentId must be a non-empty string'
  WHEN event_type = 'error' THEN 'sourceType must be text or ocr' WHEN event_id % 5 = 0 THEN 'text must be a string' WHEN event_id % 3 = 0 THEN 'sourceMetadata must be an object' WHEN event_id % 4 = 1 THEN 'correlationId must be a string or null' END AS error FROM events""")
def contract_quarantine(spark, folder):
    """Events wrapped as intake payloads with one planted fault each."""
    e = F.col("event_id")
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    body = F.concat_ws(
        ",", part("schemaVersion", F.when(e % 11 == 0, '"1.0"').otherwise('"2.0"')), part("requestId", text(e.cast("string"))), part("documentId", F.when(e % 7 == 0, '""').otherwise(text(e.cast("string")))),
        part("sourceType", F.when(F.col("event_type") == "error", '"fax"').when(F.col("event_type") == "view", '"ocr"').otherwise('"text"')), part("text", F.when(e % 5 == 0, e.cast("string")).otherwise('"hello"')),
        part("sourceMetadata", F.when(e % 3 == 0, "[1]").otherwise(F.col("props"))), part("correlationId", F.when(e % 4 == 1, "7").when(e % 4 == 2, "null").otherwise('"c"')), F.when(e % 13 == 0, '"extra":1'))
    payload = F.when(e % 17 == 0, F.concat(F.lit("{"), body)).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    rows = table(spark, folder, "events").select("event_id", payload.alias("payload"))
    good, bad = contracts.conform(rows, contracts.DOCUMENT_INPUT)
    return good.select("event_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("event_id", "error"))


_ORDER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["orderId", "lines"],
    "properties": {
        "orderId": {"type": "integer", "minimum": 1}, "status": {"enum": ["O", "F", "P"]}, "total": {"type": "number", "exclusiveMaximum": 490000},
        "lines": {"type": "array", "minItems": 1, "maxItems": 8, "items": {"$ref": "#/$defs/line"}}},
    "$defs": {"line": {
        "type": "object", "additionalProperties": False, "required": ["number", "flag"],
        "properties": {"number": {"type": "integer"}, "quantity": {"type": "number", "maximum": 49}, "flag": {"type": "string", "minLength": 1, "maxLength": 1},
                       "ship": {"type": "object", "required": ["year"], "properties": {"year": {"type": "string", "pattern": "^(199|2000)"}}}}}}}


@query("nested_contracts", """
WITH raw AS (SELECT l_orderkey AS k, l_linenumber, l_quantity, CASE WHEN l_suppkey % 50 = 0 THEN NULL WHEN l_partkey % 40 = 0 THEN '' ELSE l_returnflag END AS flag, CAST(year(l_shipdate) AS VARCHAR) AS y, CASE WHEN l_partkey % 97 = 0 THEN 'n' END AS note FROM lineitem),
l AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_quantity, flag NULLS FIRST, y, note NULLS FIRST) - 1 AS i,
  CASE WHEN flag IS NULL THEN '.flag' WHEN note IS NOT NULL THEN '' WHEN l_quantity > 49 THEN '.quantity' WHEN flag = '' THEN '.flag' WHEN y > '2000' THEN '.ship.year' END AS fault FROM raw),
g AS (SELECT k, count(*) AS n, arg_min('$.lines[' || i || ']' || fault, i) FILTER (WHERE fault IS NOT NULL) AS path FROM l GROUP BY k)
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 37 = 0 THEN 'Invalid JSON' WHEN n IS NULL THEN '$.lines' WHEN o_orderkey % 31 = 0 THEN '$' WHEN o_orderkey % 29 = 0 THEN '$.status'
  WHEN o_totalprice >= 490000 THEN '$.total' WHEN n > 8 THEN '$.lines' ELSE path END AS error FROM orders LEFT JOIN g ON k = o_orderkey""")
def nested_contracts(spark, folder):
    """Orders with their lines as one nested payload; faults at every depth."""
    c = F.col
    flag = F.when(c("l_suppkey") % 50 == 0, F.lit(None)).when(c("l_partkey") % 40 == 0, "").otherwise(c("l_returnflag"))
    line = F.struct(c("l_linenumber").alias("number"), c("l_quantity").alias("quantity"), flag.alias("flag"), F.struct(F.year("l_shipdate").cast("string").alias("year")).alias("ship"),
                    F.when(c("l_partkey") % 97 == 0, "n").alias("note"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    joined = table(spark, folder, "orders", spread="o_orderkey").join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    key = c("o_orderkey")
    body = F.to_json(F.struct(key.alias("orderId"), F.when(key % 29 == 0, "X").otherwise(c("o_orderstatus")).alias("status"), c("o_totalprice").alias("total"), "lines",
                              F.when(key % 31 == 0, 1).alias("extra")), {"ignoreNullFields": "true"})
    payloads = joined.select(key.alias("case_id"), F.when(key % 37 == 0, F.concat(body, F.lit("}"))).otherwise(body).alias("payload"))
    return contracts.with_schema_error(payloads, _ORDER_SCHEMA).select("case_id", "error")


@query("integrity_check", f"""
SELECT 'confidence_range' AS rule, 'd' || o_orderkey AS id FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT 'classified_needs_score', 'd' || o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 101) / 100 <= 0.80 AND o_totalprice <= 400000
UNION ALL SELECT 'chain_all_or_none', 'd' || o_orderkey FROM orders WHERE o_orderkey % 23 = 0
UNION ALL SELECT 'ticket_format', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 29 = 0
UNION ALL SELECT 'priority_score_known', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def integrity_check(spark, folder):
    orders = table(spark, folder, "orders")
    o = F.col("o_orderkey")
    chain = [F.lit("x").alias(c) for c in ("department_label", "unit_id", "unit_label", "request_type_id", "request_type_label")]
    classification = orders.select(F.concat(F.lit("d"), o.cast("string")).alias("document_id"), F.when(F.col("o_orderstatus") == "F", "classified").otherwise("needs_review").alias("status"),
                                   F.lit("x").alias("department_id"), *chain[:4], F.when(o % 23 != 0, "x").alias("request_type_label"),
                                   F.when(F.col("o_totalprice") > 400000, 2.0).otherwise((o % 101) / 100).alias("confidence"))
    ticket = C.ticket_reference(F.md5(o.cast("string")))
    ticket_rows = orders.select(o.alias("case_id"), F.when(o % 29 == 0, F.lower(ticket)).otherwise(ticket).alias("ticket_reference"))
    score = F.when(F.col("o_orderpriority") == "1-URGENT", 100).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 55).otherwise(40)
    return contracts.integrity_violations(classification, ticket_rows, orders.select(o.alias("case_id"), score.alias("priority_score")))


@query("chain_lookup", f"""
WITH {values("chain", "rt, rl, unit_id, unit_label, department_id, department_label", B.CHAIN)}, d AS (SELECT doc_id, CASE doc_id % 5 {' '.join(f"WHEN {n} THEN '{t[0]}'" for n, t in enumerate(B.TYPES))} ELSE 'unknown' END AS rt FROM documents)
SELECT doc_id, d.rt AS request_type_id, rl AS request_type_label, unit_label, department_label FROM d LEFT JOIN chain ON chain.rt = d.rt""")
def chain_lookup(spark, folder):
    doc = F.col("doc_id")
    kind = F.lit("unknown")
    for n, t in enumerate(B.TYPES):
        kind = F.when(doc % 5 == n, t[0]).otherwise(kind)
    docs = table(spark, folder, "documents").select(doc, kind.alias("request_type_id"))
    return loaders.attach_chain(docs, B.sample_taxonomy(spark)).select("doc_id", "request_type_id", "request_type_label", "unit_label", "department_label")


# --- evaluation -------------------------------------------------------------

@query("scenario_compare", f"""
WITH {_T} SELECT k AS case_id, CASE WHEN k % 10 = 9 THEN 'missing' WHEN k % 6 = 0 OR k % 4 = 1 THEN 'fail' ELSE 'pass' END AS verdict,
  CASE WHEN k % 10 = 9 THEN '' ELSE concat_ws(',', CASE WHEN k % 6 = 0 THEN 'completion_status' END, CASE WHEN k % 4 = 1 THEN 'revision' END) END AS failed FROM t""")
def scenario_compare(spark, folder):
    """Validation rows against an expectation table that also knows the absent cases."""
    t = case_tables(spark, folder)
    c = F.col("case_id")
    golden = t["intake"].select("case_id").join(t["validation"].select("case_id", "completion_status", "revision"), "case_id", "left").select(
        "case_id", F.when(c % 6 == 0, "other").otherwise(F.col("completion_status")).alias("completion_status"), F.when(c % 4 == 1, 99).otherwise(F.col("revision")).alias("revision"))
    out = E.compare_expected(t["validation"].select("case_id", "completion_status", "revision"), golden, ["case_id"], ["completion_status", "revision"])
    return out.select("case_id", "verdict", F.array_join("failed_columns", ",").alias("failed"))


@query("classification_metrics", f"""
WITH {B.SQL_NORMAL}, {values("kw", "rt, lang, n, w", B.KEYWORDS)}, {values("chain", "rt, rl, unit_id, unit_label, department_id, department_label", B.CHAIN)},
f AS (SELECT doc_id, {B.SQL_FOLD.format('t')} AS f FROM gated),
cov AS (SELECT f.doc_id, kw.rt, kw.lang, round_even(sum(CASE WHEN contains(f.f, kw.w) THEN 1 ELSE 0 END) / count(*), 3) AS s FROM f CROSS JOIN kw GROUP BY 1, 2, 3),
win AS (SELECT doc_id, CASE WHEN s > 0 THEN rt END AS rt, s FROM cov QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, rt, lang DESC) = 1),
g AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'billing' WHEN 'de' THEN 'street-works' WHEN 'fr' THEN 'permits' ELSE 'archive' END AS rt FROM documents),
j AS (SELECT g.doc_id, coalesce(w.department_id = c.department_id, FALSE) AS d, coalesce(w.unit_id = c.unit_id, FALSE) AS u, coalesce(win.rt = g.rt, FALSE) AS r, coalesce(win.s, 0) AS s
  FROM g JOIN chain c ON c.rt = g.rt LEFT JOIN win ON win.doc_id = g.doc_id LEFT JOIN chain w ON w.rt = win.rt)
SELECT count(*) AS documents, round(avg(CAST(d AS INTEGER)), 6) AS department_accuracy, round(avg(CAST(d AND u AS INTEGER)), 6) AS unit_accuracy, round(avg(CAST(r AS INTEGER)), 6) AS request_type_accuracy,
  round(avg(CAST(d AND u AND r AS INTEGER)), 6) AS exact_chain, round(avg(CASE WHEN s > 0.80 THEN 0 ELSE 1 END), 6) AS abstain_rate FROM j""")
def classification_metrics(spark, folder):
    """Keyword model against a gold type per document language."""
    tax = B.sample_taxonomy(spark)
    predicted = CL.classify_keyword(B.accepted_documents(spark, folder), tax, is_nfc=True).select(F.col("doc_id").alias("document_id"), "status", "department_id", "unit_id", "request_type_id")
    kind = F.when(F.col("lang") == "en", "billing").when(F.col("lang") == "de", "street-works").when(F.col("lang") == "fr", "permits").otherwise("archive")
    gold = loaders.attach_chain(table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), kind.alias("request_type_id")), tax)
    out = E.classification_metrics(predicted, gold)
    return out.select("documents", *[F.round(c, 6).alias(c) for c in ("department_accuracy", "unit_accuracy", "request_type_accuracy", "exact_chain", "abstain_rate")])


@query("extraction_metrics", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS cust FROM orders),
f AS (SELECT k, 'name' AS id, CASE WHEN k % 7 <> 0 THEN 'C' || cust END AS p, CASE WHEN k % 3 <> 0 THEN 'C' || cust WHEN k % 9 = 0 THEN 'D' END AS g FROM o UNION ALL SELECT k, 'phone', CASE WHEN k % 4 = 0 THEN '5' || cust END, CASE WHEN k % 2 = 0 THEN '5' || cust END FROM o)
SELECT count(*) FILTER (WHERE p = g) AS field_hits, round(count(*) FILTER (WHERE p = g) / count(p), 6) AS field_precision, round(count(*) FILTER (WHERE p = g) / count(g), 6) AS field_recall,
  round(count(*) FILTER (WHERE p IS NULL AND g IS NULL) / count(*) FILTER (WHERE p IS NULL), 6) AS missing_precision, round(count(*) FILTER (WHERE p IS NULL AND g IS NULL) / count(*) FILTER (WHERE g IS NULL), 6) AS missing_recall FROM f""")
def extraction_metrics(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("cust"))
    name, phone = F.concat(F.lit("C"), "cust"), F.concat(F.lit("5"), "cust")

    def fields(name_value, phone_value):
        rows = orders.select(k().alias("document_id"), F.explode(F.array(F.struct(F.lit("name").alias("field_id"), name_value.alias("value")), F.struct(F.lit("phone").alias("field_id"), phone_value.alias("value")))).alias("f"))
        return rows.select("document_id", "f.field_id", "f.value", F.col("f.value").isNull().alias("is_missing"))

    predicted = fields(F.when(k() % 7 != 0, name), F.when(k() % 4 == 0, phone))
    gold = fields(F.when(k() % 3 != 0, name).when(k() % 9 == 0, "D"), F.when(k() % 2 == 0, phone))
    out = E.extraction_metrics(predicted, gold)
    return out.select("field_hits", *[F.round(c, 6).alias(c) for c in ("field_precision", "field_recall", "missing_precision", "missing_recall")])
