"""Queries over routing, applicants, staff and unfinished work.

Orders are cases, nations are units, regions departments, suppliers staff and
line items assignments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import routing as R, staffing as S
from docketry.plans.registry import query
from docketry.sources.loaders import table


def K():
    """The case key column."""
    return F.col("k")


def nation_taxonomy(spark, folder):
    """region -> department, nation -> unit; some of both are inactive."""
    regions, nations = table(spark, folder, "region"), table(spark, folder, "nation")
    departments = regions.select(F.col("r_name").alias("department_id"), F.initcap("r_name").alias("department_label"), (F.col("r_regionkey") != 4).alias("active"))
    units = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("unit_id"), F.concat(F.lit("Unit "), F.col("n_nationkey").cast("string")).alias("unit_label"), F.col("r_name").alias("department_id"),
        (F.col("n_nationkey") % 7 != 3).alias("active"))
    return {"departments": departments, "units": units}


def order_cases(spark, folder):
    """Orders with their customer's unit; every fiftieth names a foreign department."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "k", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "c_name", F.col("n_name").alias("unit_id"), F.when(K() % 50 == 0, "EUROPE").otherwise(F.col("r_name")).alias("department_id"),
        F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("classified").alias("classification_status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "missing_information").otherwise("complete").alias("completion_status"),
        F.when(K() % 4 == 0, "draft_ready").when(K() % 4 == 1, "review_required").when(K() % 4 == 2, "not_requested").alias("result_status"))


_FALLBACK = ("AFRICA", "NATION_0")
_CASES = """cases AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, c_name, n_name AS unit_id, CASE WHEN o_orderkey % 50 = 0 THEN 'EUROPE' ELSE r_name END AS department_id,
  CASE WHEN o_orderstatus = 'P' THEN 'needs_review' ELSE 'classified' END AS cs, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing_information' ELSE 'complete' END AS comp,
  CASE o_orderkey % 4 WHEN 0 THEN 'draft_ready' WHEN 1 THEN 'review_required' WHEN 2 THEN 'not_requested' END AS res
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
units AS (SELECT n_name AS unit_id, r_name AS dep, n_nationkey % 7 <> 3 AS ua, r_regionkey <> 4 AS da, 'Unit ' || n_nationkey AS unit_label FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_REJECT = """CASE WHEN cs <> 'classified' THEN 'CLASSIFICATION_NOT_ROUTEABLE' WHEN comp <> 'complete' THEN 'CASE_NOT_COMPLETE' WHEN res IS NULL THEN 'CORRESPONDENCE_NOT_ROUTEABLE'
  WHEN u.unit_id IS NULL OR u.dep <> td THEN 'ROUTING_TARGET_INVALID' WHEN NOT (u.ua AND u.da) THEN 'ROUTING_TARGET_INACTIVE' END"""


@query("route_select", f"""
WITH {_CASES}, aim AS (SELECT *, CASE WHEN res = 'draft_ready' THEN department_id WHEN res IS NOT NULL THEN 'AFRICA' END AS td, CASE WHEN res = 'draft_ready' THEN cases.unit_id WHEN res IS NOT NULL THEN 'NATION_0' END AS tu FROM cases),
j AS (SELECT aim.k, aim.res, td, tu, u.unit_label, {_REJECT} AS code FROM aim LEFT JOIN units u ON u.unit_id = tu)
SELECT k AS case_id, code AS rejection_code, CASE WHEN code IS NULL THEN CASE WHEN res = 'draft_ready' THEN 'classified' ELSE 'fallback' END END AS route_kind,
  CASE WHEN code IS NULL THEN td END AS target_department_id, CASE WHEN code IS NULL THEN tu END AS target_unit_id, CASE WHEN code IS NULL THEN unit_label END AS target_unit_label FROM j""")
def route_select(spark, folder):
    out = R.select_routes(order_cases(spark, folder), nation_taxonomy(spark, folder), _FALLBACK)
    return out.select(K().alias("case_id"), "rejection_code", "route_kind", "target_department_id", "target_unit_id", "target_unit_label")


@query("routes_created", f"""
WITH {_CASES},
jobs AS (SELECT *, 1 + k % 2 AS rev, CASE WHEN k % 5 = 0 THEN 3 ELSE 1 + k % 2 END AS now, k % 3 <> 2 AS requested, k % 3 = 0 AS done, CASE WHEN k % 3 <> 2 THEN CASE WHEN k % 2 = 0 THEN 'draft_ready' ELSE 'review_required' END ELSE 'not_requested' END AS res2 FROM cases WHERE k % 8 <> 0),
aim AS (SELECT * EXCLUDE (res), res2 AS res, CASE WHEN res2 = 'draft_ready' THEN department_id ELSE 'AFRICA' END AS td, CASE WHEN res2 = 'draft_ready' THEN jobs.unit_id ELSE 'NATION_0' END AS tu FROM jobs),
j AS (SELECT aim.k, rev, res, tu, CASE WHEN now <> rev THEN 'CASE_REVISION_CONFLICT' WHEN requested AND NOT done THEN 'CORRESPONDENCE_NOT_ROUTEABLE' ELSE {_REJECT} END AS code FROM aim LEFT JOIN units u ON u.unit_id = tu)
SELECT k AS case_id, rev AS source_case_revision, code AS rejection_code, CASE WHEN code IS NULL THEN 'routed' END AS routing_status, CASE WHEN code IS NULL THEN tu END AS target_unit_id,
  CASE WHEN code IS NULL THEN 2 ELSE 0 END AS notices FROM j""")
def routes_created(spark, folder):
    """Routing jobs with duplicates and stale revisions; earlier routes exist already."""
    cases = order_cases(spark, folder)
    rev = (1 + K() % 2).alias("source_case_revision")
    jobs = cases.select(K().alias("case_id"), rev, F.when(K() % 3 != 2, F.concat(F.lit("g"), K().cast("string"))).alias("source_generation_id"))
    jobs = jobs.unionByName(jobs.where(F.col("case_id") % 9 == 0))
    state = cases.select(K().alias("case_id"), F.when(K() % 5 == 0, 3).otherwise(1 + K() % 2).alias("revision"), "completion_status", F.lit("t1").alias("request_type_id"))
    classification = cases.select(K().alias("case_id"), F.col("classification_status").alias("status"), "department_id", "unit_id")
    generations = cases.select(F.concat(F.lit("g"), K().cast("string")).alias("generation_id"), F.when(K() % 3 == 0, "completed").otherwise("processing").alias("generation_status"),
                               F.when(K() % 2 == 0, "draft_ready").otherwise("review_required").alias("result_status"), F.lit("relevant_source_found").alias("source_status"))
    existing = cases.where(K() % 8 == 0).select(K().alias("case_id"), rev)
    routes, queued = R.create_routes(jobs, state, classification, generations, nation_taxonomy(spark, folder), existing, _FALLBACK)
    notices = queued.groupBy("case_id").agg(F.count("*").alias("notices"))
    return routes.join(notices, "case_id", "left").select("case_id", "source_case_revision", "rejection_code", "routing_status", "target_unit_id", F.coalesce("notices", F.lit(0)).alias("notices"))


@query("repeat_applicants", r"""
WITH c AS (SELECT o_orderkey AS k, o_orderpriority AS topic, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'straße cust ' || (o_custkey // 3) END AS who FROM orders)
SELECT k AS case_id, replace(who, 'ß', 'ss') AS identity, CASE WHEN who = '' THEN 0 ELSE count(*) OVER (PARTITION BY who, topic) END AS repeat_count FROM c""")
def repeat_applicants(spark, folder):
    """Names differ in case, spacing and the field that carries them."""
    orders = table(spark, folder, "orders", spread="o_orderkey").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("topic"), F.floor(F.col("o_custkey") / 3).cast("string").alias("c"))
    name = F.when(K() % 2 == 0, F.concat(F.lit("  Straße\tCUST "), "c")).otherwise(F.concat(F.lit("STRASSE  cust  "), "c", F.lit(" ")))
    field = F.when(K() % 3 == 0, "business-name").otherwise("applicant-name")
    value = F.when(K() % 13 == 0, " ").otherwise(name)
    fields = F.map_from_arrays(F.array(field), F.array(F.struct(value.alias("value"), F.lit(0.8).alias("confidence"))))
    cases = orders.select(K().alias("case_id"), "topic", R.identity_key(fields).alias("identity"))
    return R.repeat_counts(cases).select("case_id", "identity", "repeat_count")


def _staff(spark, folder):
    suppliers = table(spark, folder, "supplier").join(F.broadcast(table(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(F.col("s_suppkey").cast("string").alias("staff_id"), F.col("s_name").alias("display_name"),
                            F.when(F.col("s_suppkey") % 2 == 0, "operator").otherwise("moderator").alias("role"), F.col("n_name").alias("unit_id"), (F.col("s_acctbal") > 0).alias("active"))


def _assignments(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("staff_id"), F.col("l_returnflag").alias("request_type_id"), F.col("l_shipdate").alias("assigned_at"),
        F.when(F.col("l_linestatus") == "O", "assigned").otherwise("completed").alias("assignment_status"))


_LOAD = """st AS (SELECT CAST(s_suppkey AS VARCHAR) AS sid, s_name, n_name AS unit_id, CASE WHEN s_suppkey % 2 = 0 THEN 'operator' ELSE 'moderator' END AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0),
asg AS (SELECT CAST(l_suppkey AS VARCHAR) AS sid, l_returnflag AS topic, l_shipdate AS ts, l_linestatus = 'O' AS is_open FROM lineitem),
ld AS (SELECT st.sid, any_value(s_name) AS s_name, any_value(role) AS role, any_value(unit_id) AS unit_id, count(*) FILTER (WHERE is_open) AS open_count, max(ts) AS last_at FROM st LEFT JOIN asg USING (sid) GROUP BY 1),
tp AS (SELECT sid, topic, count(*) AS total, count(*) FILTER (WHERE NOT is_open) AS resolved FROM asg GROUP BY 1, 2)"""


@query("staff_load", f"""
WITH {_LOAD}
SELECT ld.sid AS staff_id, unit_id, open_count, last_at AS last_assigned_at, row_number() OVER (PARTITION BY unit_id ORDER BY open_count, last_at NULLS FIRST, ld.sid) AS candidate_rank,
  coalesce(total, 0) AS topic_total, coalesce(resolved, 0) AS topic_resolved, round(coalesce(resolved / total, 0), 6) AS resolution_rate FROM ld LEFT JOIN tp ON tp.sid = ld.sid AND topic = 'R'""")
def staff_load(spark, folder):
    """Workload of every active member, with the record on topic R."""
    load, topics = S.staff_load(_staff(spark, folder), _assignments(spark, folder))
    one = topics.where("topic = 'R'").drop("topic")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return load.join(one, "staff_id", "left").select("staff_id", "unit_id", "open_count", "last_assigned_at", F.col("candidate_rank").cast("bigint").alias("candidate_rank"),
                                                     zero("topic_total"), zero("topic_resolved"), F.round(F.coalesce("resolution_rate", F.lit(0.0)), 6).alias("resolution_rate"))


def _assignable(spark, folder):
    topic = F.when(K() % 3 == 0, "A").when(K() % 3 == 1, "N").otherwise("X")
    return order_cases(spark, folder).select(K().alias("case_id"), F.lit(1).cast("bigint").alias("source_case_revision"), "unit_id", topic.alias("topic"), (K() % 4 == 0).alias("priority_mode"),
                                             (K() % 5).cast("int").alias("repeat_count"), F.lit("normal").alias("aggression_level"), F.lit(0.0).alias("aggression_score"), F.lit(0).alias("marker_count"), "o_orderstatus")


@query("staff_choice", f"""
WITH {_CASES}, {_LOAD},
c AS (SELECT k, unit_id, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'X' END AS topic, k % 4 = 0 AS pri, o_orderstatus FROM cases),
cand AS (SELECT * FROM ld),
least_ AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY open_count, last_at NULLS FIRST, sid) = 1),
best AS (SELECT cand.*, topic FROM cand JOIN tp USING (sid) QUALIFY row_number() OVER (PARTITION BY unit_id, topic ORDER BY resolved / total DESC, total DESC, open_count, last_at NULLS FIRST, sid) = 1),
p AS (SELECT c.*, CASE WHEN pri AND best.sid IS NOT NULL THEN best.sid ELSE least_.sid END AS sid, CASE WHEN pri AND best.sid IS NOT NULL THEN best.s_name ELSE least_.s_name END AS nm, pri AND best.sid IS NOT NULL AS by_rate
  FROM c LEFT JOIN least_ ON least_.unit_id = c.unit_id LEFT JOIN best ON best.unit_id = c.unit_id AND best.topic = c.topic)
SELECT k AS case_id, p.sid AS staff_id, nm AS display_name, CASE WHEN by_rate THEN 'topic_resolution_rate' ELSE 'least_open_assignments' END AS policy, coalesce(total, 0) AS staff_topic_cases,
  round_even(coalesce(resolved / total, 0), 3) AS staff_topic_resolution_rate, CASE WHEN p.sid IS NULL THEN 'unassigned' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'assigned' END AS assignment_status
FROM p LEFT JOIN tp ON tp.sid = p.sid AND tp.topic = p.topic""")
def staff_choice(spark, folder):
    load, topics = S.staff_load(_staff(spark, folder), _assignments(spark, folder))
    cases = _assignable(spark, folder)
    states = cases.select("case_id", F.col("source_case_revision").alias("revision"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("draft_prepared").alias("state"))
    rows = S.assignment_rows(S.choose_staff(cases.drop("o_orderstatus"), load, topics), states)
    reason = lambda n: F.col(f"selection_reason.{n}").alias(n)
    return rows.select("case_id", "staff_id", "display_name", reason("policy"), reason("staff_topic_cases"), reason("staff_topic_resolution_rate"), "assignment_status")


@query("assign_batch", f"""
WITH RECURSIVE {_CASES}, {_LOAD},
cs AS (SELECT k, unit_id, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'X' END AS topic, k % 4 = 0 AS pri, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS n FROM cases),
start_ AS (SELECT ld.sid, any_value(unit_id) AS unit_id, any_value(open_count) AS o, any_value(last_at) AS la, coalesce(sum(total) FILTER (WHERE topic = 'A'), 0)::BIGINT AS ta, coalesce(sum(resolved) FILTER (WHERE topic = 'A'), 0)::BIGINT AS ra,
  coalesce(sum(total) FILTER (WHERE topic = 'N'), 0)::BIGINT AS tn, coalesce(sum(resolved) FILTER (WHERE topic = 'N'), 0)::BIGINT AS rn FROM ld LEFT JOIN tp USING (sid) GROUP BY 1),
-- One step takes the next case of every unit; a member that was picked waits behind all that were not, lk is the last pick of this batch.
go AS (
  SELECT sid, unit_id, o::BIGINT AS o, la, 0::BIGINT AS lk, ta, ra, tn, rn, 0::BIGINT AS tx, 0::BIGINT AS n, NULL::BIGINT AS k, FALSE AS chosen, FALSE AS by_rate FROM start_
  UNION ALL
  SELECT sid, unit_id, o + CAST(chosen AS BIGINT), la, CASE WHEN chosen THEN k ELSE lk END, ta + CAST(chosen AND topic = 'A' AS BIGINT), ra, tn + CAST(chosen AND topic = 'N' AS BIGINT), rn, tx + CAST(chosen AND topic = 'X' AS BIGINT), n, k, chosen, by_rate
  FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY by_rate AND tt = 0, CASE WHEN by_rate THEN -rr / tt END, CASE WHEN by_rate THEN -tt END, o, lk, la NULLS FIRST, sid) = 1 AS chosen
    FROM (SELECT *, pri AND max(tt) OVER (PARTITION BY unit_id) > 0 AS by_rate
      FROM (SELECT go.* EXCLUDE (n, k, chosen, by_rate), cs.n, cs.k, cs.topic, cs.pri, CASE cs.topic WHEN 'A' THEN ta WHEN 'N' THEN tn ELSE tx END AS tt, CASE cs.topic WHEN 'A' THEN ra WHEN 'N' THEN rn ELSE 0 END AS rr
        FROM go JOIN cs ON cs.unit_id = go.unit_id AND cs.n = go.n + 1))))
SELECT cs.k AS case_id, cs.k AS seq, cs.unit_id, sid AS staff_id, CASE WHEN by_rate THEN 'topic_resolution_rate' ELSE 'least_open_assignments' END AS policy, coalesce(o - 1, 0) AS open_before
FROM cs LEFT JOIN (SELECT * FROM go WHERE chosen) g ON g.unit_id = cs.unit_id AND g.n = cs.n""")
def assign_batch(spark, folder):
    """All cases assigned one after the other inside their unit."""
    load, topics = S.staff_load(_staff(spark, folder), _assignments(spark, folder))
    return S.assign_batch(_assignable(spark, folder).withColumn("seq", F.col("case_id")), load, topics)


@query("overlooked_cases", """
WITH c AS (SELECT o_orderkey AS k, o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS ready FROM orders)
SELECT k AS case_id, 'route' AS work, CASE WHEN k % 3 <> 0 THEN 'g' || k END AS source_generation_id FROM c
WHERE ready AND k % 4 <> 0 AND ((k % 3 <> 0 AND k % 2 = 0) OR (k % 3 = 0 AND (k % 5 = 0 OR (k % 5 = 1 AND k % 7 >= 4))))
UNION ALL SELECT k, 'assignment', NULL FROM c WHERE k % 4 = 0 AND k % 16 <> 0""")
def overlooked_cases(spark, folder):
    """Finished or given-up drafts without a route, and routes nobody owns."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    one = F.lit(1).cast("bigint")
    case, rev = K().alias("case_id"), one.alias("source_case_revision")
    generation = F.concat(F.lit("g"), K().cast("string"))
    state = orders.select(case, one.alias("revision"), F.when(F.col("o_orderpriority") == "5-LOW", "missing_information").otherwise("complete").alias("completion_status"),
                          F.when(K() % 3 != 0, generation).alias("current_generation_id"), F.lit("t").alias("request_type_id"))
    classification = orders.select(case, F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("classified").alias("status"))
    generations = orders.select(generation.alias("generation_id"), F.when(K() % 2 == 0, "completed").otherwise("failed").alias("generation_status"))
    routes = orders.where(K() % 4 == 0).select(case, rev, F.lit("u").alias("target_unit_id"))
    jobs = orders.select(case, rev, F.when(K() % 5 == 0, "failed").when(K() % 5 == 1, "waiting").otherwise("pending").alias("state"), (K() % 7).alias("attempt_count"))
    assignments = orders.where(K() % 16 == 0).select(case, rev)
    late = R.overlooked(state, classification, generations, routes, jobs).select("case_id", F.lit("route").alias("work"), "source_generation_id")
    orphans = R.unassigned_routes(routes, assignments, state).select("case_id", F.lit("assignment").alias("work"), F.lit(None).cast("string").alias("source_generation_id"))
    return late.unionByName(orphans)


@query("closed_assignments", """
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS rev, l_linestatus = 'O' AS assigned FROM lineitem),
ch AS (SELECT o_orderkey AS k, 1 + o_orderkey % 4 AS now, o_orderstatus = 'F' AS done FROM orders WHERE o_orderstatus <> 'P'),
j AS (SELECT a.k, a.assigned, a.assigned AND coalesce(CASE WHEN done THEN rev = now ELSE now > 1 AND rev < now END, FALSE) AS closes FROM a LEFT JOIN ch USING (k))
SELECT k AS case_id, count(*) FILTER (WHERE closes) AS closed_now, count(*) FILTER (WHERE assigned AND NOT closes) AS still_open FROM j GROUP BY 1""")
def closed_assignments(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("source_case_revision"),
                                                    F.when(F.col("l_linestatus") == "O", "assigned").otherwise("completed").alias("assignment_status"))
    orders = table(spark, folder, "orders").where("o_orderstatus <> 'P'")
    changes = orders.select(F.col("o_orderkey").alias("case_id"), (1 + F.col("o_orderkey") % 4).alias("revision"),
                            F.when(F.col("o_orderstatus") == "F", "completed").otherwise("draft_prepared").alias("state"))
    closed = R.close_assignments(lines, changes)
    return closed.groupBy("case_id").agg(F.count_if("closed_now").alias("closed_now"), F.count_if(F.col("assignment_status") == "assigned").alias("still_open"))
