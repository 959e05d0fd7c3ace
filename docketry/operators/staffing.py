"""Staff workload, choice per case and sequential assignment of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry.functions.scale import LOOKUP_ROWS, lookup, ordered_stream, settle
from docketry.functions.text import round_half_even


def staff_load(staff: DataFrame, assignments: DataFrame, candidates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(load, topics) of active staff.

    load: one row per member with open_count, last_assigned_at and its rank in the
    unit; ``candidates`` keeps only that many of the least loaded. topics: (staff, topic) totals.
    Assignments are counted map-side by (staff, topic) first; one busy member or
    topic does not concentrate rows.
    """
    is_open = F.col("assignment_status") == "assigned"
    by_topic = assignments.groupBy("staff_id", "request_type_id").agg(
        F.count("*").alias("topic_total"), F.count_if(F.col("assignment_status") == "completed").alias("topic_resolved"),
        F.count_if(is_open).alias("topic_open"), F.max("assigned_at").alias("topic_last"))
    # Staff x topics rows: read the assignments once, whatever is asked next.
    by_topic = settle(by_topic)
    totals = by_topic.groupBy("staff_id").agg(F.sum("topic_open").alias("open_count"), F.max("topic_last").alias("last_assigned_at"))
    members = staff.where("active").select("staff_id", "display_name", "role", "unit_id")
    load = members.join(totals, "staff_id", "left").withColumn("open_count", F.coalesce("open_count", F.lit(0)))
    order = W.partitionBy("unit_id").orderBy("open_count", F.col("last_assigned_at").asc_nulls_first(), "staff_id")
    load = load.withColumn("candidate_rank", F.row_number().over(order))
    if candidates is not None:
        load = load.where(F.col("candidate_rank") <= candidates)
    topics = by_topic.where(F.col("request_type_id").isNotNull()).select(
        "staff_id", F.col("request_type_id").alias("topic"), "topic_total", "topic_resolved",
        (F.col("topic_resolved") / F.col("topic_total")).alias("resolution_rate"))
    return load, topics


def unit_choices(load: DataFrame, topics: DataFrame) -> DataFrame:
    """Both answers per (unit, topic): the least loaded member and the best resolver.

    Members are ranked per unit and topic; cases merely look them up.
    """
    member = F.struct("staff_id", "display_name", "role")
    absent = F.col("last_assigned_at").isNotNull()
    quiet = load.groupBy("unit_id").agg(F.min_by(member, F.struct("open_count", absent, "last_assigned_at", "staff_id")).alias("least"))
    skilled = load.join(topics.where("topic_total > 0"), "staff_id")
    rate = F.struct("staff_id", "display_name", "role", "topic_total", "topic_resolved", "resolution_rate")
    expert = skilled.groupBy("unit_id", "topic").agg(F.min_by(rate, F.struct(
        (-F.col("resolution_rate")).alias("r"), (-F.col("topic_total")).alias("t"), "open_count", absent, "last_assigned_at", "staff_id")).alias("expert"))
    return quiet, expert


def choose_staff(cases: DataFrame, load: DataFrame, topics: DataFrame) -> DataFrame:
    """Owner per case against one workload snapshot, with the reason.

    cases(case_id, unit_id, topic, priority_mode [, repeat_count, aggression_*]).
    Flagged cases go to the best resolver of the topic when anyone has handled
    it, all others to the least loaded member; an empty unit stays unassigned.
    """
    c = F.col
    quiet, expert = unit_choices(load, topics)
    joined = cases.join(lookup(quiet), "unit_id", "left").join(lookup(expert), ["unit_id", "topic"], "left")
    by_rate = c("priority_mode") & c("expert").isNotNull()
    chosen = joined.withColumn("by_rate", by_rate)
    for name in ("staff_id", "display_name", "role"):
        chosen = chosen.withColumn(name, F.when(c("by_rate"), c(f"expert.{name}")).otherwise(c(f"least.{name}")))
    own = topics.select("staff_id", "topic", c("topic_total").alias("staff_topic_cases"), c("resolution_rate").alias("_rate"))
    full = chosen.join(lookup(own), ["staff_id", "topic"], "left")
    return (
        full.withColumn("policy", F.when(c("by_rate"), "topic_resolution_rate").otherwise("least_open_assignments"))
        .withColumn("staff_topic_cases", F.coalesce("staff_topic_cases", F.lit(0)))
        .withColumn("staff_topic_resolution_rate", round_half_even(F.coalesce("_rate", F.lit(0.0)), 3))
        .withColumn("assignment_status", F.when(c("staff_id").isNull(), "unassigned").otherwise("assigned"))
        .drop("least", "expert", "by_rate", "_rate"))


def assignment_rows(chosen: DataFrame, states: DataFrame) -> DataFrame:
    """Assignment rows with their selection reason; a completed case is born closed."""
    c = F.col
    done = states.where("state = 'completed'").select("case_id", c("revision").alias("source_case_revision")).withColumn("_done", F.lit(True))
    joined = chosen.join(done, ["case_id", "source_case_revision"], "left")
    reason = F.struct("policy", "repeat_count", "aggression_level", "aggression_score", "marker_count", c("topic").alias("topic_request_type_id"),
                      "staff_topic_cases", "staff_topic_resolution_rate")
    status = F.when(c("staff_id").isNull(), "unassigned").when(c("_done"), "completed").otherwise("assigned")
    return joined.select("case_id", "source_case_revision", "unit_id", c("topic").alias("request_type_id"), "staff_id", "display_name", "role",
                         reason.alias("selection_reason"), status.alias("assignment_status"))


# Slices of one unit's arrivals whose rows are numbered by separate tasks.
ARRIVAL_SLICES = 256


def assign_batch(cases: DataFrame, load: DataFrame, topics: DataFrame) -> DataFrame:
    """Assign a batch in arrival order, each pick raising the load the next one sees.

    cases(case_id, seq, unit_id, topic, priority_mode); seq is unique inside a unit,
    ids are of any simple type. Until its first flagged case a unit's picks follow from
    the arrival number alone (``_quiet_picks``): these cases are spread over all tasks,
    whatever the size of their unit. Flagged cases look at
    totals that every earlier pick may have changed, so from there on the unit is a chain
    by definition and is folded as a sorted stream: a task keeps the unit's members and
    their topic counts in memory, never the cases. Cases of a null or empty unit stay unassigned.
    """
    c = F.col
    kind = cases.schema["case_id"].dataType.simpleString()
    at = F.struct("seq", "case_id")
    body = cases.select("unit_id", c("seq").cast("long").alias("seq"), "case_id", "topic", "priority_mode")
    members = load.where(c("unit_id").isNotNull()).select(
        "unit_id", "staff_id", c("open_count").cast("long").alias("open_count"), c("last_assigned_at").cast("string").alias("last"))
    record = topics.where("topic_total > 0").join(members.select("unit_id", "staff_id"), "staff_id").select(
        "unit_id", "staff_id", "topic", c("topic_total").cast("long").alias("total"), c("topic_resolved").cast("long").alias("resolved"))

    # Per unit: where its quiet stretch ends, and cuts for numbering its arrivals in slices.
    cuts = [n / ARRIVAL_SLICES for n in range(1, ARRIVAL_SLICES)]
    units = settle(body.groupBy("unit_id").agg(F.min(F.when(c("priority_mode"), at)).alias("stop"), F.percentile_approx("seq", cuts).alias("bounds")))
    shipped = lookup(units.withColumnRenamed("unit_id", "u"), LOOKUP_ROWS // ARRIVAL_SLICES)
    split = body.join(shipped, c("unit_id").eqNullSafe(c("u")), "left").withColumn("slice", F.size(F.filter("bounds", lambda b: b < c("seq")))).drop("u", "bounds")
    quiet = _quiet_picks(split.where(c("stop").isNull() | (at < c("stop"))).drop("stop"), members)

    # What the quiet stretch leaves behind opens the chain, as further history; units without a chain are left out.
    chained = units.where(c("stop").isNotNull()).select("unit_id")
    left = quiet.where(c("staff_id").isNotNull()).join(lookup(chained), "unit_id", "left_semi").groupBy("unit_id", "staff_id", "topic").agg(F.count("*").alias("total"), F.max("seq").alias("seq"))
    nothing = lambda of, *names: [F.lit(None).cast(of).alias(n) for n in names]
    opening = members.join(chained, "unit_id", "left_semi").select(
        "unit_id", F.lit(0).cast("long").alias("seq"), *nothing(kind, "case_id"), *nothing("string", "topic"), F.lit(False).alias("priority_mode"), "staff_id",
        "open_count", "last", *nothing("long", "total", "resolved"))
    # A member's topics are rows of their own, so that no value grows with their number.
    told = lambda df, seq, resolved, picked: df.select("unit_id", seq.cast("long").alias("seq"), *nothing(kind, "case_id"), "topic", F.lit(picked).alias("priority_mode"), "staff_id",
                                                       *nothing("long", "open_count"), *nothing("string", "last"), "total", resolved.cast("long").alias("resolved"))
    history = told(record.join(chained, "unit_id", "left_semi"), F.lit(0), c("resolved"), False).unionByName(told(left, c("seq"), F.lit(0), True))
    chain = split.where(at >= c("stop")).select("unit_id", "seq", "case_id", "topic", "priority_mode",
                                                *nothing("string", "staff_id"), *nothing("long", "open_count"), *nothing("string", "last"), *nothing("long", "total", "resolved"))
    # Arrival numbers may be negative; members and history come first all the same.
    rows = opening.withColumn("kind", F.lit(0)).unionByName(history.withColumn("kind", F.lit(1))).unionByName(chain.withColumn("kind", F.lit(2)))
    names = f"case_id {kind}, seq long, unit_id string, staff_id string, policy string, open_before long"
    folded = ordered_stream(rows, "unit_id", "kind", "seq", "staff_id").mapInPandas(_fold_units, names)
    return quiet.select("case_id", "seq", c("unit_id").cast("string").alias("unit_id"), c("staff_id").cast("string").alias("staff_id"),
                        F.lit("least_open_assignments").alias("policy"), "open_before").unionByName(folded)


def _quiet_picks(cases: DataFrame, members: DataFrame) -> DataFrame:
    """Cases that go to the least loaded member, one after the other, without a chain.

    Picks fill a unit's loads like water: at level L everybody with at most L open cases
    is picked once, first those who start at L (by last assignment and id), then the others
    in the order of the level below. That order is by opening load, highest first; so with
    members numbered upwards from the lowest load, the picks of a level run downwards
    from the last number that has reached it. Levels between two opening loads are alike, hence
    pick number k follows from the stretch of levels it falls into by a division.
    The stretches of a unit are at most as many as its members.
    """
    c = F.col
    small = members.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    ship = F.broadcast if small else (lambda df: df)
    from_low = W.partitionBy("unit_id").orderBy("open_count", c("last").desc_nulls_last(), c("staff_id").desc())
    numbered = members.withColumn("place", F.row_number().over(from_low).cast("long") - 1)
    levels = W.partitionBy("unit_id").orderBy("open_count")
    reached = members.groupBy("unit_id", "open_count").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(levels))
    reached = reached.withColumn("picks", c("n") * (F.lead("open_count").over(levels) - c("open_count")))
    reached = reached.withColumn("first", F.coalesce(F.sum("picks").over(levels.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    stretches = reached.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("first", "open_count", "n"))).alias("stretches"))
    ranked = _arrival_numbers(cases)
    in_force = F.element_at(F.filter("stretches", lambda s: s["first"] <= c("k")), -1)
    placed = ranked.join(ship(stretches), "unit_id", "left").withColumn("s", F.when(c("stretches").isNotNull(), in_force)).drop("stretches")
    step = c("k") - c("s.first")
    placed = placed.withColumn("place", c("s.n") - 1 - step % c("s.n")).withColumn("open_before", F.coalesce(c("s.open_count") + F.expr("(k - s.first) div s.n"), F.lit(0)))
    return placed.join(ship(numbered.select("unit_id", "place", "staff_id")), ["unit_id", "place"], "left").select(
        "case_id", "seq", "unit_id", "topic", "staff_id", c("open_before").cast("long").alias("open_before"))


def _arrival_numbers(cases: DataFrame) -> DataFrame:
    """Add k, the number of a case inside its unit from 0, without one task per unit.

    Slices of a unit (cut at approximate quantiles of seq; any cuts give the same numbers)
    are numbered by themselves and start behind the rows of the slices before.
    """
    c = F.col
    before = W.partitionBy("unit_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = cases.groupBy("unit_id", "slice").agg(F.count("*").alias("n")).select("unit_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("unit_id", "slice").orderBy("seq", "case_id")) - 1
    joined = cases.withColumn("inside", inside).join(sizes.withColumnRenamed("unit_id", "u").withColumnRenamed("slice", "sl"), c("unit_id").eqNullSafe(c("u")) & (c("slice") == c("sl")))
    return joined.withColumn("k", c("offset") + c("inside")).drop("u", "sl", "slice", "inside", "offset")


def _fold_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Idle members wait in a heap (an entry is stale once its member's turn number
    moved on). The members that know a topic wait in a heap of the topic, built when its first
    flagged case comes. A pick makes a member's place in the other heaps worse, never better,
    so an entry there is corrected when it comes up; only one without solved cases rises with
    its number of cases, and gets a new entry at once. Heaps are rebuilt when half of them is stale."""
    import heapq

    unit, pool, idle, skilled, best = None, {}, [], {}, {}
    rank = lambda m: (m["open"], m["last"], m["id"])

    def wait(member):
        member["turn"] += 1
        heapq.heappush(idle, (*rank(member), member["turn"]))
        if len(idle) > 2 * len(pool) + 64:
            idle[:] = [(*rank(m), m["turn"]) for m in pool.values()]
            heapq.heapify(idle)

    def record(member, topic):
        total, resolved, turn = member["topics"][topic]
        return (-resolved / total, -total, *rank(member), turn)

    def fill(topic):
        best[topic] = [record(pool[i], topic) for i in skilled[topic]]
        heapq.heapify(best[topic])

    def expert(topic):
        if topic not in best:
            fill(topic)
        heap = best[topic]
        while True:
            member = pool[heap[0][4]]
            if member["topics"][topic][2] != heap[0][5]:
                heapq.heappop(heap)
            elif (now := record(member, topic)) != heap[0]:
                heapq.heapreplace(heap, now)
            else:
                return member

    def learn(member, topic):
        """One more case of the topic; the member's load counts it already."""
        counts = member["topics"].setdefault(topic, [0, 0, 0])
        counts[0] += 1
        skilled.setdefault(topic, set()).add(member["id"])
        if topic in best and (counts[0] == 1 or not counts[1]):
            counts[2] += 1
            heapq.heappush(best[topic], record(member, topic))
            if len(best[topic]) > 2 * len(skilled[topic]) + 64:
                fill(topic)

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.unit_id != unit:
                unit, pool, idle, skilled, best = row.unit_id, {}, [], {}, {}
            if row.kind == 0:
                pool[row.staff_id] = {"id": row.staff_id, "open": int(row.open_count), "last": (0, "", 0) if row.last is None else (1, row.last, 0), "topics": {}, "turn": 0}
                wait(pool[row.staff_id])
                continue
            if row.kind == 1:
                member = pool[row.staff_id]
                counts = member["topics"].setdefault(row.topic, [0, 0, 0])
                counts[0], counts[1] = counts[0] + int(row.total), counts[1] + int(row.resolved)
                skilled.setdefault(row.topic, set()).add(row.staff_id)
                if row.priority_mode:  # picks of the quiet stretch, the last one at seq: later than any recorded assignment
                    member["open"] += int(row.total)
                    member["last"] = max(member["last"], (2, "", int(row.seq)))
                    wait(member)
                continue
            by_rate = bool(row.priority_mode) and row.topic in skilled
            if by_rate:
                picked = expert(row.topic)
            else:
                while idle and pool[idle[0][2]]["turn"] != idle[0][3]:
                    heapq.heappop(idle)
                picked = pool[idle[0][2]] if idle else None
            if picked is None:
                out.append((row.case_id, int(row.seq), unit, None, "least_open_assignments", 0))
                continue
            out.append((row.case_id, int(row.seq), unit, picked["id"], "topic_resolution_rate" if by_rate else "least_open_assignments", picked["open"]))
            picked["open"] += 1
            picked["last"] = (2, "", int(row.seq))
            learn(picked, row.topic)
            wait(picked)
        yield pd.DataFrame(out, columns=["case_id", "seq", "unit_id", "staff_id", "policy", "open_before"])
