"""Idempotent change requests as set operations: supplements, starts, reviews.

A request names a case, an idempotency key and the revision it was written
against. ``seq`` is the unique arrival order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import lookup, ordered_stream, spread_join
from docketry.functions.text import nfc, nfc_suspect, strip
from docketry.operators.fields import field_lists, validate_attachments, validate_value
from docketry.sources import fixed


def request_fingerprint(*facts: str | Column) -> Column:
    return F.sha2(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}), 256)


def start_requests(requests: DataFrame, state: DataFrame, replays: DataFrame | None = None, **spread) -> DataFrame:
    """Correspondence start requests -> outcome.

    requests(seq, case_id, idempotency_key, revision); state(case_id, revision,
    completion_status); replays(case_id, idempotency_key, revision). A start does
    not move the revision, so the first eligible request of a key wins and the
    later ones replay it: one combined ``min`` per key, no per-group state.
    """
    spread = {"count_on": requests, **spread}
    current = state.select("case_id", F.col("revision").alias("_now"), "completion_status")
    seen = spread_join(requests, current, ["case_id"], "seq", **spread)
    refusal = (
        F.when(F.col("_now").isNull(), "CASE_NOT_FOUND").when(F.col("_now") != F.col("revision"), "CASE_REVISION_CONFLICT")
        .when(F.col("completion_status") != "complete", "CASE_NOT_READY_FOR_CORRESPONDENCE"))
    judged = seen.withColumn("_refusal", refusal)
    wins = judged.where(F.col("_refusal").isNull()).select(
        "case_id", "idempotency_key", F.col("seq").alias("_seq"), F.col("revision").alias("_rev"))
    if replays is not None:
        wins = wins.unionByName(replays.select("case_id", "idempotency_key", F.lit(-1).cast(requests.schema["seq"].dataType).alias("_seq"), F.col("revision").alias("_rev")))
    recorded = wins.groupBy("case_id", "idempotency_key").agg(F.min("_seq").alias("_won"), F.min_by("_rev", "_seq").alias("_won_rev"))
    return _with_replays(judged, recorded, "queued", spread)


def complete_reviews(requests: DataFrame, state: DataFrame, replays: DataFrame | None = None, **spread) -> DataFrame:
    """Review completions -> outcome; the first valid one closes the case.

    state(case_id, revision, state). After the winner every other key meets a
    completed case, while the winner's own key replays.
    """
    spread = {"count_on": requests, **spread}
    current = state.select("case_id", F.col("revision").alias("_now"), F.col("state").alias("_state"))
    seen = spread_join(requests, current, ["case_id"], "seq", **spread)
    blocked = F.col("_now").isNull() | (F.col("_now") != F.col("revision"))
    judged = seen.withColumn("_refusal", F.when(blocked, "CASE_REVISION_CONFLICT").when(F.col("_state") != "needs_review", "CASE_NOT_REVIEWABLE"))
    fresh = judged
    if replays is not None:
        # A stored key is answered from its record and can never close a case.
        fresh = judged.join(replays.select("case_id", "idempotency_key"), ["case_id", "idempotency_key"], "left_anti")
    winners = fresh.where(F.col("_refusal").isNull()).groupBy("case_id").agg(F.min(F.struct("seq", "idempotency_key", "revision")).alias("w"))
    wins = winners.select("case_id", F.col("w.idempotency_key").alias("idempotency_key"), F.col("w.seq").alias("_won"), F.col("w.revision").alias("_won_rev"))
    if replays is not None:
        wins = wins.unionByName(replays.select("case_id", "idempotency_key", F.lit(-1).cast(requests.schema["seq"].dataType).alias("_won"), F.col("revision").alias("_won_rev")))
    closed = winners.select("case_id", F.col("w.seq").alias("_closed"))
    judged = spread_join(judged, closed, ["case_id"], "seq", **spread)
    late = F.col("_refusal").isNull() & (F.col("seq") > F.col("_closed"))
    judged = judged.withColumn("_refusal", F.when(late, "CASE_NOT_REVIEWABLE").otherwise(F.col("_refusal"))).drop("_closed")
    return _with_replays(judged, wins, "completed", spread)


def _with_replays(judged: DataFrame, recorded: DataFrame, success: str, spread: dict) -> DataFrame:
    joined = spread_join(judged, recorded, ["case_id", "idempotency_key"], "seq", **spread)
    after = F.col("seq") > F.col("_won")
    outcome = (
        F.when(after & (F.col("_won_rev") != F.col("revision")), "IDEMPOTENCY_KEY_REUSED").when(after, "replay")
        .when(F.col("_refusal").isNotNull(), F.col("_refusal")).otherwise(success))
    return joined.select(*[c for c in judged.columns if not c.startswith("_")], outcome.alias("outcome"))


# --- supplements ------------------------------------------------------------

SUPPLEMENT_RESULT = "seq long, case_id string, outcome string, revision_after long"


def canonical_fields(fields: Column) -> Column:
    """Trimmed, key-sorted entries of a string map."""
    return F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value"))))


def supplement_shape(fields: Column) -> Column:
    """``bad_fields`` / ``duplicate_ids`` / null before any state is looked at."""
    entries = canonical_fields(fields)
    sane = F.size(entries).between(1, fixed.MAX_FIELDS_PER_TYPE) & F.forall(
        entries, lambda e: e["value"].isNotNull() & F.length(e["value"]).between(1, fixed.MAX_FREE_TEXT))
    unique = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) == F.size(entries)
    return F.when(~F.coalesce(sane, F.lit(False)), "bad_fields").when(~unique, "duplicate_ids")


def apply_supplements(requests: DataFrame, state: DataFrame, registry: DataFrame, replays: DataFrame | None = None) -> DataFrame:
    """Supplemental answers -> outcome per request, in arrival order per case.

    requests(seq, case_id, idempotency_key, revision, fields map<string,string>);
    state(case_id, revision, request_type_id, accepted_fields, missing_fields,
    invalid_fields, source_metadata); replays(case_id, idempotency_key,
    fingerprint). An accepted request moves the revision only when the evaluated
    state differs, and the next one must name the new revision: a genuine chain.
    Requests are therefore hashed by case, sorted by arrival and folded as a
    stream - a task holds the running state of one case, never its requests.
    Values are judged by Spark beforehand; the fold only compares.
    """
    lists = lookup(field_lists(registry))
    known = state.select("case_id", "request_type_id").join(lists, "request_type_id", "left")
    composed = F.from_json(nfc(F.to_json("fields")), "map<string,string>")
    requests = requests.withColumn("fields", F.when(nfc_suspect(F.to_json("fields")), composed).otherwise(F.col("fields")))
    shaped = requests.withColumn("problem", supplement_shape(F.col("fields"))).withColumn(
        "fields", F.map_from_entries(F.when(F.col("problem").isNull(), canonical_fields(F.col("fields")))))
    typed = shaped.join(known, "case_id", "left")
    no_ids = F.array().cast("array<string>")
    unknown = F.size(F.array_except(F.map_keys("fields"), F.coalesce(F.transform("definitions", lambda d: d["field_id"]), no_ids))) > 0

    def judged(e: Column) -> Column:
        kind = F.get(F.filter("definitions", lambda d: d["field_id"] == e["key"]), F.lit(0))["kind"]
        result = validate_value(kind, e["value"], F.lit("{}"))
        return F.struct(e["key"].alias("id"), result["value"].alias("value"), result["error"].alias("error"))

    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    body = typed.select(
        "case_id", F.col("seq").cast("long").alias("seq"), "idempotency_key", F.col("revision").cast("long").alias("revision"), "problem",
        F.coalesce(unknown, F.lit(False)).alias("unknown"), F.to_json(F.transform(F.map_entries("fields"), judged)).alias("payload"),
        request_fingerprint("case_id", "revision", F.map_entries("fields").alias("f")).alias("fingerprint"))
    opening = state.join(lists, "request_type_id", "left").select(
        "case_id", F.lit(-2).cast("long").alias("seq"), *nothing("string", "idempotency_key"), F.col("revision").cast("long").alias("revision"),
        F.lit("state").alias("problem"), F.lit(False).alias("unknown"),
        F.to_json(F.struct(
            F.col("accepted_fields").alias("accepted"), F.transform("missing_fields", lambda m: m["id"]).alias("missing"),
            F.transform("invalid_fields", lambda m: F.struct(m["id"].alias("id"), m["code"].alias("code"))).alias("invalid"),
            validate_attachments(F.col("source_metadata")).alias("files"),
            F.transform("definitions", lambda d: F.struct(d["field_id"].alias("id"), d["required"].alias("required"), (d["kind"] == "attachment").alias("file"))).alias("definitions"),
        )).alias("payload"), *nothing("string", "fingerprint"))
    rows = body.unionByName(opening)
    if replays is not None:
        rows = rows.unionByName(replays.select(
            "case_id", F.lit(-1).cast("long").alias("seq"), "idempotency_key", *nothing("long", "revision"), F.lit("replay").alias("problem"),
            F.lit(False).alias("unknown"), *nothing("string", "payload"), "fingerprint"))
    return ordered_stream(rows, "case_id", "seq").mapInPandas(_fold_supplements, SUPPLEMENT_RESULT)


def _next_state(state: dict, answers: dict) -> dict:
    """Evaluated state after the judged ``answers``; unanswered fields keep theirs."""
    accepted, missing, invalid = {}, [], []
    for field in state["definitions"]:
        name, prior, answer = field["id"], state["accepted"].get(field["id"]), answers.get(field["id"])
        if field["file"]:
            files = state["files"]
            answer = None if files == "absent" else {"value": files} if files == "present" else {"error": files}
        if answer and answer.get("error"):
            invalid.append({"id": name, "code": answer["error"]})
        if answer and answer.get("value") is not None:
            accepted[name] = {"value": answer["value"], "confidence": 1.0 if field["file"] else 0.5}
        elif prior:
            accepted[name] = prior
        elif field["required"] and not (answer and answer.get("error")):
            missing.append(name)
    return {**state, "accepted": accepted, "missing": missing, "invalid": invalid}


def _fold_supplements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    case, now, state, recorded = None, None, None, {}
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.case_id != case:
                case, now, state, recorded = row.case_id, None, None, {}
            if row.problem == "state":
                now, state = int(row.revision), {"accepted": {}, "missing": [], "invalid": [], "definitions": [], **json.loads(row.payload)}
                continue
            if row.problem == "replay":
                recorded[row.idempotency_key] = row.fingerprint
                continue
            stored = recorded.get(row.idempotency_key)
            if isinstance(row.problem, str):
                outcome = row.problem
            elif stored is not None:
                outcome = "replay" if stored == row.fingerprint else "key_reused"
            elif now is None:
                outcome = "not_found"
            elif row.revision != now:
                outcome = "revision_conflict"
            elif row.unknown:
                outcome = "unknown_field"
            else:
                after = _next_state(state, {a["id"]: a for a in json.loads(row.payload)})
                outcome = "unchanged" if after == state else "applied"
                now, state = now + (outcome == "applied"), after
                recorded[row.idempotency_key] = row.fingerprint
            out.append((int(row.seq), row.case_id, outcome, -1 if now is None else now))
        yield pd.DataFrame(out, columns=["seq", "case_id", "outcome", "revision_after"])
