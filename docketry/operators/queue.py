"""Operator queue: list page, counts, related cases, display measures, explanations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry.functions import overlap
from docketry.functions.scale import discard, lookup, settle, written
from docketry.functions.text import ascii_fold, round_half_even, strip
from docketry.operators.cases import metadata_text
from docketry.operators.routing import applicant_name
from docketry.sources import fixed


def page_bounds(limit, offset) -> tuple[int, int]:
    """Out-of-range or unreadable paging collapses to the nearest legal window."""
    def number(value, default):
        try:
            return int(value)
        except (TypeError, ValueError):
            return default
    return max(1, min(number(limit, fixed.PAGE_DEFAULT), fixed.PAGE_MAX)), max(0, number(offset, 0))


def case_rows(states: DataFrame, validation: DataFrame, classification: DataFrame, routes: DataFrame, intake: DataFrame) -> DataFrame:
    """Every projected case with whatever the later steps already know about it."""
    c = F.col
    rev = c("source_case_revision").alias("revision")
    return (
        states
        .join(validation.select("case_id", "completion_status", c("document_id").alias("_vdoc"), c("request_type_id").alias("_vtype"), "accepted_fields"), "case_id", "left")
        .join(classification.select("case_id", c("document_id").alias("_cdoc"), c("request_type_id").alias("_ctype"), "request_type_label", "department_id",
                                    "department_label", "unit_id", "unit_label", c("status").alias("classification_status"), "confidence", "reason"), "case_id", "left")
        .join(routes.select("case_id", rev, c("routing_status").alias("_route")), ["case_id", "revision"], "left")
        .join(intake.select("case_id", "created_at", "language", "source_metadata"), "case_id", "left")
        .withColumn("document_id", F.coalesce("_vdoc", "_cdoc")).withColumn("request_type_id", F.coalesce("_vtype", "_ctype"))
        .withColumn("routing_status", F.coalesce("_route", F.lit("not_routed"))).withColumn("applicant_name", applicant_name(c("accepted_fields")))
        .withColumn("title", metadata_text(c("source_metadata"), "title")).withColumn("channel", metadata_text(c("source_metadata"), "channel"))
        .drop("_vdoc", "_cdoc", "_vtype", "_ctype", "_route", "source_metadata"))


def search_cases(rows: DataFrame, state: str = "", query: str = "") -> DataFrame:
    """State filter and case-insensitive search; wildcards in ``query`` keep their SQL meaning."""
    found = rows.where(F.col("state") == state) if state else rows
    if not query:
        return found
    first_field = F.try_element_at(F.col("accepted_fields"), F.lit("applicant-name"))["value"]
    hit = F.lit(False)
    for value in (F.col("document_id"), F.col("case_id").cast("string"), F.col("request_type_label"), F.col("title"), first_field):
        hit = hit | F.coalesce(value, F.lit("")).ilike(f"%{query}%")
    return found.where(hit)


def case_list(rows: DataFrame, state: str = "", query: str = "", limit=fixed.PAGE_DEFAULT, offset=0) -> DataFrame:
    """One page, most urgent and most recently changed first, plus the match total."""
    size, start = page_bounds(limit, offset)
    matched = search_cases(rows, state, query)
    total = matched.agg(F.count("*")).scalar()
    page = matched.orderBy(F.desc("priority_score"), F.desc("updated_at"), "case_id").offset(start).limit(size)
    return page.withColumn("total", total)


def queue_counts(states: DataFrame, tabs=fixed.QUEUE_TABS) -> DataFrame:
    """Count per queue tab; the unnamed tab is the grand total, empty tabs show 0."""
    counted = states.agg(*[
        (F.count("*") if value == "" else F.count_if(F.col("state") == value)).alias(f"t{n}") for n, (value, _label) in enumerate(tabs)])
    entries = F.array(*[F.struct(F.lit(n).alias("tab_ord"), F.lit(v).alias("state"), F.lit(label).alias("label"), F.col(f"t{n}").alias("cases"))
                        for n, (v, label) in enumerate(tabs)])
    return counted.select(F.explode(entries).alias("t")).select("t.*")


def automation_rate(states: DataFrame) -> DataFrame:
    """Completed share in whole percent (half up), null for an empty queue."""
    share = F.count_if(F.col("state") == "completed") / F.nullif(F.count("*"), F.lit(0)) * 100
    return states.agg(F.count_if(F.col("state") == "completed").alias("completed"), F.count("*").alias("total"), F.round(share).cast("int").alias("automation_percent"))


def similarity_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_fold(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


RELATED_BLOCK = 8192
RELATED_CHARS = 32_000_000  # text of a block
RELATED_FEW = 512           # cases of one applicant that are not worth two blocks
RELATED_COPIES = 6          # of each block that are on the way at a time
FAR = 2**31 - 1             # place of a case outside the pool


def _best_few(asker: np.ndarray, other: np.ndarray, score: np.ndarray, turn: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """The ``limit`` best others of each asker; equal scores by the other's turn."""
    order = np.lexsort((turn[other], -score, asker))
    asker, other, score = asker[order], other[order], score[order]
    first = np.arange(len(asker)) - np.searchsorted(asker, asker, "left") < limit
    return asker[first], other[first], score[first]


def _case_block(table: pa.Table) -> dict:
    """Cases with their hashed words in ascending number of words; a case's turn is its place by age, then by id as text."""
    order = pc.sort_indices(table, sort_keys=[("at", "ascending"), ("shown", "ascending")], null_placement="at_start").to_numpy()
    turn = np.empty(len(order), dtype=np.int32)
    turn[order] = np.arange(len(order), dtype=np.int32)
    tokens = table["tokens"].combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.argsort(sizes, kind="stable")
    values = pc.list_flatten(tokens).to_numpy(zero_copy_only=False)
    entry = overlap.spans((np.cumsum(sizes) - sizes)[rows], sizes[rows])
    place = pc.fill_null(table["place"], FAR).to_numpy()[rows]
    return {"sets": overlap.block_of(values[entry], sizes[rows]), "turn": turn[rows], "place": place} | {
        name: table[name].combine_chunks().take(pa.array(rows)) for name in ("key", "shown", "at")}


def _packed(block: dict) -> dict:
    """A block as the values of one row."""
    sizes, words, codes = block["sets"]
    steps, wide = overlap.pack(codes, sizes)
    whole = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
    raw = lambda values, kind: pa.array([np.ascontiguousarray(values, dtype=kind).tobytes()], pa.binary())
    return {name: whole(block[name]) for name in ("key", "shown", "at")} | {
        "turn": raw(block["turn"], np.int32), "place": raw(block["place"], np.int32), "sizes": raw(sizes, np.int32),
        "words": raw(words, np.int64), "steps": raw(steps, np.uint8), "wide": raw(wide, np.int32)}


def _unpacked(table: pa.Table, row: int) -> dict:
    raw = lambda name, kind: np.frombuffer(table[name][row].as_py(), dtype=kind)
    sizes = raw("sizes", np.int32).astype(np.int64)
    codes = overlap.unpack(raw("steps", np.uint8), raw("wide", np.int32), sizes)
    return {name: table[name][row].values for name in ("key", "shown", "at")} | {
        "sets": (sizes, raw("words", np.int64), codes), "turn": raw("turn", np.int32), "place": raw("place", np.int32)}


def _relations(a: dict, b: dict | None, threshold: int, limit: int, pool: int | None) -> pa.Table:
    """Count and best few of every case of two blocks among those of the other one, or inside one block."""
    both = [a] if b is None else [a, b]
    join = lambda name: np.concatenate([block[name] for block in both])
    column = lambda name: pa.concat_arrays([block[name] for block in both])
    turn, place, keys, shift = join("turn"), join("place"), column("key"), 0 if b is None else len(a["turn"])
    counts, best = np.zeros(len(turn), dtype=np.int64), (np.zeros(0, dtype=np.int64),) * 3
    for l, r, score in overlap.near_pairs(a["sets"], None if b is None else b["sets"], threshold):
        r = r + shift
        apart = pc.fill_null(pc.not_equal(keys.take(pa.array(l)), keys.take(pa.array(r))), False).to_numpy(zero_copy_only=False)
        l, r, score = l[apart], r[apart], score[apart]
        asker, other, score = np.concatenate([l, r]), np.concatenate([r, l]), np.concatenate([score, score])
        if pool is not None:
            seen = place[other] <= pool + (place[asker] <= pool)
            asker, other, score = asker[seen], other[seen], score[seen]
        counts += np.bincount(asker, minlength=len(turn))
        best = _best_few(*(np.concatenate(part) for part in zip(best, (asker, other, score))), turn, limit)
    asker, other, score = best
    found = np.flatnonzero(counts)
    offsets = np.append(np.searchsorted(asker, found, "left"), len(asker)).astype(np.int32)
    others = pa.array(other)
    entries = pa.StructArray.from_arrays([pa.array(-score, pa.int32()), column("at").take(others), column("shown").take(others)], names=["score", "at", "case_id"])
    pa.default_memory_pool().release_unused()  # the worker process lives on
    return pa.table({"key": keys.take(pa.array(found)), "n": pa.array(counts[found]), "best": pa.ListArray.from_arrays(pa.array(offsets), entries)})


def related_cases(cases: DataFrame, identity: str = "identity", text: str = "text", created: str = "created_at", key: str = "case_id", pool: int | None = None,
                  threshold: int = fixed.RELATED_THRESHOLD, limit: int = fixed.RELATED_LIMIT, block: int = RELATED_BLOCK) -> DataFrame:
    """Same-applicant history of every case: similar_count and the best ``limit``.

    Cases of one applicant meet in blocks of at most about ``block`` rows each, so an
    applicant with many cases is spread over many tasks; two blocks meet once, for both sides.
    A block is packed once, to a row in the shared folder, with about a quarter of its words'
    bytes. Pairs of blocks meet in rounds: a round ships about ``RELATED_COPIES`` copies of each
    block at most, and what it found is merged into one row per case before the next begins, so
    that disk grows with the cases and not with the pairs.
    A task returns counts and its best few per case, never pairs (see ``functions.overlap``).
    Words travel as 64-bit hashes: among a million words of one applicant two are
    taken for one with a probability of 3 in 100 million. ``pool`` compares only with that many
    newest *other* cases of the whole table, as an interactive screen may want.

    Returns (key, history_scope, similar_count, related array<struct<case_id, score>>);
    equal scores list the older case first, then the smaller id as text.
    """
    c = F.col
    named = F.coalesce(c(identity) != "", F.lit(False))
    lean = cases.select(c(key).alias("key"), c(identity).alias("identity"), c(created).alias("at"), c(text).alias("text"))
    mine = lean.where(F.coalesce(c("identity") != "", F.lit(False)))
    chars = F.ceil(F.sum(F.coalesce(F.length("text"), F.lit(0))) / F.lit(RELATED_CHARS))
    # A middling applicant is cut finer than memory asks for, so that all cores have work.
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), chars, F.least(F.lit(8), F.ceil(F.count("*") / F.lit(RELATED_FEW)))).cast("int")
    hot = settle(mine.groupBy("identity").agg(blocks.alias("blocks")).where("blocks > 1"))
    total = hot.agg(F.sum("blocks").alias("blocks"), F.sum(c("blocks").cast("long") * c("blocks")).alias("copies")).first()
    if pool is not None:
        newest = lean.orderBy(F.desc("at"), "key").limit(pool + 1).select("key", F.row_number().over(W.orderBy(F.desc("at"), "key")).alias("place"))
        mine = mine.join(F.broadcast(newest), "key", "left")
    else:
        mine = mine.withColumn("place", F.lit(None).cast("int"))
    mine = mine.join(lookup(hot), "identity", "left") if total.blocks else mine.withColumn("blocks", F.lit(None).cast("int"))

    kind, when = (cases.schema[name].dataType.simpleString() for name in (key, created))
    told = f"key {kind}, n long, best array<struct<score:int,at:{when},case_id:string>>"
    row = ["identity", F.pmod(F.xxhash64("key"), c("blocks")).cast("int").alias("block"), "key", c("key").cast("string").alias("shown"), "at", "place",
           F.transform(similarity_tokens(c("text")), lambda w: F.xxhash64(w)).alias("tokens")]

    def alone(table: pa.Table) -> pa.Table:
        return _relations(_case_block(table), None, threshold, limit, pool)

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"identity": table["identity"][:1], "block": table["block"][:1]} | _packed(_case_block(table)))

    def meet(table: pa.Table) -> pa.Table:
        a, b = _unpacked(table, 0), _unpacked(table, 1) if table.num_rows > 1 else None
        if b is None and table["i"][0] != table["j"][0]:
            a = {name: column[:0] for name, column in a.items()} | {"sets": overlap.NONE}  # no row was hashed into the other block
        return _relations(a, b, threshold, limit, pool)

    def merged(met: DataFrame) -> DataFrame:
        return met.groupBy("key").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, limit).alias("best"))

    met = mine.where(c("blocks").isNull()).select(*row).drop("block").groupBy("identity").applyInArrow(alone, told)
    if total.blocks:
        form = (f"identity {cases.schema[identity].dataType.simpleString()}, block int, key array<{kind}>, shown array<string>, at array<{when}>, "
                "turn binary, place binary, sizes binary, words binary, steps binary, wide binary")
        packed, _ = written(mine.where(c("blocks").isNotNull()).select(*row).groupBy("identity", "block").applyInArrow(pack, form), "case-blocks")
        rounds = -(-total.copies // (RELATED_COPIES * total.blocks))
        tasks = min(4096, 4 * -(-total.copies // (2 * rounds)))
        pairs = hot.select("identity", "blocks", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("i")).select(
            "identity", "i", F.explode(F.sequence("i", c("blocks") - 1)).alias("j"))
        before = None
        for n in range(rounds):
            asked = pairs.where(F.pmod(F.xxhash64("identity", "i", "j"), F.lit(rounds)) == n).withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
            part = packed.join(lookup(asked), ["identity", "block"]).repartition(tasks, "identity", "i", "j").groupBy("identity", "i", "j").applyInArrow(meet, told)
            met = met.unionByName(part)
            if n < rounds - 1:
                met, path = written(merged(met), "related-cases")
                if before:
                    discard(cases.sparkSession, before)
                before = path
    out = cases.select(key, named.alias("_named")).join(merged(met).withColumnRenamed("key", key), key, "left")
    return out.select(
        key, F.when(c("_named"), "same_validated_applicant").otherwise("unavailable").alias("history_scope"), F.coalesce("n", F.lit(0)).cast("int").alias("similar_count"),
        F.coalesce(F.transform("best", lambda b: F.struct(b["case_id"].alias("case_id"), (-b["score"]).alias("score"))), F.array().cast("array<struct<case_id:string,score:int>>")).alias("related"))


# --- display measures -------------------------------------------------------

def relative_age(then: Column, now: Column) -> Column:
    """Waiting time the way an operator reads it; half-up rounding at every unit."""
    seconds = F.expr("0.0D") + (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6
    minutes = F.greatest(F.lit(0.0), F.floor(seconds / 60 + 0.5).cast("double"))
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    unit = lambda n, word: F.concat(n.cast("bigint").cast("string"), F.lit(f" {word}"))
    return (
        F.when(then.isNull(), "—").when(minutes < 1, "az önce").when(minutes < 60, unit(minutes, "dk"))
        .when(hours < 24, unit(hours, "sa")).otherwise(unit(days, "gün")))


def confidence_tone(value: Column) -> Column:
    return F.when(value.isNull(), "none").when(value > 0.8, "high").when(value >= 0.5, "mid").otherwise("low")


def initials(name: Column) -> Column:
    parts = F.filter(F.split(strip(F.coalesce(name, F.lit(""))), r"(?U)\s+", -1), lambda p: p != "")
    first = F.transform(F.slice(parts, 1, 2), lambda p: F.upper(F.replace(F.substring(p, 1, 1), F.lit("i"), F.lit("İ"))))
    return F.when(F.size(parts) == 0, "?").otherwise(F.array_join(first, ""))


def label(value: Column, labels: dict[str, str], default: str | None = None) -> Column:
    known = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(F.coalesce(F.try_element_at(known, value), value))


def queue_measures(rows: DataFrame, now: Column, created: str = "created_at", confidence: str = "confidence", name: str = "applicant_name",
                   channel: str = "channel", language: str = "language") -> DataFrame:
    c = F.col
    return (rows.withColumn("age", relative_age(c(created), now)).withColumn("tone", confidence_tone(c(confidence))).withColumn("initials", initials(c(name)))
            .withColumn("channel_label", label(c(channel), fixed.CHANNEL_LABELS))
            .withColumn("language_label", label(c(language), fixed.LANGUAGE_LABELS, fixed.LANGUAGE_LABELS["unknown"])))


VIEW_SOURCES = {
    # output: which of document, queue row and local record may supply it, in order
    "title": "drl", "document_id": "drl", "created_at": "drl", "channel": "dr", "language": "drl", "applicant_name": "r",
    "request_type_label": "rl", "department_label": "rl", "unit_label": "rl", "confidence": "rl", "reason": "rl",
    "classifier_version": "l", "taxonomy_version": "l", "source_type": "dl", "text": "dl",
}
DEFAULT_VIEW_TITLE = "Case detayı"


def case_view(documents: DataFrame, rows: DataFrame, local: DataFrame) -> DataFrame:
    """Detail view: server document before queue row before local record."""
    d, r, l = documents.alias("d"), rows.alias("r"), local.alias("l")
    base = r.join(d, F.col("d.case_id") == F.col("r.case_id"), "full_outer")
    case = F.coalesce(F.col("d.case_id"), F.col("r.case_id"))
    joined = base.join(l, F.col("l.case_id") == case, "full_outer")
    sides = {"d": documents, "r": rows, "l": local}
    out = []
    for name, order in VIEW_SOURCES.items():
        found = [F.col(f"{s}.{name}") for s in order if name in sides[s].columns]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        out.append((F.coalesce(value, F.lit(DEFAULT_VIEW_TITLE)) if name == "title" else value).alias(name))
    origin = F.when(F.col("d.case_id").isNotNull(), "server").when(F.coalesce(F.col("l.text"), F.lit("")) != "", "local")
    return joined.select(F.coalesce("d.case_id", "r.case_id", "l.case_id").alias("case_id"), *out, origin.alias("text_origin"))


def _percent(value: Column) -> Column:
    return F.concat(F.lit("%"), F.floor(value * 100 + 0.5).cast("bigint").cast("string"))


def explain_cases(df: DataFrame) -> DataFrame:
    """Routing confidence, behaviour summary and assignment strategy in words.

    Columns: routing_status, route_kind, confidence, target_unit_label,
    assignment_status, display_name, role, open_assignment_count, policy,
    staff_topic_resolution_rate, reason_score/level/repeat (assignment reason) and
    signal_score/level/repeat (text signal).
    """
    c = F.col
    routed = F.coalesce(c("routing_status") == "routed", F.lit(False))
    fallback = F.coalesce(c("route_kind") == "fallback", F.lit(False))
    confidence = (F.when(~routed, "Bekliyor").when(fallback, "%0").when(c("confidence").isNull(), "—").otherwise(_percent(c("confidence"))))
    detail = (F.when(~routed, "Hedef birim henüz kesinleşmedi").when(fallback, "Fallback rota · insan incelemesi")
              .when(c("confidence").isNull(), "F-02 skoru yayımlanmadı").otherwise(F.concat(F.lit("F-02 skoru · "), c("target_unit_label"))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("reason_score", "signal_score", F.lit(0.0))))
    level = F.coalesce("reason_level", "signal_level", F.lit("normal"))
    repeat = F.coalesce("reason_repeat", "signal_repeat", F.lit(0))
    behavior = (
        F.when(level == "high", "Yüksek dil sinyali algılandı; atama uzman çözüm oranına göre önceliklendirildi.")
        .when(level == "elevated", "Yükseltilmiş dil sinyali algılandı; atama uzman çözüm oranına göre desteklendi.")
        .when(repeat >= fixed.REPEAT_TRIGGER, F.concat(repeat.cast("string"), F.lit(". aynı konu sinyali algılandı; konu deneyimi yüksek personele öncelik verildi.")))
        .otherwise("Agresiflik sinyali normal düzeyde; atama açık dosya yüküne göre yapıldı."))
    waiting = c("assignment_status").isNull() | (c("assignment_status") == "unassigned")
    role = F.when(c("role") == "moderator", "Moderatör").when(c("role") == "admin", "Yönetici").otherwise("Operatör")
    strategy = F.when((c("policy") == "topic_resolution_rate") & c("staff_topic_resolution_rate").isNotNull(),
                      F.concat(F.lit("konu çözüm oranı "), _percent(c("staff_topic_resolution_rate")))).otherwise("açık dosya yükü dengesi")
    signals = F.array_compact(F.array(
        F.when(c("reason_repeat") >= fixed.REPEAT_TRIGGER, F.concat(c("reason_repeat").cast("string"), F.lit(". aynı konu"))),
        F.when(c("reason_level") != "normal", F.concat(F.lit("agresiflik: "), c("reason_level"),
                                                      F.coalesce(F.concat(F.lit(" ("), _percent(c("reason_score")), F.lit(")")), F.lit(""))))))
    assignment = F.when(waiting, "Aktif personel bulunamadı").otherwise(F.array_join(F.concat(
        F.array(role, F.concat(c("open_assignment_count").cast("string"), F.lit(" açık dosya")), strategy), signals), " · "))
    return (df.withColumn("routing_confidence", confidence).withColumn("routing_detail", detail).withColumn("behavior_level", level)
            .withColumn("behavior_score", score).withColumn("behavior_repeat", repeat).withColumn("behavior_detail", behavior)
            .withColumn("assignment_label", F.when(waiting, "Bekliyor").otherwise(F.coalesce("display_name", F.lit("Atandı"))))
            .withColumn("assignment_detail", assignment))
