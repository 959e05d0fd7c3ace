"""Field candidates, typed validation, evaluation and revisioned state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from docketry.functions.scale import lookup, once
from docketry.functions.text import let, nfc, nfc_suspect, strip
from docketry.sources import fixed

CANDIDATE = "struct<value:string,confidence:double>"
CANDIDATES = f"map<string,{CANDIDATE}>"


# --- candidates -------------------------------------------------------------

def _candidate(value: Column, confidence: float) -> Column:
    return F.struct(value.alias("value"), F.lit(confidence).cast("double").alias("confidence"))


def _present(entries: list[tuple[str, Column]], confidence: float) -> Column:
    """Map of the entries whose value was found."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), _candidate(v, confidence).alias("value")) for k, v in entries])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"]["value"].isNotNull()))


def rule_candidates(text: Column, patterns=fixed.RULE_FIELD_PATTERNS) -> Column:
    """First match per built-in pattern, confidence 1."""
    found = [(field, F.nullif(F.regexp_extract(text, p, group), F.lit(""))) for field, p, group in patterns]
    return _present(found, fixed.RULE_CONFIDENCE)


def merge_maps(low: Column, high: Column) -> Column:
    """Union of two maps; entries of ``high`` win."""
    kept = F.map_filter(low, lambda k, _v: ~F.array_contains(F.map_keys(high), k))
    return F.map_concat(kept, high)


def field_lists(registry: DataFrame) -> DataFrame:
    """One row per request type with its ordered definitions (at most eight)."""
    entry = F.struct("ord", "field_id", "label", "kind", "required")
    return registry.groupBy("request_type_id").agg(F.array_sort(F.collect_list(entry)).alias("definitions"))


def labeled_candidates(df: DataFrame, registry: DataFrame, text: str = "normalized_text", patterns=fixed.RULE_FIELD_PATTERNS) -> DataFrame:
    """``field-id: value`` lines of the row's request type, over rule matches."""
    joined = df.join(lookup(field_lists(registry)), "request_type_id", "left")
    # One pass lists every labelled line; the look-ahead keeps a line available
    # as a label of its own even when the label above it has an empty rest.
    labels = lambda group: F.regexp_extract_all(F.col(text), F.lit(r"(?umdU)^(?=([\w-]+)\s*:\s*(.+)$)"), F.lit(group))
    lined = once(joined, _lines=F.arrays_zip(F.transform(labels(1), lambda k: F.lower(k)).alias("key"), labels(2).alias("value")))
    found = F.transform("definitions", lambda d: F.struct(
        d["field_id"].alias("key"), F.get(F.filter("_lines", lambda line: line["key"] == d["field_id"]), F.lit(0))["value"].alias("raw")))
    kept = F.filter(found, lambda e: e["raw"].isNotNull())
    labeled = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), _candidate(strip(e["raw"]), fixed.LABEL_CONFIDENCE).alias("value"))))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{CANDIDATE}>"))
    layered = once(lined, _rules=rule_candidates(F.col(text), patterns), _labels=F.coalesce(labeled, nothing))
    return once(layered, candidates=merge_maps(F.col("_rules"), F.col("_labels"))).drop("_lines", "_rules", "_labels")


@F.pandas_udf(StringType())
def first_json_object(answers: pd.Series) -> pd.Series:
    """First decodable JSON object inside noisy text, re-serialised; null if none."""
    decoder = json.JSONDecoder()

    def read(text):
        start = text.find("{") if text else -1
        while start >= 0:
            try:
                value, _end = decoder.raw_decode(text, start)
                return json.dumps(value, ensure_ascii=False)
            except ValueError:
                start = text.find("{", start + 1)
        return None

    return answers.map(read)


def answer_candidates(df: DataFrame, registry: DataFrame, answer: str = "answer", text: str = "normalized_text",
                      patterns=fixed.RULE_FIELD_PATTERNS) -> DataFrame:
    """Candidates from a table of model answers.

    Only the free-form fields of the request type may occur and every value must
    be a string; otherwise the whole answer is refused (``answer_error``).
    """
    free = registry.where(~F.col("kind").isin(*fixed.ANSWER_EXCLUDED_KINDS))
    allowed = free.groupBy("request_type_id").agg(F.collect_set("field_id").alias("allowed"))
    parsed = df.withColumn("_json", first_json_object(F.col(answer))).join(lookup(allowed), "request_type_id", "left")
    values = F.from_json("_json", "map<string,variant>")
    parsed = once(parsed, _values=values)
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    keys_ok = F.size(F.array_except(F.map_keys("_values"), F.coalesce("allowed", F.array().cast("array<string>")))) == 0
    all_text = F.forall(F.map_values("_values"), lambda v: F.coalesce(is_text(v), F.lit(False)))
    usable = F.coalesce(F.col("_values").isNotNull() & keys_ok & all_text, F.lit(False))
    semantic = F.transform_values(
        F.from_json("_json", "map<string,string>"), lambda _k, v: _candidate(v, fixed.ANSWER_CONFIDENCE))
    return (parsed.withColumn("answer_error", F.when(~usable, "invalid_answer"))
            .withColumn("candidates", F.when(usable, merge_maps(rule_candidates(F.col(text), patterns), semantic)))
            .drop("_json", "_values", "allowed"))


# --- typed validation -------------------------------------------------------

def valid_tckn(value: Column) -> Column:
    digit = lambda i: F.substring(value, i, 1).try_cast("int")
    odd = digit(1) + digit(3) + digit(5) + digit(7) + digit(9)
    even = digit(2) + digit(4) + digit(6) + digit(8)
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == digit(10)
    eleventh = F.pmod(odd + even + digit(10), F.lit(10)) == digit(11)
    return F.coalesce(F.regexp_like(value, F.lit(r"^[1-9]\d{10}\z")) & tenth & eleventh, F.lit(False))


def compact_phone(value: Column) -> Column:
    return F.regexp_replace(value, r"[ ()-]", "")


def normalize_phone(value: Column) -> Column:
    """``+905#########`` or null."""
    local = lambda compact: F.when(F.startswith(compact, F.lit("+90")), F.substring(compact, 4, 10_000)).when(
        F.startswith(compact, F.lit("0")), F.substring(compact, 2, 10_000)).otherwise(compact)
    return let(let(compact_phone(value), local), lambda digits: F.when(F.regexp_like(digits, F.lit(r"^5\d{9}\z")), F.concat(F.lit("+90"), digits)))


def normalize_date(value: Column) -> Column:
    """ISO date of ``YYYY-MM-DD``, ``D.M.YYYY`` or ``YYYY.M.D``; null if impossible."""
    iso = F.when(F.regexp_like(value, F.lit(r"^\d{4}-\d{2}-\d{2}\z")), F.try_to_date(value, "yyyy-MM-dd"))
    return F.date_format(F.coalesce(iso, let(F.split(value, r"\.", -1), _dotted_date)), "yyyy-MM-dd")


def _dotted_date(parts: Column) -> Column:
    numeric = (F.size(parts) == 3) & F.forall(parts, lambda p: F.regexp_like(p, F.lit(r"^\s*\d{1,9}\s*\z")))
    number = lambda i: strip(F.get(parts, F.lit(i))).try_cast("int")
    year_first = F.length(F.get(parts, F.lit(0))) == 4
    year, day = F.when(year_first, number(0)).otherwise(number(2)), F.when(year_first, number(2)).otherwise(number(0))
    spelled = F.format_string("%04d-%02d-%02d", year, number(1), day)
    sane = numeric & (year >= 1) & F.regexp_like(spelled, F.lit(r"^\d{4}-\d{2}-\d{2}\z"))
    return F.when(sane, F.try_to_date(spelled, "yyyy-MM-dd"))


def validate_text(value: Column) -> Column:
    return (F.length(value) > 0) & (F.length(value) <= fixed.MAX_FREE_TEXT)


def validate_money(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"^[1-9]\d*\.\d{2}\z"))


def validate_attachments(metadata: Column) -> Column:
    """``absent``, ``present`` or ``attachment_missing`` for a JSON metadata string.

    Types are checked on the variant, because ``from_json`` would turn a wrong
    type silently into null.
    """
    listed = F.try_variant_get(F.try_parse_json(metadata), "$.attachments", "variant")
    kind = F.schema_of_variant(listed)
    items = F.try_variant_get(F.try_parse_json(metadata), "$.attachments", "array<variant>")

    def text_within(item: Column, key: str, low: int, high: int, required: bool, trim: bool) -> Column:
        raw = F.try_variant_get(item, f"$.{key}", "variant")
        text = F.try_variant_get(item, f"$.{key}", "string")
        sized = F.length(strip(text) if trim else text)
        fits = (F.schema_of_variant(raw) == "STRING") & sized.between(low, high)
        return F.coalesce(fits, F.lit(False)) if required else F.when(raw.isNull(), True).otherwise(F.coalesce(fits, F.lit(False)))

    def sound(item: Column) -> Column:
        content = F.try_variant_get(item, "$.contentType", "string")
        ascii_only = F.coalesce(F.regexp_like(content, F.lit(r"^[\x00-\x7F]*\z")), F.lit(True))
        return (F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))
                & text_within(item, "attachmentId", 1, 128, True, True)
                & text_within(item, "filename", 1, 255, False, True)
                & text_within(item, "contentType", 1, 127, False, False) & ascii_only)

    good = F.size(items).between(1, 64) & F.forall(items, sound)
    return F.when(listed.isNull() | (kind == "VOID"), "absent").when(
        F.coalesce(kind.startswith("ARRAY") & good, F.lit(False)), "present").otherwise("attachment_missing")


RESULT = "struct<value:string,error:string>"


def validate_value(kind: Column, raw: Column, metadata: Column) -> Column:
    """struct<value, error> of one typed value."""
    # Callers compose values (NFC) beforehand: lengths and comparisons count composed letters.
    ok = lambda v: F.struct(v.cast("string").alias("value"), F.lit(None).cast("string").alias("error"))
    bad = lambda code: F.struct(F.lit(None).cast("string").alias("value"), F.lit(code).alias("error"))
    found = lambda result, code: let(result, lambda r: F.when(r.isNotNull(), ok(r)).otherwise(bad(code)))
    files = lambda f: F.when(f == "absent", ok(F.lit(None))).when(f == "present", ok(f)).otherwise(bad("attachment_missing"))
    return F.when(raw.isNull(), bad("schema_rule")).otherwise(let(strip(raw), lambda value: (
        F.when(kind == "tckn", F.when(valid_tckn(value), ok(value)).otherwise(bad("tckn_checksum")))
        .when(kind == "phone-tr", found(normalize_phone(value), "phone_format"))
        .when(kind == "date", found(normalize_date(value), "date_format"))
        .when(kind == "attachment", let(validate_attachments(metadata), files))
        .when(~validate_text(value), bad("schema_rule"))
        .when((kind == "money-try") & ~validate_money(value), bad("money_format"))
        .otherwise(ok(value))
    )))


# --- evaluation -------------------------------------------------------------

def evaluate_fields(df: DataFrame, registry: DataFrame, candidates: str = "candidates", prior: str = "prior_fields",
                    metadata: str = "source_metadata") -> DataFrame:
    """Accepted, missing and invalid fields plus the completion status of each case.

    The definitions of a request type (at most eight) travel as an array with the
    case, so the evaluation is one row expression: no explode, no regrouping.
    """
    df = nfc_candidates(df, candidates)
    base = df if "definitions" in df.columns else df.join(lookup(field_lists(registry)), "request_type_id", "left")

    def judged(d: Column) -> Column:
        file = F.struct(F.lit("attachment").alias("value"), F.lit(1.0).alias("confidence"))
        offered = F.when(d["kind"] == "attachment", file).otherwise(F.try_element_at(F.col(candidates), d["field_id"]))
        checked = lambda o: F.when(o["value"].isNull(), F.lit(None).cast(RESULT)).otherwise(validate_value(d["kind"], o["value"], F.col(metadata)))
        both = let(offered, lambda o: F.struct(checked(o).alias("result"), F.coalesce(o["confidence"], F.lit(0.5)).alias("confidence")))
        return let(both, lambda b: F.struct(
            d["field_id"].alias("id"), d["label"].alias("label"), d["required"].alias("required"), b["result"]["value"].alias("value"),
            b["result"]["error"].alias("code"), b["confidence"].alias("confidence"), F.try_element_at(F.col(prior), d["field_id"]).alias("prior")))

    judged_df = once(base, _judged=F.transform("definitions", judged))
    taken = F.filter("_judged", lambda f: (f["code"].isNull() & f["value"].isNotNull()) | f["prior"].isNotNull())
    fresh = lambda f: f["code"].isNull() & f["value"].isNotNull()
    accepted = F.transform(taken, lambda f: F.struct(
        f["id"].alias("id"), f["label"].alias("label"), F.when(fresh(f), f["value"]).otherwise(f["prior"]["value"]).alias("value"),
        F.when(fresh(f), f["confidence"]).otherwise(f["prior"]["confidence"]).alias("confidence")))
    missing = F.transform(
        F.filter("_judged", lambda f: f["code"].isNull() & f["value"].isNull() & f["prior"].isNull() & f["required"]),
        lambda f: F.struct(f["id"].alias("id"), f["label"].alias("label")))
    invalid = F.transform(F.filter("_judged", lambda f: f["code"].isNotNull()),
                          lambda f: F.struct(f["id"].alias("id"), f["label"].alias("label"), f["code"].alias("code")))
    evaluated = judged_df.withColumn("extracted_fields", accepted).withColumn("missing_fields", missing).withColumn("invalid_fields", invalid)
    status = F.when(F.size("invalid_fields") > 0, "invalid_information").when(F.size("missing_fields") > 0, "missing_information").otherwise("complete")
    return (evaluated.withColumn("completion_status", status)
            .withColumn("user_action_required", F.col("completion_status") != "complete")
            .withColumn("accepted_fields", accepted_map(F.col("extracted_fields"))).drop("_judged", "definitions"))


def accepted_map(extracted: Column) -> Column:
    return F.map_from_entries(F.transform(extracted, lambda f: F.struct(
        f["id"].alias("key"), F.struct(f["value"].alias("value"), f["confidence"].alias("confidence")).alias("value"))))


def nfc_candidates(df: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Bring candidate values to NFC: one Arrow pass over the serialised map, to which
    only maps that may change are shipped."""
    written = F.to_json(candidates)
    return once(df, _text=written).withColumn(candidates, F.when(nfc_suspect(F.col("_text")), F.from_json(nfc(F.col("_text")), CANDIDATES)).otherwise(F.col(candidates))).drop("_text")


def eligible(classification: DataFrame, registry: DataFrame) -> DataFrame:
    """Classified documents whose type has a field schema."""
    types = registry.select("request_type_id").distinct()
    return classification.where("status = 'classified'").join(lookup(types), "request_type_id", "left_semi")


STATE_FACTS = ("accepted_fields", "missing_fields", "invalid_fields", "completion_status")


def state_fingerprint(side: str) -> Column:
    """Maps have no equality in Spark; compare sorted entries through a digest."""
    c = lambda name: F.col(f"{side}.{name}")
    facts = F.struct(F.array_sort(F.map_entries(c("accepted_fields"))).alias("accepted"), c("missing_fields").alias("missing"),
                     c("invalid_fields").alias("invalid"), c("completion_status").alias("status"))
    return F.sha2(F.to_json(facts, {"ignoreNullFields": "false"}), 256)


def merge_validation(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Next state per case: the revision moves only when something changed, and
    a change drops the link to the current generation."""
    p, n = prior.alias("p"), new.alias("n")
    joined = p.join(n, F.col("p.case_id") == F.col("n.case_id"), "full_outer")
    absent, untouched = F.col("p.case_id").isNull(), F.col("n.case_id").isNull()
    same = F.coalesce(state_fingerprint("p") == state_fingerprint("n"), F.lit(False))
    keep = untouched | (same & ~absent)
    pick = lambda c: F.when(keep, F.col(f"p.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    carried = [c for c in ("document_id", "request_type_id") if c in prior.columns and c in new.columns]
    return joined.select(
        F.coalesce("p.case_id", "n.case_id").alias("case_id"), *[pick(c) for c in carried], *[pick(c) for c in STATE_FACTS],
        F.when(keep, F.col("p.revision")).otherwise(F.coalesce(F.col("p.revision"), F.lit(0)) + 1).alias("revision"),
        F.when(keep, F.col("p.current_generation_id")).alias("current_generation_id"),
        F.when(keep, "unchanged").when(absent, "created").otherwise("changed").alias("outcome"))


# --- applicant answers ------------------------------------------------------

def supplement_value(kind: Column, value: Column) -> Column:
    trimmed = strip(value)
    dated = F.regexp_replace(trimmed, r"^(\d{4})-(\d{2})-(\d{2})$", "$3.$2.$1")
    return F.when(kind == "phone", compact_phone(trimmed)).when(kind == "date", dated).otherwise(F.regexp_replace(trimmed, r"(?U)\s+", " "))


def supplement_issue(kind: Column, label: Column, value: Column) -> Column:
    trimmed = strip(value)
    return (
        F.when(trimmed == "", F.concat(label, F.lit(" alanını doldurun.")))
        .when((kind == "tckn") & ~valid_tckn(trimmed), "T.C. Kimlik Numarası 11 haneli olmalı ve doğrulama sağlamasından geçmelidir.")
        .when((kind == "phone") & normalize_phone(trimmed).isNull(), "Cep telefonu 05XX XXX XX XX biçiminde olmalıdır.")
        .when((kind == "date") & ~F.regexp_like(trimmed, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(label, F.lit(" geçerli bir tarih olmalıdır.")))
    )
