"""Redaction of personal data and the learning export built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.text import WORD, number_matches, nfc, quote_pattern, strip
from docketry.sources import fixed


def placeholder(field_id: Column, aliases=fixed.PLACEHOLDER_ALIASES) -> Column:
    known = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    name = F.coalesce(F.try_element_at(known, field_id), F.upper(F.replace(field_id, F.lit("-"), F.lit("_"))))
    return F.concat(F.lit("{{"), name, F.lit("}}"))


def _replace_known(text: Column, field_id: Column, value: Column) -> Column:
    """Exact value first, then the same words with any punctuation between them."""
    mark = placeholder(field_id)
    exact = F.regexp_replace(text, F.concat(F.lit("(?iu)"), quote_pattern(value)), mark)
    words = F.regexp_extract_all(value, F.lit(f"[{WORD}]+"), F.lit(0))
    tolerant = F.concat(F.lit("(?iu)"), F.array_join(words, rf"[^\p{{L}}\p{{N}}]*"))
    loose = F.when(F.size(words) > 0, F.regexp_replace(exact, tolerant, mark)).otherwise(exact)
    return F.when(F.coalesce(F.length(strip(value)), F.lit(0)) > 0, loose).otherwise(text)


def redact_known(text: Column, known: Column, handling=fixed.FIELD_HANDLING) -> Column:
    """Replace the values of ``known`` (ordered map field -> value) that policy redacts."""
    policy = F.create_map(*[F.lit(v) for pair in handling.items() for v in pair])
    redacted = F.filter(F.map_entries(known), lambda e: F.coalesce(F.try_element_at(policy, e["key"]), F.lit("redact")) == "redact")
    return F.aggregate(redacted, text, lambda acc, e: _replace_known(acc, e["key"], e["value"]))


def redact_residual(text: Column, patterns=fixed.RESIDUAL_PATTERNS) -> Column:
    """Numbered placeholders per pattern, patterns applied one after the other."""
    for label, pattern in patterns:
        text = number_matches(text, pattern, label)
    return text


def sanitize_text(text: Column, known: Column | None = None, handling=fixed.FIELD_HANDLING, patterns=fixed.RESIDUAL_PATTERNS) -> Column:
    source = nfc(text)
    if known is not None:
        source = redact_known(source, F.coalesce(known, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), handling)
    return redact_residual(source, patterns)


def known_values(fields: Column, handling=fixed.FIELD_HANDLING) -> Column:
    """Values that must be redacted, out of an accepted-fields map."""
    redacted = [k for k, v in handling.items() if v == "redact"]
    return F.transform_values(F.map_filter(fields, lambda k, v: k.isin(redacted) & v["value"].isNotNull()), lambda _k, v: v["value"])


def semantic_fields(fields: Column, handling=fixed.FIELD_HANDLING) -> Column:
    """Values a task needs, in field order."""
    needed = [k for k, v in handling.items() if v == "task_required"]
    return F.transform(F.filter(F.map_entries(fields), lambda e: e["key"].isin(needed) & e["value"]["value"].isNotNull()), lambda e: e["value"]["value"])


def sanitize_fields(fields: Column, handling=fixed.FIELD_HANDLING, patterns=fixed.RESIDUAL_PATTERNS) -> Column:
    """Excluded fields dropped, redacted ones replaced, task fields kept sanitised."""
    policy = F.create_map(*[F.lit(v) for pair in handling.items() for v in pair])
    treat = lambda k: F.coalesce(F.try_element_at(policy, k), F.lit("redact"))

    def cleaned(k: Column, v: Column) -> Column:
        value = v["value"]
        masked = F.when(treat(k) == "redact", _replace_known(value, k, value)).otherwise(value)
        return F.struct(redact_residual(masked, patterns).alias("value"), v["confidence"].alias("confidence"))

    return F.transform_values(F.map_filter(fields, lambda k, v: (treat(k) != "exclude") & v.isNotNull()), cleaned)


def learning_candidates(states: DataFrame, validation: DataFrame, intake: DataFrame, existing: DataFrame | None = None,
                        handling=fixed.FIELD_HANDLING, patterns=fixed.RESIDUAL_PATTERNS, maximum: int | None = None) -> DataFrame:
    """Completed, complete cases at their current revision as sanitised candidates.

    Texts stay whole; ``maximum`` cuts them (``fixed.MAX_LEARNING_CHARACTERS`` for a
    prompt). ``handling`` is a map or what ``loaders.policy_map`` makes of a policy table.
    """
    done = states.where("state = 'completed'").select("case_id", F.col("revision").alias("source_case_revision"))
    complete = validation.where("completion_status = 'complete'").select(
        "case_id", F.col("revision").alias("source_case_revision"), "document_id", "request_type_id", "accepted_fields")
    ready = done.join(complete, ["case_id", "source_case_revision"])
    if existing is not None:
        ready = ready.join(existing.select("case_id", "source_case_revision"), ["case_id", "source_case_revision"], "left_anti")
    full = ready.join(intake.select("document_id", "normalized_text"), "document_id")
    clean = sanitize_text(F.col("normalized_text"), known_values(F.col("accepted_fields"), handling), handling, patterns)
    return full.select(
        "case_id", "source_case_revision", "document_id", "request_type_id",
        (clean if maximum is None else F.substring(clean, 1, maximum)).alias("sanitized_text"),
        sanitize_fields(F.col("accepted_fields"), handling, patterns).alias("validated_fields"), F.lit("candidate").alias("status"))
