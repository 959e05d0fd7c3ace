"""Intake: normalise, gate, de-duplicate, detect language, title, pending scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import once, spread_join
from docketry.functions.text import casefold, collapse_spaces, normalize_text, strip
from docketry.sources import fixed


def normalize(df: DataFrame, text: str = "text", out: str = "normalized_text") -> DataFrame:
    return once(df, **{out: normalize_text(F.col(text))})


def accepted_length(col: Column, minimum: int = fixed.MIN_TEXT_CHARACTERS) -> Column:
    """Code points, not bytes; white space alone does not count as text."""
    return F.regexp_like(col, F.lit(r"(?U)\S")) & (F.length(col) >= minimum)


def length_gate(df: DataFrame, text: str = "normalized_text", minimum: int = fixed.MIN_TEXT_CHARACTERS) -> DataFrame:
    return df.where(accepted_length(F.col(text), minimum))


def text_issues(col: Column, minimum: int = fixed.MIN_TEXT_CHARACTERS, maximum: int = fixed.MAX_TEXT_CHARACTERS) -> Column:
    """Quality findings of a text; an empty text reports nothing else."""
    size = F.length(collapse_spaces(col))
    findings = F.array_compact(F.array(
        F.when(size < minimum, "below_minimum"),
        F.when(size > maximum, "above_maximum"),
        F.when(~F.regexp_like(col, F.lit("[A-Za-z]{3,}")), "no_words"),
    ))
    return F.when(size == 0, F.array(F.lit("empty"))).otherwise(findings)


INTAKE_FACTS = ("source_type", "original_text", "normalized_text", "source_metadata", "correlation_id")


def intake_fingerprint(facts: tuple[str, ...] = INTAKE_FACTS) -> Column:
    return F.sha2(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}), 256)


def ingest(arrivals: DataFrame, existing: DataFrame | None = None, facts: tuple[str, ...] = INTAKE_FACTS,
           arrival: str = "arrival", **spread) -> DataFrame:
    """First record per document wins; equal later ones replay, others conflict.

    Records are compared by the SHA-256 of their facts, so only digests are
    aggregated. The first record is a map-side-combined ``min_by``, never a
    window over the copies of one id; hot ids are spread by ``spread_join``.
    """
    marked = arrivals.withColumn("_print", intake_fingerprint(facts))
    candidates = marked.select("document_id", F.struct(F.lit(1).alias("late"), F.col(arrival).alias("at")).alias("_at"), "_print")
    if existing is not None:
        stored = existing.select("document_id", F.struct(F.lit(0).alias("late"), F.lit(None).cast(arrivals.schema[arrival].dataType).alias("at")).alias("_at"),
                                 intake_fingerprint(facts).alias("_print"))
        candidates = candidates.unionByName(stored)
    first = candidates.groupBy("document_id").agg(F.min_by(F.struct("_at", "_print"), "_at").alias("_first"))
    joined = spread_join(marked, first, ["document_id"], arrival, **spread)
    outcome = (
        F.when((F.col("_first._at.late") == 1) & (F.col("_first._at.at") == F.col(arrival)), "accepted")
        .when(F.col("_first._print") == F.col("_print"), "replay").otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("_print", "_first")


def marker_tokens(text: Column) -> Column:
    tokens = F.filter(F.split(text, f"[^{fixed.TOKEN_CHARACTERS}]+", -1), lambda t: t != "")
    return F.transform(tokens, lambda t: casefold(F.replace(t, F.lit("İ"), F.lit("i"))))


def marker_scores(folded: Column, text: Column, markers: dict[str, tuple[str, ...]], orthography: str | None = "tr") -> Column:
    """array<struct<miss, language, score>> sorted best first, ties by code."""
    scores = []
    for language, words in markers.items():
        listed = list(words)
        hits = F.size(F.filter(folded, lambda t: t.isin(listed)))
        if language == orthography:
            spelled = f"(?<![{fixed.TOKEN_CHARACTERS}])(?![\\p{{Lu}}])[{fixed.TOKEN_CHARACTERS}]*?[{fixed.TURKISH_LETTERS}]"
            hits = hits + F.regexp_count(text, F.lit(spelled))
        scores.append(F.struct((-hits).alias("miss"), F.lit(language).alias("language"), hits.alias("score")))
    return F.array_sort(F.array(*scores))


def detect_language(df: DataFrame, text: str = "normalized_text", markers=fixed.LANGUAGE_MARKERS,
                    orthography: str | None = "tr", out: str = "language", keep_scores: bool = False) -> DataFrame:
    """Leading language by function words, "unknown" when the lead is too thin."""
    source = F.coalesce(F.col(text), F.lit(""))
    # One pass over all tokens keeps the function words; each language then counts few.
    known = sorted({w for words in markers.values() for w in words})
    tokens = once(df, _folded=F.filter(marker_tokens(source), lambda t: t.isin(known)))
    ranked = once(tokens, _ranked=marker_scores(F.col("_folded"), source, markers, orthography))
    lead, next_best = F.col("_ranked")[0], F.coalesce(F.get("_ranked", F.lit(1))["score"], F.lit(0))
    sure = (lead["score"] >= 1) & (lead["score"] >= fixed.MARKER_MARGIN * next_best)
    result = ranked.withColumn(out, F.when(sure, lead["language"]).otherwise("unknown"))
    if keep_scores:
        result = result.withColumn("lead_score", lead["score"]).withColumn("next_score", next_best)
    return result.drop("_folded", "_ranked")


def derive_title(text: Column, salutation: str = fixed.SALUTATION_PATTERN, default: str = fixed.DEFAULT_TITLE) -> Column:
    """First sentence of the first real line, at most 90 characters."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n", -1), strip), lambda line: line != "")
    body = F.filter(lines, lambda line: (F.length(line) > 24) & ~F.regexp_like(line, F.lit(salutation.replace("(?i)", "(?iu)"))))
    source = F.coalesce(F.get(body, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    sentence = F.get(F.split(source, r"(?U)(?<=[.!?])\s", 2), F.lit(0))
    short = F.when(F.length(sentence) > 90, F.concat(F.regexp_replace(F.substring(sentence, 1, 87), r"(?U)\s+$", ""), F.lit("…"))).otherwise(sentence)
    return F.when(short == "", default).otherwise(short)


def pending_documents(intake: DataFrame, decided: DataFrame, key: str = "document_id", age: str = "created_at") -> DataFrame:
    """Accepted documents without a current decision, oldest first."""
    return intake.join(decided.select(key), key, "left_anti").orderBy(age, key)
