"""Keyword-coverage rule baseline: document type, department, gaps, legislation, letter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import once
from docketry.functions.text import round_half_even, strip
from docketry.sources import fixed


def coverage(lowered: Column, keywords: tuple[str, ...]) -> Column:
    hits = reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(k.lower())).cast("int") for k in keywords])
    return round_half_even(hits / len(keywords), 2)


def _first_best(scores: list[tuple[str, Column]]) -> Column:
    """Best score; on ties the rule listed first."""
    return F.array_min(F.array(*[
        F.struct((-score).alias("miss"), F.lit(n).alias("ord"), F.lit(name).alias("name")) for n, (name, score) in enumerate(scores)]))


def document_type(text: Column, rules=fixed.DOCUMENT_TYPE_RULES, salutation=fixed.SALUTATION_BONUS, opening=fixed.OPENING_BONUS) -> Column:
    """struct<miss, ord, name>: ``-miss`` is the coverage score with its bonuses."""
    lowered = F.lower(text)
    greeted, word, bonus = salutation
    starts = F.startswith(F.regexp_replace(lowered, r"(?U)^\s+", ""), F.lit(word))
    head = F.substring(lowered, 1, fixed.OPENING_CHARACTERS)
    extra = dict(opening)
    scores = []
    for name, _group, keywords in rules:
        score = coverage(lowered, keywords)
        if name == greeted:
            score = F.when(starts, F.least(F.lit(1.0), score + bonus)).otherwise(score)
        if name in extra:
            score = F.when(F.contains(head, F.lit(name)), F.least(F.lit(1.0), score + extra[name])).otherwise(score)
        scores.append((name, score))
    return _first_best(scores)


def score_document_type(df: DataFrame, text: str = "text", rules=fixed.DOCUMENT_TYPE_RULES, default: str | None = None, **bonus) -> DataFrame:
    default = default or rules[0][0]
    blank = ~F.regexp_like(F.col(text), F.lit(r"(?U)\S"))
    scored = once(df, _t=document_type(F.col(text), rules, **bonus))
    none = blank | (F.col("_t.miss") == 0)
    return (scored.withColumn("document_type", F.when(none, default).otherwise(F.col("_t.name")))
            .withColumn("document_type_score", F.when(none, 0.0).otherwise(-F.col("_t.miss"))).drop("_t"))


def find_department(df: DataFrame, text: str = "text", rules=fixed.DEPARTMENT_RULES, default: str = fixed.DEFAULT_DEPARTMENT) -> DataFrame:
    lowered = F.lower(F.col(text))
    scored = once(df, _d=_first_best([(name, coverage(lowered, words)) for name, words in rules]))
    found = F.col("_d.miss") < 0
    return (scored.withColumn("department", F.when(found, F.col("_d.name")).otherwise(default))
            .withColumn("department_score", F.when(found, -F.col("_d.miss")).otherwise(0.0)).drop("_d"))


def _java(pattern: str) -> str:
    """Python's Unicode-aware classes and case folding, spelled for the JVM."""
    flags = ""
    if pattern.startswith("(?"):
        head, rest = pattern[2:].split(")", 1)
        if head.isalpha():
            flags, pattern = head, rest
    return f"(?{flags}{'u' if 'i' in flags else ''}U)" + pattern


def missing_by_pattern(df: DataFrame, text: str = "text", doc_type: str = "document_type", rules=fixed.DOCUMENT_TYPE_RULES,
                       required=fixed.REQUIRED_FIELD_TABLE, patterns=fixed.FIELD_PATTERNS) -> DataFrame:
    """Required fields of the document's type whose pattern is nowhere in the text."""
    branches = None
    for name, group, _words in rules:
        listed = required.get(f"{name}_{group}", ())
        gaps = F.array_compact(F.array(*[F.when(~F.regexp_like(F.col(text), F.lit(_java(patterns[f]))), f) for f in listed])) if listed else F.array().cast("array<string>")
        is_type = F.col(doc_type) == name
        branches = F.when(is_type, gaps) if branches is None else branches.when(is_type, gaps)
    return df.withColumn("missing_fields", F.coalesce(branches, F.array().cast("array<string>")))


def suggest_legislation(text: Column, table=fixed.LEGISLATION, default: str = fixed.DEFAULT_LEGISLATION) -> Column:
    lowered = F.lower(text)
    laws = [F.when(F.contains(lowered, F.lit(subject)), F.array(*map(F.lit, listed[:2]))) for subject, listed in table]
    return F.coalesce(*laws, F.array(F.lit(default)))


def select_letter_type(doc_type: Column, department: Column, table=fixed.LETTER_TYPES, default: str = fixed.DEFAULT_LETTER_TYPE) -> Column:
    """Exact (type, department), then (type, any department), then the default."""
    entries = [F.lit(v) for t, d, letters in table for v in (f"{t}|{d}", letters[0])]
    letters = F.create_map(*entries)
    return F.coalesce(F.try_element_at(letters, F.concat_ws("|", doc_type, department)),
                      F.try_element_at(letters, F.concat(doc_type, F.lit("|*"))), F.lit(default))


def purpose(text: Column, maximum: int | None = None) -> Column:
    """First non-blank sentence, whole or at most ``maximum`` characters of it."""
    parts = F.filter(F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\.", -1), strip), lambda p: p != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return first if maximum is None else F.substring(first, 1, maximum)


def analyze_with_rules(df: DataFrame, text: str = "text", doc_rules=fixed.DOCUMENT_TYPE_RULES, departments=fixed.DEPARTMENT_RULES,
                       required=fixed.REQUIRED_FIELD_TABLE, patterns=fixed.FIELD_PATTERNS, legislation=fixed.LEGISLATION,
                       letters=fixed.LETTER_TYPES, **bonus) -> DataFrame:
    """Type, purpose, department, gaps, legislation, letter type and draft in one projection."""
    typed = score_document_type(df, text, doc_rules, **bonus).withColumn("purpose", purpose(F.col(text)))
    typed = typed.withColumn("_context", F.concat_ws(" ", "purpose", text))
    routed = find_department(typed, "_context", departments)
    gaps = missing_by_pattern(routed, text, "document_type", doc_rules, required, patterns)
    full = (gaps.withColumn("legislation", suggest_legislation(F.col("_context"), legislation))
            .withColumn("letter_type", select_letter_type(F.col("document_type"), F.col("department"), letters)))
    draft = F.concat_ws(
        "\n", F.upper("letter_type"), F.lit(""), F.lit("Sayı: [YAZIŞMA NUMARASI]"), F.lit("Tarih: [BUGÜNÜN TARİHİ]"), F.lit(""),
        F.col("department"), F.lit(""), F.concat(F.lit("Konu: "), F.col("purpose")), F.lit(""), F.lit("Sayın Müdür,"), F.lit(""),
        F.concat(F.col("purpose"), F.lit(" konusuyla ilgili başvuru incelemeye alınmıştır.")), F.lit(""), F.lit("Gereğini rica ederim."),
        F.lit(""), F.lit("Saygılarımla,"))
    return full.withColumn("draft", draft).drop("_context")
