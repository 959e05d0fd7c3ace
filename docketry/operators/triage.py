"""Priority rules and behaviour signals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import once
from docketry.functions.text import WORD, ascii_fold, marker_fold, round_half_even
from docketry.sources import fixed

# Control characters that mark where a word starts and ends.
_START, _END = "\u0001", "\u0002"


def priority(text: Column, rules=fixed.PRIORITY_RULES, default=fixed.DEFAULT_PRIORITY) -> Column:
    """struct<level, score, reason> of the first matching phrase."""
    folded = ascii_fold(text)
    entry = lambda level, score, reason: F.struct(F.lit(level).alias("level"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    chain = [F.when(F.contains(folded, F.lit(phrase)), entry(level, score, reason)) for level, score, phrase, reason in rules]
    return F.coalesce(*chain, entry(*default))


def with_priority(df: DataFrame, text: str = "text", rules=fixed.PRIORITY_RULES, default=fixed.DEFAULT_PRIORITY) -> DataFrame:
    return (once(df, _p=priority(F.col(text), rules, default))
            .withColumn("priority_level", F.col("_p.level")).withColumn("priority_score", F.col("_p.score"))
            .withColumn("priority_reason", F.col("_p.reason")).drop("_p"))


def _probe(marker: str) -> str:
    """The marker with word bounds written in; a single word may grow a suffix."""
    bounded = re.sub(r"\w+", lambda m: _START + m.group(0) + _END, marker)
    return bounded if " " in marker else bounded.removesuffix(_END)


def _markers(entries, english: bool) -> list[Column]:
    return [F.struct(F.lit(_probe(m)).alias("probe"), F.lit(float(w)).alias("weight"), F.lit(english).alias("english")) for m, w in entries]


def behavior_signals(df: DataFrame, text: str = "text", language: str | None = None, repeat: Column | None = None,
                     markers=fixed.BEHAVIOR_MARKERS, english=fixed.BEHAVIOR_MARKERS_EN) -> DataFrame:
    """Bounded, explainable behaviour signal per row.

    ``repeat`` is the number of cases of the same applicant and topic, this one
    included. One pass writes word bounds into the text, after which every
    marker is a plain substring search.
    """
    bounded = F.regexp_replace(marker_fold(F.coalesce(F.col(text), F.lit(""))), f"[{WORD}]+", f"{_START}$0{_END}")
    listed = F.array(*_markers(markers, False), *_markers(english, True))
    spoken = F.col(language) if language else F.lit(None).cast("string")
    reads_english = F.coalesce(spoken, F.lit("")).isin("", "unknown", "en")
    hits = F.filter(listed, lambda m: F.contains(F.col("_bounded"), m["probe"]) & (~m["english"] | F.col("_english")))
    scored = once(once(df, _bounded=bounded, _english=reads_english), _hits=hits)
    raw = F.least(F.lit(1.0), F.aggregate("_hits", F.lit(0.0), lambda acc, m: acc + m["weight"]))
    level = F.when(F.col("_raw") >= fixed.HIGH_BEHAVIOR, "high").when(F.col("_raw") > 0, "elevated").otherwise("normal")
    return (
        once(scored, _raw=raw)
        .withColumn("aggression_score", round_half_even(F.col("_raw"), 3))
        .withColumn("aggression_level", level)
        .withColumn("marker_count", F.size("_hits"))
        .withColumn("repeat_count", F.coalesce(repeat, F.lit(0)).cast("int") if repeat is not None else F.lit(0))
        .withColumn("priority_mode", (F.col("repeat_count") >= fixed.REPEAT_TRIGGER) | (F.col("aggression_level") != "normal"))
        .drop("_bounded", "_english", "_hits", "_raw")
    )
