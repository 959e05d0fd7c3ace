"""Taxonomy classification: keyword coverage and concept signals.

Both models score a document inside its own row. The lexicon arrives as a
bounded array (a scalar subquery), so a document is never exploded against the
forms and nothing is shuffled; token tests become substring searches on a
blank-separated token line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import once, packed_rows
from docketry.functions.text import LETTER, loose_fold, round_half_even, text_fold, token_line
from docketry.sources import fixed
from docketry.sources.loaders import attach_chain

LEXICON_ROWS = 20_000


def status_for_score(score: Column) -> Column:
    return F.when(score > fixed.CLASSIFIED_ABOVE, "classified").otherwise("needs_review")


def _concat(arrays: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), arrays)


def keyword_lexicon(tax: dict[str, DataFrame]) -> list[Column]:
    words = tax["keywords"].select("request_type_id", "language", text_fold(F.col("keyword")).alias("keyword"))
    lists = words.groupBy("request_type_id", "language").agg(F.array_sort(F.collect_list("keyword")).alias("forms"))
    types = lists.groupBy("request_type_id").agg(F.collect_list(F.struct("language", "forms")).alias("languages"))
    return packed_rows(types, ["request_type_id"], LEXICON_ROWS)


def classify_keyword(docs: DataFrame, tax: dict[str, DataFrame], text: str = "normalized_text", is_nfc: bool = False) -> DataFrame:
    """Matched keywords over list length; best language per type, best type per document.

    ``is_nfc``: the text went through intake normalisation already.
    """
    folded = once(docs, _folded=text_fold(F.col(text), is_nfc))
    lexicon = keyword_lexicon(tax)

    def best_language(entry: Column) -> Column:
        coverage = lambda lang: round_half_even(
            F.size(F.filter(lang["forms"], lambda form: F.contains(F.col("_folded"), form))) / F.size(lang["forms"]), 3)
        return F.array_max(F.transform(entry["languages"], lambda lang: F.struct(coverage(lang).alias("score"), lang["language"].alias("language"))))

    def scored(lexicon: Column) -> Column:
        with_best = F.transform(lexicon, lambda t: F.struct(t["request_type_id"].alias("id"), best_language(t).alias("best")))
        return F.transform(with_best, lambda t: F.struct((-t["best"]["score"]).alias("miss"), t["id"].alias("id"), t["best"]["language"].alias("language")))

    won = once(folded, _won=F.array_min(_concat([scored(part) for part in lexicon])))
    score = F.coalesce(-F.col("_won.miss"), F.lit(0.0))
    found = score > 0
    decided = (
        won.withColumn("confidence", F.when(found, score).otherwise(0.0))
        .withColumn("status", F.when(found, status_for_score(score)).otherwise("needs_review"))
        .withColumn("request_type_id", F.when(found, F.col("_won.id")))
        .withColumn("keyword_language", F.when(found, F.col("_won.language")))
        .drop("_folded", "_won")
    )
    reason = F.when(F.col("confidence") == 0, "No taxonomy keyword matched").otherwise(
        F.format_string("Best matching taxonomy chain selected from %s keywords", F.col("keyword_language")))
    return attach_chain(decided, tax, len(lexicon) == 1).withColumn("reason", reason).withColumn("classifier_version", F.lit(fixed.KEYWORD_CLASSIFIER_VERSION))


def signal_lexicon(tax: dict[str, DataFrame]) -> list[Column]:
    """Per type and language the ordered concept groups, each an ordered list of forms.

    ``probe`` is what to search: in the token line for alphabetic forms, in the
    folded text otherwise.
    """
    exact = F.endswith(F.col("form"), F.lit(fixed.EXACT_TOKEN_MARKER))
    needle = loose_fold(F.when(exact, F.expr(f"left(form, length(form) - {len(fixed.EXACT_TOKEN_MARKER)})")).otherwise(F.col("form")))
    alphabetic = F.regexp_like(F.col("needle"), F.lit(r"^\p{L}+$"))
    whole = F.col("exact") | (F.length("needle") < fixed.MIN_PREFIX_LENGTH)
    probe = F.when(alphabetic, F.concat(F.lit(" "), F.col("needle"), F.when(whole, " ").otherwise(""))).otherwise(F.col("needle"))
    # Needles keep their group even when blank, so group counts stay as listed.
    forms = tax["signals"].withColumn("exact", exact).withColumn("needle", F.coalesce(needle, F.lit(""))).select(
        "request_type_id", "language", "group_ord", F.struct(
            "form_ord", "form", alphabetic.alias("in_tokens"), probe.alias("probe"), (F.col("needle") != "").alias("usable")).alias("f"))
    groups = forms.groupBy("request_type_id", "language", "group_ord").agg(F.array_sort(F.collect_list("f")).alias("forms"))
    languages = groups.groupBy("request_type_id", "language").agg(F.array_sort(F.collect_list(F.struct("group_ord", "forms"))).alias("groups"))
    types = languages.groupBy("request_type_id").agg(F.array_sort(F.collect_list(F.struct("language", "groups"))).alias("languages"))
    labelled = types.join(tax["request_types"].select("request_type_id", "request_type_label"), "request_type_id")
    return packed_rows(labelled, ["request_type_id"], LEXICON_ROWS)


def signal_coverage(lexicon: Column, tokens: Column, folded: Column) -> Column:
    """array<struct<id, label, best>> with the best language of every type.

    ``best`` carries score, match count, matched forms, needed and listed groups.
    """
    def matched_forms(language: Column) -> Column:
        hit = lambda f: f["usable"] & F.when(f["in_tokens"], F.contains(tokens, f["probe"])).otherwise(F.contains(folded, f["probe"]))
        first = lambda group: F.get(F.filter(group["forms"], hit), F.lit(0))["form"]
        return F.array_compact(F.transform(language["groups"], first))

    def measured(language: Column) -> Column:
        return F.struct(language["language"].alias("language"), matched_forms(language).alias("matched"), F.size(language["groups"]).alias("total"))

    def rated(m: Column) -> Column:
        needed = F.greatest(F.least(F.lit(fixed.REQUIRED_SIGNALS), m["total"]), F.lit(1))
        score = round_half_even(F.least(F.lit(1.0), F.size(m["matched"]) / needed), 3)
        return F.struct((-score).alias("miss"), (-F.size(m["matched"])).alias("fewer"), m["language"].alias("language"),
                        m["matched"].alias("matched"), m["total"].alias("total"), needed.alias("needed"))

    # Strictly better wins over sorted languages, hence the smallest struct; a
    # type without any match keeps the default language and no groups.
    blank = F.struct(F.lit(0.0).alias("miss"), F.lit(0).alias("fewer"), F.lit(fixed.DEFAULT_KEYWORD_LANGUAGE).alias("language"),
                     F.array().cast("array<string>").alias("matched"), F.lit(0).alias("total"), F.lit(1).alias("needed"))

    def best(entry: Column) -> Column:
        top = F.array_min(F.transform(F.transform(entry["languages"], measured), rated))
        return F.when(top["fewer"] < 0, top).otherwise(blank)

    return F.transform(lexicon, lambda t: F.struct(t["request_type_id"].alias("id"), t["request_type_label"].alias("label"), best(t).alias("best")))


def rank_types(coverage: Column) -> Column:
    """Types by uncapped ratio, then matches, then id."""
    return F.array_sort(F.transform(coverage, lambda t: F.struct(
        (t["best"]["fewer"] / t["best"]["needed"]).alias("ratio"), t["best"]["fewer"].alias("fewer"), t["id"].alias("id"),
        t["label"].alias("label"), t["best"].alias("best"))))


def classify_semantic(docs: DataFrame, tax: dict[str, DataFrame], text: str = "normalized_text", is_nfc: bool = False) -> DataFrame:
    """Concept classification with its evidence: matched forms, runner-up, reason."""
    prepared = once(once(docs, _folded=loose_fold(F.col(text), is_nfc)), _tokens=token_line(F.col("_folded")))
    lexicon = signal_lexicon(tax)
    coverage = _concat([signal_coverage(part, F.col("_tokens"), F.col("_folded")) for part in lexicon])
    ranked = once(prepared, _ranked=rank_types(coverage))
    top = F.col("_ranked")[0]
    runner = F.get(F.filter(F.slice("_ranked", 2, 1_000_000), lambda t: t["best"]["miss"] < 0), F.lit(0))
    score = -top["best"]["miss"]
    found = score > 0
    decided = (
        ranked.withColumn("confidence", F.when(found, score).otherwise(0.0))
        .withColumn("status", F.when(found, status_for_score(score)).otherwise("needs_review"))
        .withColumn("request_type_id", F.when(found, top["id"]))
        .withColumn("keyword_language", F.when(found, top["best"]["language"]))
        .withColumn("matched", top["best"]["matched"])
        .withColumn("needed", top["best"]["needed"])
        .withColumn("runner_up_label", runner["label"])
        .withColumn("runner_up_score", -runner["best"]["miss"])
        .drop("_folded", "_tokens", "_ranked")
    )
    return attach_chain(decided, tax, len(lexicon) == 1).withColumn("reason", semantic_reason()).withColumn("classifier_version", F.lit(fixed.SIGNAL_CLASSIFIER_VERSION))


def semantic_reason() -> Column:
    detail = F.format_string(
        "Gereken %d konu sinyalinden %d tanesi bulundu (%s sinyal kümesi): %s.",
        F.col("needed"), F.size("matched"), F.col("keyword_language"),
        F.when(F.size("matched") > 0, F.array_join("matched", ", ")).otherwise("-"))
    runner = F.when(F.col("runner_up_label").isNotNull(), F.format_string(
        " En yakın alternatif: %s (%%%d).", F.col("runner_up_label"), round_half_even(F.col("runner_up_score") * 100).cast("int"))).otherwise("")
    weak = F.when(F.col("status") == "needs_review", " Güven eşiği aşılmadığı için sınıflandırma öneri olarak bırakıldı.").otherwise("")
    return F.when(F.col("confidence") == 0, "Metinde taksonomiye ait hiçbir konu sinyali bulunamadı; insan incelemesi gerekiyor.").otherwise(
        F.concat(detail, runner, weak))


def classify(docs: DataFrame, tax: dict[str, DataFrame], model: str = "semantic-v3", text: str = "normalized_text", is_nfc: bool = False) -> DataFrame:
    """The configured model's current classification row."""
    run = classify_keyword if model == "keyword-v2" else classify_semantic
    version = tax["request_types"].agg(F.max("taxonomy_version")).scalar()
    return run(docs, tax, text, is_nfc).withColumn("taxonomy_version", version)
