"""Draft guards, sentence helpers, letters and notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import once
from docketry.functions.text import let, strip
from docketry.operators.retrieval import greedy_match
from docketry.sources import fixed


def legal_claim(text: Column, patterns=fixed.LEGAL_CLAIM_PATTERNS) -> Column:
    """True when a text asserts law it has no source for."""
    return reduce(lambda a, b: a | b, [F.regexp_like(text, F.lit(p)) for p in patterns])


def draft_error(retrieved: Column, source_status: Column, patterns=fixed.LEGAL_CLAIM_PATTERNS) -> Column:
    """First broken rule of a draft row, null when it may be stored.

    Row columns: keys (array), document_summary, recommended_correspondence_type,
    correspondence_type_detail, draft_text, used_source_refs.
    """
    c = F.col
    allowed = F.array(*[F.lit(k) for k in (*fixed.DRAFT_REQUIRED, *fixed.DRAFT_OPTIONAL)])
    required = F.array(*[F.lit(k) for k in fixed.DRAFT_REQUIRED])
    shape = (F.size(F.array_except("keys", allowed)) > 0) | (F.size(F.array_except(required, c("keys"))) > 0)
    bad_text = lambda name, limit: ~F.coalesce((F.length(strip(c(name))) > 0) & (F.length(name) <= limit), F.lit(False))
    detail = c("correspondence_type_detail")
    bad_detail = detail.isNotNull() & ~((c("recommended_correspondence_type") == "other") & (F.length(strip(detail)) > 0) & (F.length(detail) <= fixed.MAX_TYPE_DETAIL))
    refs = c("used_source_refs")
    bad_refs = (refs.isNull() | (F.size(refs) > fixed.MAX_CITATIONS) | (F.size(F.array_distinct(refs)) != F.size(refs))
                | F.exists(refs, lambda r: r.isNull()) | (F.size(F.array_except(refs, retrieved)) > 0))
    sourced = source_status == "relevant_source_found"
    unsourced = source_status == "no_relevant_source"
    return (
        F.when(F.coalesce(shape, F.lit(True)), "schema_invalid")
        .when(bad_text("document_summary", fixed.MAX_SUMMARY), "document_summary_invalid")
        .when(bad_text("draft_text", fixed.MAX_DRAFT), "draft_text_invalid")
        .when(~F.coalesce(c("recommended_correspondence_type").isin(*fixed.CORRESPONDENCE_TYPES), F.lit(False)), "type_invalid")
        .when(F.coalesce(bad_detail, F.lit(False)), "type_detail_invalid")
        .when(F.coalesce(bad_refs, F.lit(True)), "refs_invalid")
        .when(sourced & (F.size(refs) == 0), "citation_required")
        .when(unsourced & ((F.size(refs) > 0) | (F.size(retrieved) > 0) | legal_claim(c("draft_text"), patterns)), "UNVERIFIED_LEGAL_CLAIM")
    )


def check_drafts(drafts: DataFrame, retrieved: str = "retrieved_refs", source_status: str = "source_status", **kw) -> DataFrame:
    return drafts.withColumn("error_code", draft_error(F.col(retrieved), F.col(source_status), **kw))


def repair_drafts(drafts: DataFrame, key_scores: DataFrame, type_scores: DataFrame, threshold: float = fixed.MIN_SIMILARITY, **kw) -> DataFrame:
    """Guard model answers; relabel the keys of those that miss the schema and guard again.

    drafts(draft_id, payload map<string,string>, retrieved_refs, source_status); list
    values of a payload are JSON arrays. key_scores(draft_id, target, key, score) and
    type_scores(draft_id, type_id, score) hold the similarities of a payload's keys and
    of its type label to the descriptions. Text is never invented: values move as they
    are, a missing summary takes whole sentences of ``sanitized_document``, and a legal
    claim without a source is final. Returns the drafts with lane and error_code.
    """
    c = F.col
    items = lambda v: F.from_json(v, "array<string>")
    value = lambda name: F.try_element_at(c("payload"), F.lit(name))
    strict = drafts.select(
        "*", F.map_keys("payload").alias("keys"), *[value(k).alias(k) for k in fixed.DRAFT_REQUIRED if k != "used_source_refs"],
        value("correspondence_type_detail").alias("correspondence_type_detail"), items(value("used_source_refs")).alias("used_source_refs"))
    judged = once(strict, error_code=draft_error(c("retrieved_refs"), c("source_status"), **kw))
    final = c("error_code").isNull() | (c("error_code") == "UNVERIFIED_LEGAL_CLAIM")
    good = judged.where(final).withColumn("lane", F.lit("strict"))
    failed = judged.where(~final).select("draft_id", "payload", "retrieved_refs", "source_status")
    wanted = key_scores.join(failed.select("draft_id"), "draft_id", "left_semi")
    matched = greedy_match(wanted, threshold, "draft_id").groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "key"))).alias("names"))
    # The first of equally similar types in the fixed order wins.
    order = F.map_from_arrays(F.array(*map(F.lit, fixed.CORRESPONDENCE_DESCRIPTIONS)), F.array(*map(F.lit, range(len(fixed.CORRESPONDENCE_DESCRIPTIONS)))))
    choice = type_scores.groupBy("draft_id").agg(F.max_by(F.struct("type_id", "score"), F.struct("score", (-F.try_element_at(order, "type_id")).alias("place"))).alias("choice"))
    told = failed.join(matched, "draft_id", "left").join(choice, "draft_id", "left")
    moved = lambda target: F.try_element_at(c("payload"), F.try_element_at(c("names"), F.lit(target)))
    recovered = sentence_prefix(F.try_element_at(c("payload"), F.lit("sanitized_document")), fixed.MAX_SUMMARY)
    summary = F.coalesce(moved("document_summary"), F.when(recovered != "", recovered))
    kind = moved("recommended_correspondence_type")
    mapped = F.when(kind.isNotNull() & ~kind.isin(*fixed.CORRESPONDENCE_TYPES) & (c("choice.score") >= threshold), c("choice.type_id")).otherwise(kind)
    repaired = told.select(
        "draft_id", "payload", "retrieved_refs", "source_status", summary.alias("document_summary"), mapped.alias("recommended_correspondence_type"), moved("draft_text").alias("draft_text"),
        value("correspondence_type_detail").alias("correspondence_type_detail"), items(moved("used_source_refs")).alias("used_source_refs"))
    present = F.array_compact(F.array(*[F.when(c(k).isNotNull(), F.lit(k)) for k in (*fixed.DRAFT_REQUIRED, *fixed.DRAFT_OPTIONAL)]))
    again = once(repaired.withColumn("keys", present), error_code=draft_error(c("retrieved_refs"), c("source_status"), **kw)).withColumn("lane", F.lit("repaired"))
    return good.unionByName(again).drop("payload", "keys")


def citations(context: Column, used: Column, keys=fixed.CITATION_KEYS) -> Column:
    """Retrieved chunks the draft really used, reduced to the citation keys."""
    return F.transform(F.filter(context, lambda c: F.array_contains(used, c["chunk_id"])), lambda c: F.struct(*[c[k].alias(k) for k in keys]))


def split_sentences(text: Column, lines: bool = False) -> Column:
    return F.split(strip(text), r"(?U)(?<=[.!?])\s+" + (r"|\n+" if lines else ""), -1)


def sentence_prefix(text: Column, maximum: int) -> Column:
    """Whole leading sentences within ``maximum`` characters; never cut inside one."""
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, sentence: Column) -> Column:
        size = F.length(acc["kept"]) + F.length(sentence) + F.when(acc["kept"] != "", 1).otherwise(0)
        stop = acc["full"] | (sentence == "") | (size > maximum)
        joined = F.when(acc["kept"] == "", sentence).otherwise(F.concat(acc["kept"], F.lit(" "), sentence))
        return F.struct(F.when(stop, acc["kept"]).otherwise(joined).alias("kept"), stop.alias("full"))

    return F.aggregate(split_sentences(text), start, step, lambda acc: acc["kept"])


def chunk_text(text: Column, maximum: int = fixed.CHUNK_CHARACTERS, block: int = 512) -> Column:
    """Sentence-bounded chunks; a single longer sentence is cut hard.

    A fold copies its whole state at every step, so the sentences are folded in runs of
    ``block``: a step copies the chunks of its own run, and all chunks only once per run.
    """
    sentences = F.filter(split_sentences(text, lines=True), lambda s: s != "")
    filled = lambda opened: F.filter(F.array(opened), lambda s: s != "")
    # Most joined texts have no blank end: looking at both ends is cheaper than a search through the text.
    ends = lambda joined: F.concat(F.substring(joined, 1, 1), F.substring(joined, -1, 1))
    trimmed = lambda joined: F.when(ends(joined).rlike(r"(?U)\s"), strip(joined)).otherwise(joined)
    cut = lambda sentence: F.regexp_extract_all(sentence, F.lit(f"(?s).{{1,{maximum}}}"), F.lit(0))
    state = lambda chunks, opened: F.struct(chunks.alias("chunks"), opened.alias("open"))
    none = F.array().cast("array<string>")

    def step(acc: Column, sentence: Column) -> Column:
        overflow = (acc["open"] != "") & (F.length(acc["open"]) + F.length(sentence) + 1 > maximum)
        joined = let(F.concat_ws(" ", F.when(acc["open"] != "", acc["open"]), sentence), trimmed)
        return (
            F.when(F.length(sentence) > maximum, state(F.concat(acc["chunks"], filled(acc["open"]), cut(sentence)), F.lit("")))
            .when(overflow, state(F.concat(acc["chunks"], filled(acc["open"])), sentence))
            .otherwise(state(acc["chunks"], joined)))

    def folded(found: Column) -> Column:
        run = lambda acc, n: F.aggregate(F.slice(found, n * block + 1, F.lit(block)), state(none, acc["open"]), step)
        add = lambda acc, n: let(run(acc, n), lambda r: state(F.concat(acc["chunks"], r["chunks"]), r["open"]))
        runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int"))
        return F.aggregate(runs, state(none, F.lit("")), add, lambda acc: F.concat(acc["chunks"], filled(acc["open"])))

    return let(sentences, lambda found: F.when(F.size(found) == 0, F.array(text)).otherwise(folded(found)))


# --- letters ----------------------------------------------------------------

def infer_letter_type(summary: Column, missing: Column, routing: Column) -> Column:
    text = F.lower(F.concat_ws(" ", summary, routing))
    has = lambda word: F.contains(text, F.lit(word))
    return (
        F.when(F.size(missing) > 0, "eksik_bilgi_talebi")
        .when(has("yönlendir"), "yönlendirme")
        .when(has("bilgilendirme") | has("duyuru") | (has("bilgi") & has("güncelleme")), "bilgilendirme")
        .when(has("üst yazı") | has("üst yazi") | (has("kurum") & has("gönder")), "üst_yazı")
        .otherwise("cevap"))


def letter_subject(summary: Column, document: Column) -> Column:
    base = F.when(F.length(strip(summary)) > 0, strip(summary)).otherwise(strip(document))
    cut = F.concat(F.regexp_replace(F.substring(base, 1, 117), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(base) > 120, cut).otherwise(base)


def render_letter(kind: Column, subject: Column, routing: Column, document: Column, missing: Column, bodies=fixed.LETTER_BODIES, excerpt: int | None = None) -> Column:
    """The whole document is quoted; ``excerpt`` quotes only that many characters."""
    listed = F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise("ilgili evrak için gerekli detaylar")
    extra = F.when(kind == "eksik_bilgi_talebi", listed).otherwise(strip(document if excerpt is None else F.substring(document, 1, excerpt)))
    opening = F.format_string(fixed.LETTER_OPENING, F.when(F.length(strip(routing)) > 0, strip(routing)).otherwise(fixed.DEFAULT_ROUTE_NAME))
    body = None
    for name, template in bodies.items():
        filled = F.format_string(template, subject, extra)
        body = F.when(kind == name, filled) if body is None else body.when(kind == name, filled)
    return F.concat(opening, body, F.lit(fixed.LETTER_CLOSING))


def generate_letters(df: DataFrame) -> DataFrame:
    """document, summary, routing, regulations[], missing_info[] -> letter or error."""
    listed = lambda name: F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), strip), lambda v: v != "")
    clean = df
    for name in ("document", "summary", "routing"):
        clean = clean.withColumn(name, strip(F.col(name)))
    clean = clean.withColumn("regulations", listed("regulations")).withColumn("missing_info", listed("missing_info"))
    error = F.coalesce(*[
        F.when(F.col(n).isNull(), f"{n} must be a string").when(F.col(n) == "", f"{n} must not be empty") for n in ("document", "summary", "routing")])
    ready = clean.withColumn("error", error)
    sound = F.col("error").isNull()
    typed = ready.withColumn("letter_type", F.when(sound, infer_letter_type(F.col("summary"), F.col("missing_info"), F.col("routing"))))
    titled = typed.withColumn("subject", F.when(sound, letter_subject(F.col("summary"), F.col("document"))))
    return (
        titled.withColumn("draft", F.when(sound, render_letter(F.col("letter_type"), F.col("subject"), F.col("routing"), F.col("document"), F.col("missing_info"))))
        .withColumn("references", F.when(sound, F.when(F.size("regulations") > 0, F.col("regulations")).otherwise(F.array(F.lit(fixed.DEFAULT_REFERENCE))))))


# --- notices ----------------------------------------------------------------

def output_language(audience: Column, language: Column) -> Column:
    """The applicant reads the document's language; everyone else the authority's."""
    return F.when((audience == "applicant") & language.isin("tr", "en"), language).otherwise(fixed.FALLBACK_LANGUAGE)


def draft_language(language: Column) -> Column:
    return F.when(language.isin("tr", "en"), language).otherwise(fixed.FALLBACK_LANGUAGE)


def notification_rows(routes: DataFrame, body: str = "body", context: str = "context", title: str | None = None) -> DataFrame:
    """Two audience rows per route; only the unit sees the allow-listed context.

    Rows with a blank or oversized title or body carry ``error`` instead of text.
    """
    rows = routes.withColumn("audience", F.explode(F.array(F.lit("applicant"), F.lit("target_unit"))))
    default_title = F.create_map(*[F.lit(v) for pair in fixed.NOTICE_TITLES.items() for v in pair])[F.col("audience")]
    written_title = strip(F.col(title)) if title else default_title
    written_body = strip(F.col(body))
    too_long = (F.length(written_title) > fixed.MAX_NOTICE_TITLE) | (F.length(written_body) > fixed.MAX_NOTICE_BODY)
    blank = (F.coalesce(F.length(written_title), F.lit(0)) == 0) | (F.coalesce(F.length(written_body), F.lit(0)) == 0)
    error = F.when(blank, "body_required").when(too_long, "bounds_exceeded")
    visible = F.map_filter(F.col(context), lambda k, _v: k.isin(*fixed.NOTICE_CONTEXT_KEYS))
    return (
        rows.withColumn("error", error).withColumn("notice_title", F.when(F.col("error").isNull(), written_title))
        .withColumn("notice_body", F.when(F.col("error").isNull(), written_body))
        .withColumn("case_context", F.when((F.col("audience") == "target_unit") & F.col("error").isNull(), visible)))
