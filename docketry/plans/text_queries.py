"""Queries over documents: intake, classification, rules, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.scale import shared_dir
from docketry.operators import classify as C, intake as I, rules as R, triage as T
from docketry.plans import bindings as B
from docketry.plans.registry import query, values
from docketry.sources.loaders import read_documents, table

NORMAL = B.SQL_NORMAL
KW = values("kw", "rt, lang, n, w", B.KEYWORDS)
CHAIN = values("chain", "rt, rl, unit_id, unit_label, department_id, department_label", B.CHAIN)


@query("intake_gate", rf"""
WITH {NORMAL}, sized AS (SELECT *, length(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS n FROM norm)
SELECT doc_id, CAST(length(t) AS BIGINT) AS characters, doc_id IN (SELECT doc_id FROM gated) AS accepted,
  CASE WHEN n = 0 THEN 'empty' ELSE concat_ws(',', CASE WHEN n < 40 THEN 'below_minimum' END, CASE WHEN n > 20000 THEN 'above_maximum' END,
  CASE WHEN NOT regexp_matches(t, '[A-Za-z]{{3,}}') THEN 'no_words' END) END AS issues FROM sized""")
def intake_gate(spark, folder):
    docs = B.normalized_documents(spark, folder).withColumnRenamed("normalized_text", "t")
    return docs.select("doc_id", F.length("t").cast("bigint").alias("characters"), I.accepted_length(F.col("t")).alias("accepted"),
                       F.concat_ws(",", I.text_issues(F.col("t"))).alias("issues"))


@query("document_records", """
SELECT 'd' || doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'text' END AS source_type, length(text) AS characters, md5(text) AS digest, lang AS language, source AS origin,
  CASE WHEN doc_id % 4 = 0 THEN 'k' || doc_id END AS correlation_id FROM documents""")
def document_records(spark, folder):
    """Documents written as document-input JSON lines and read back by the document source."""
    doc, path = F.col("doc_id"), shared_dir(spark, "document-input")
    key = doc.cast("string")
    table(spark, folder, "documents", spread="doc_id").select(
        F.lit("2.0").alias("schemaVersion"), F.concat(F.lit("r"), key).alias("requestId"), F.concat(F.lit("d"), key).alias("documentId"), F.when(doc % 3 == 0, "ocr").otherwise("text").alias("sourceType"), "text",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("sourceMetadata"), F.when(doc % 4 == 0, F.concat(F.lit("k"), key)).alias("correlationId")).write.json(path)
    read = read_documents(spark, path)
    return read.select(F.col("documentId").alias("document_id"), F.col("sourceType").alias("source_type"), F.length("text").cast("bigint").alias("characters"), F.md5("text").alias("digest"),
                       F.col("sourceMetadata")["lang"].alias("language"), F.col("sourceMetadata")["source"].alias("origin"), F.col("correlationId").alias("correlation_id"))


@query("intake_outcomes", """
WITH k AS (SELECT doc_id, md5(text) AS document_id, text, lang,
             CASE WHEN source IN ('src0','src1','src2','src3') THEN 'ocr' ELSE 'text' END AS source_type FROM documents),
f AS (SELECT *, first_value(source_type) OVER w AS fs, first_value(lang) OVER w AS fl, row_number() OVER w AS n
      FROM k WINDOW w AS (PARTITION BY document_id ORDER BY doc_id))
SELECT doc_id AS arrival, document_id, CASE WHEN n = 1 THEN 'accepted' WHEN fs = source_type AND fl IS NOT DISTINCT FROM lang THEN 'replay' ELSE 'conflict' END AS outcome FROM f""")
def intake_outcomes(spark, folder):
    """Copies of one text are re-submissions of one document."""
    docs = table(spark, folder, "documents")
    early = F.col("source").isin("src0", "src1", "src2", "src3")
    arrivals = docs.select(F.col("doc_id").alias("arrival"), F.md5("text").alias("document_id"), F.when(early, "ocr").otherwise("text").alias("source_type"),
                           F.col("lang").alias("source_metadata"), "text")
    return I.ingest(arrivals, facts=("source_type", "source_metadata", "text")).select("arrival", "document_id", "outcome")


_MARKER = values("markers", "code, word", [(c, w) for c, ws in B.LANGUAGE_MARKERS.items() for w in ws])


@query("language_scores", rf"""
WITH {NORMAL}, {_MARKER},
tok AS (SELECT doc_id, unnest(string_split_regex(t, '[^0-9A-Za-zÀ-ÿĞğİıŞşÇçÖöÜü]+')) AS w FROM norm),
s AS (SELECT d.doc_id, c.code, count(m.word) AS n FROM (SELECT doc_id FROM norm) d CROSS JOIN (SELECT DISTINCT code FROM markers) c
      LEFT JOIN tok ON tok.doc_id = d.doc_id LEFT JOIN markers m ON m.code = c.code AND m.word = replace(lower(tok.w), 'ß', 'ss') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS p FROM s),
two AS (SELECT a.doc_id, a.code, a.n AS lead_score, b.n AS next_score FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.p = 1 AND b.p = 2)
SELECT doc_id, CASE WHEN lead_score < 1 OR lead_score < 1.25 * next_score THEN 'unknown' ELSE code END AS language,
  CAST(lead_score AS BIGINT) AS lead_score, CAST(next_score AS BIGINT) AS next_score FROM two""")
def language_scores(spark, folder):
    docs = B.normalized_documents(spark, folder)
    found = I.detect_language(docs, markers=B.LANGUAGE_MARKERS, orthography=None, keep_scores=True)
    return found.select("doc_id", "language", F.col("lead_score").cast("bigint").alias("lead_score"), F.col("next_score").cast("bigint").alias("next_score"))


@query("doc_titles", r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
b AS (SELECT doc_id, coalesce(list_filter(ls, lambda x: length(x) > 24 AND NOT regexp_matches(x, '(?i)(başkanlığına|makamına|müdürlüğüne|başkanlığı''na)\s*,?\s*$'))[1], ls[1], '') AS src FROM l),
s AS (SELECT doc_id, CASE WHEN regexp_matches(src, '[.!?]\s') THEN regexp_extract(src, '^(?s)(.*?[.!?])\s', 1) ELSE src END AS sentence FROM b),
t AS (SELECT doc_id, CASE WHEN length(sentence) > 90 THEN regexp_replace(sentence[1:87], '\s+$', '') || '…' ELSE sentence END AS title FROM s)
SELECT doc_id, CASE WHEN title = '' THEN 'Vatandaş dilekçesi' ELSE title END AS title FROM t""")
def doc_titles(spark, folder):
    return table(spark, folder, "documents").select("doc_id", I.derive_title(F.col("text")).alias("title"))


@query("pending_documents", "SELECT d.doc_id, d.source, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_documents(spark, folder):
    """Documents nobody has judged yet; arrival order is the id."""
    docs, decided = table(spark, folder, "documents"), table(spark, folder, "labels")
    return I.pending_documents(docs.select("doc_id", "source", "n_chars"), decided, key="doc_id", age="doc_id")


@query("keyword_classify", rf"""
WITH {NORMAL}, {KW}, {CHAIN},
f AS (SELECT doc_id, {B.SQL_FOLD.format('t')} AS f FROM gated),
cov AS (SELECT f.doc_id, kw.rt, kw.lang, round_even(sum(CASE WHEN contains(f.f, kw.w) THEN 1 ELSE 0 END) / count(*), 3) AS s FROM f CROSS JOIN kw GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rt ORDER BY s DESC, lang DESC) AS r FROM cov),
win AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, rt) AS w FROM best WHERE r = 1)
SELECT doc_id, CASE WHEN s > 0.80 THEN 'classified' ELSE 'needs_review' END AS status, CASE WHEN s > 0 THEN win.rt END AS request_type_id,
  CASE WHEN s > 0 THEN unit_id END AS unit_id, CASE WHEN s > 0 THEN department_id END AS department_id, s AS confidence,
  CASE WHEN s > 0 THEN lang END AS keyword_language,
  CASE WHEN s = 0 THEN 'No taxonomy keyword matched' ELSE 'Best matching taxonomy chain selected from ' || lang || ' keywords' END AS reason
FROM win LEFT JOIN chain ON chain.rt = win.rt WHERE w = 1""")
def keyword_classify(spark, folder):
    out = C.classify_keyword(B.accepted_documents(spark, folder), B.sample_taxonomy(spark), is_nfc=True)
    return out.select("doc_id", "status", "request_type_id", "unit_id", "department_id", "confidence", "keyword_language", "reason")


_IMPLIED = [(t, lang, n, 0, w) for t, lang, n, w in B.KEYWORDS if t not in {s[0] for s in B.SIGNALS}]
_FORM_ROWS = [(t, lang, g, n, form, form.removesuffix("$"), form.endswith("$"), form.removesuffix("$").isalpha()) for t, lang, g, n, form in [*B.FORMS, *_IMPLIED]]
_FORM = values("forms", "rt, lang, g, n, form, raw, exact, alpha", _FORM_ROWS)


@query("signal_classify", rf"""
WITH {NORMAL}, {_FORM}, {CHAIN},
d AS (SELECT doc_id, {B.SQL_LOOSE.format('t')} AS f FROM gated),
tok AS (SELECT doc_id, f, list_distinct(regexp_extract_all(f, '[\p{{L}}\p{{Nl}}\p{{No}}]+')) AS ts FROM d),
probe AS (SELECT *, {B.SQL_LOOSE.format('raw')} AS needle FROM forms),
hit AS (SELECT tok.doc_id, rt, lang, g, min(n) AS n FROM tok CROSS JOIN probe
        WHERE CASE WHEN alpha THEN list_contains(ts, needle) OR (NOT exact AND length(needle) >= 4 AND len(list_filter(ts, lambda x: starts_with(x, needle))) > 0)
                   ELSE contains(f, needle) END GROUP BY 1, 2, 3, 4),
total AS (SELECT rt, lang, count(DISTINCT g) AS groups FROM forms GROUP BY 1, 2),
cov AS (SELECT h.doc_id, h.rt, h.lang, count(*) AS hits, string_agg(p.form, ', ' ORDER BY h.g) AS matched, least(3, any_value(t.groups)) AS needed
        FROM hit h JOIN probe p USING (rt, lang, g, n) JOIN total t ON t.rt = h.rt AND t.lang = h.lang GROUP BY 1, 2, 3),
sc AS (SELECT *, round_even(least(1.0, hits / needed), 3) AS s FROM cov),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rt ORDER BY s DESC, hits DESC, lang) AS r FROM sc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits / needed DESC, hits DESC, rt) AS p FROM best WHERE r = 1),
top AS (SELECT d.doc_id, a.rt, a.lang, a.s, a.hits, a.matched, a.needed, b.rt AS rt2, b.s AS s2 FROM d
        LEFT JOIN ranked a ON a.doc_id = d.doc_id AND a.p = 1 LEFT JOIN ranked b ON b.doc_id = d.doc_id AND b.p = 2)
SELECT doc_id, CASE WHEN s > 0.80 THEN 'classified' ELSE 'needs_review' END AS status, top.rt AS request_type_id, c.unit_id, c.department_id,
  coalesce(s, 0) AS confidence, coalesce(matched, '') AS matched, c2.rl AS runner_up_label, s2 AS runner_up_score,
  CASE WHEN s IS NULL THEN 'Metinde taksonomiye ait hiçbir konu sinyali bulunamadı; insan incelemesi gerekiyor.' ELSE
  'Gereken ' || needed || ' konu sinyalinden ' || hits || ' tanesi bulundu (' || lang || ' sinyal kümesi): ' || matched || '.'
  || CASE WHEN rt2 IS NOT NULL THEN ' En yakın alternatif: ' || c2.rl || ' (%' || CAST(round_even(s2 * 100, 0) AS INTEGER) || ').' ELSE '' END
  || CASE WHEN s > 0.80 THEN '' ELSE ' Güven eşiği aşılmadığı için sınıflandırma öneri olarak bırakıldı.' END END AS reason
FROM top LEFT JOIN chain c ON c.rt = top.rt LEFT JOIN chain c2 ON c2.rt = top.rt2""")
def signal_classify(spark, folder):
    out = C.classify(B.accepted_documents(spark, folder), B.sample_taxonomy(spark), "semantic-v3", is_nfc=True)
    return out.select("doc_id", "status", "request_type_id", "unit_id", "department_id", "confidence", F.array_join("matched", ", ").alias("matched"),
                      "runner_up_label", "runner_up_score", "reason")


@query("type_counts", rf"""
WITH {NORMAL}, {KW},
f AS (SELECT doc_id, {B.SQL_FOLD.format('t')} AS f FROM gated),
cov AS (SELECT f.doc_id, kw.rt, kw.lang, round_even(sum(CASE WHEN contains(f.f, kw.w) THEN 1 ELSE 0 END) / count(*), 3) AS s FROM f CROSS JOIN kw GROUP BY 1, 2, 3),
win AS (SELECT doc_id, rt, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, rt, lang DESC) AS w FROM cov)
SELECT CASE WHEN s > 0 THEN rt END AS request_type_id, CASE WHEN s > 0.80 THEN 'classified' ELSE 'needs_review' END AS status, count(*) AS documents,
  round(avg(s), 6) AS mean_confidence FROM win WHERE w = 1 GROUP BY 1, 2""")
def type_counts(spark, folder):
    """Documents per request type and status."""
    decided = C.classify(B.accepted_documents(spark, folder), B.sample_taxonomy(spark), "keyword-v2", is_nfc=True)
    return decided.groupBy("request_type_id", "status").agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


# --- rule baseline ----------------------------------------------------------

def _coverage_sql(words, text="lower(text)"):
    return "round_even((" + " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words) + f") / {len(words)}.0, 2)"


def _doc_type_sql(name, words):
    base = _coverage_sql(words)
    if name == B.SALUTATION[0]:
        return f"CASE WHEN starts_with(regexp_replace(lower(text), '^\\s+', ''), '{B.SALUTATION[1]}') THEN least(1.0, {base} + {B.SALUTATION[2]}) ELSE {base} END"
    bonus = dict(B.OPENING).get(name)
    return f"CASE WHEN contains(lower(text)[1:50], '{name}') THEN least(1.0, {base} + {bonus}) ELSE {base} END" if bonus else base


_TYPE_SCORES = "ts AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {n} AS o, '{name}' AS name, {_doc_type_sql(name, words)} AS s FROM documents" for n, (name, _g, words) in enumerate(B.DOCUMENT_RULES)) + "), " \
    "dt AS (SELECT doc_id, CASE WHEN s = 0 THEN 'petition' ELSE name END AS document_type, s AS document_type_score FROM ts " \
    "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) = 1)"
_RULE_ARGS = {"salutation": B.SALUTATION, "opening": B.OPENING}


@query("rule_document_type", f"WITH {_TYPE_SCORES} SELECT doc_id, document_type, round(document_type_score, 6) AS document_type_score FROM dt")
def rule_document_type(spark, folder):
    out = R.score_document_type(table(spark, folder, "documents", spread="doc_id").select("doc_id", "text"), "text", B.DOCUMENT_RULES, **_RULE_ARGS)
    return out.select("doc_id", "document_type", F.round("document_type_score", 6).alias("document_type_score"))


_DEP_SCORES = lambda text: " UNION ALL ".join(
    f"SELECT doc_id, {n} AS o, '{name}' AS name, {_coverage_sql(words, text)} AS s FROM src" for n, (name, words) in enumerate(B.DEPARTMENT_RULES))


@query("rule_department", f"""WITH src AS (SELECT doc_id, text FROM documents), ds AS ({_DEP_SCORES('lower(text)')})
SELECT doc_id, CASE WHEN s > 0 THEN name ELSE 'Genel Sekreterlik' END AS department, s AS department_score FROM ds QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) = 1""")
def rule_department(spark, folder):
    return R.find_department(table(spark, folder, "documents", spread="doc_id").select("doc_id", "text"), "text", B.DEPARTMENT_RULES).select("doc_id", "department", "department_score")


_GAPS = "CASE document_type " + " ".join(
    f"WHEN '{name}' THEN concat_ws(', ', " + ", ".join(
        f"CASE WHEN NOT regexp_matches(text, '{B.FIELD_PATTERNS[f]}') THEN '{f}' END" for f in B.REQUIRED_FIELDS[f"{name}_{group}"]) + ")"
    for name, group, _w in B.DOCUMENT_RULES) + " END"


@query("missing_fields", f"WITH {_TYPE_SCORES} SELECT dt.doc_id, document_type, {_GAPS} AS missing_fields FROM dt JOIN documents d ON d.doc_id = dt.doc_id")
def missing_fields(spark, folder):
    typed = R.score_document_type(table(spark, folder, "documents", spread="doc_id").select("doc_id", "text"), "text", B.DOCUMENT_RULES, **_RULE_ARGS)
    out = R.missing_by_pattern(typed, "text", "document_type", B.DOCUMENT_RULES, B.REQUIRED_FIELDS, B.FIELD_PATTERNS)
    return out.select("doc_id", "document_type", F.array_join("missing_fields", ", ").alias("missing_fields"))


_LAWS = "CASE " + " ".join(f"WHEN contains(lower(ctx), '{s}') THEN '{'; '.join(laws[:2])}'" for s, laws in B.LEGISLATION) + " ELSE 'Genel Kamu Yönetimi Kanunu' END"
_LETTER = "CASE " + " ".join(
    f"WHEN document_type = '{t}'" + (f" AND department = '{d}'" if d != "*" else "") + f" THEN '{l[0]}'" for t, d, l in sorted(B.LETTERS, key=lambda e: e[1] == "*")) + " ELSE 'Resmi Yazı' END"


@query("rule_analysis", rf"""
WITH {_TYPE_SCORES},
pur AS (SELECT doc_id, text, coalesce(list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], '') AS purpose FROM documents),
src AS (SELECT doc_id, purpose, purpose || ' ' || text AS text FROM pur), ds AS ({_DEP_SCORES('lower(text)')}),
dep AS (SELECT doc_id, CASE WHEN s > 0 THEN name ELSE 'Genel Sekreterlik' END AS department, s AS department_score FROM ds QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) = 1),
a AS (SELECT dt.doc_id, document_type, department, department_score, src.purpose, src.text AS ctx FROM dt JOIN dep USING (doc_id) JOIN src USING (doc_id)),
b AS (SELECT *, {_LAWS} AS legislation, {_LETTER} AS letter_type FROM a)
SELECT doc_id, document_type, department, department_score, purpose, legislation, letter_type,
  md5(concat_ws(chr(10), upper(letter_type), '', 'Sayı: [YAZIŞMA NUMARASI]', 'Tarih: [BUGÜNÜN TARİHİ]', '', department, '', 'Konu: ' || purpose, '', 'Sayın Müdür,', '',
  purpose || ' konusuyla ilgili başvuru incelemeye alınmıştır.', '', 'Gereğini rica ederim.', '', 'Saygılarımla,')) AS draft_digest FROM b""")
def rule_analysis(spark, folder):
    out = R.analyze_with_rules(table(spark, folder, "documents", spread="doc_id").select("doc_id", "text"), "text", B.DOCUMENT_RULES, B.DEPARTMENT_RULES, B.REQUIRED_FIELDS,
                               B.FIELD_PATTERNS, B.LEGISLATION, B.LETTERS, **_RULE_ARGS)
    return out.select("doc_id", "document_type", "department", "department_score", "purpose", F.array_join("legislation", "; ").alias("legislation"),
                      "letter_type", F.md5("draft").alias("draft_digest"))


# --- triage -----------------------------------------------------------------

_FIRST = " ".join(f"WHEN contains(f, '{p.translate(str.maketrans('ığüşöç', 'igusoc'))}') THEN {n}" for n, (_l, _s, p, _r) in enumerate(B.PRIORITY_RULES))


@query("priority_tag", f"""
WITH {values('rules', 'n, level, score, reason', [(n, l, s, r) for n, (l, s, _p, r) in enumerate(B.PRIORITY_RULES)])},
f AS (SELECT doc_id, translate(lower(text), 'ığüşöç', 'igusoc') AS f FROM documents), h AS (SELECT doc_id, CASE {_FIRST} END AS n FROM f)
SELECT doc_id, coalesce(level, 'normal') AS priority_level, coalesce(score, 40) AS priority_score, coalesce(reason, 'Öncelik sinyali bulunmadı') AS priority_reason
FROM h LEFT JOIN rules USING (n)""")
def priority_tag(spark, folder):
    folded = tuple((l, s, p.translate(str.maketrans("ığüşöç", "igusoc")), r) for l, s, p, r in B.PRIORITY_RULES)
    out = T.with_priority(table(spark, folder, "documents", spread="doc_id").select("doc_id", "text"), "text", folded)
    return out.select("doc_id", "priority_level", "priority_score", "priority_reason")


_W = r"[^\p{L}\p{N}_]"
_BEHAVIOR_ROWS = [(m, w, False) for m, w in B.BEHAVIOR] + [(m, w, True) for m, w in B.BEHAVIOR_EN]
_HITS = ", ".join(f"CASE WHEN regexp_matches(h, '(^|{_W}){m}{f'({_W}|$)' if ' ' in m else ''}')" + (" AND (lang IS NULL OR lang IN ('', 'unknown', 'en'))" if en else "")
                  + f" THEN CAST({w} AS DOUBLE) END" for m, w, en in _BEHAVIOR_ROWS)


@query("behavior_signals", rf"""
WITH f AS (SELECT doc_id, lang, {B.SQL_FOLD.format("replace(text, 'İ', 'i')")} AS h FROM documents),
l AS (SELECT doc_id, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS hits FROM f),
s AS (SELECT doc_id, len(hits) AS marker_count, least(1.0, coalesce(list_sum(hits), 0)) AS raw FROM l)
SELECT doc_id, round_even(raw, 3) AS aggression_score, CASE WHEN round(raw, 9) >= 0.7 THEN 'high' WHEN raw > 0 THEN 'elevated' ELSE 'normal' END AS aggression_level,
  CAST(marker_count AS BIGINT) AS marker_count, raw > 0 AS priority_mode FROM s""")
def behavior_signals(spark, folder):
    out = T.behavior_signals(table(spark, folder, "documents", spread="doc_id").select("doc_id", "text", "lang"), "text", "lang", markers=B.BEHAVIOR, english=B.BEHAVIOR_EN)
    return out.select("doc_id", "aggression_score", "aggression_level", F.col("marker_count").cast("bigint").alias("marker_count"), "priority_mode")


@query("conversation_signals", rf"""
WITH f AS (SELECT conv_id, turn, NULL AS lang, {B.SQL_FOLD.format("replace(text, 'İ', 'i')")} AS h FROM conversations),
l AS (SELECT conv_id, turn, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS hits FROM f),
s AS (SELECT conv_id, turn, least(1.0, coalesce(list_sum(hits), 0)) AS raw FROM l)
SELECT conv_id, count(*) AS turns, round(max(raw), 3) AS strongest, count(*) FILTER (WHERE round(raw, 9) >= 0.7) AS heated_turns FROM s GROUP BY 1""")
def conversation_signals(spark, folder):
    """Strongest behaviour signal of each conversation."""
    out = T.behavior_signals(table(spark, folder, "conversations").select("conv_id", "turn", "text"), "text", markers=B.BEHAVIOR, english=B.BEHAVIOR_EN)
    return out.groupBy("conv_id").agg(F.count("*").alias("turns"), F.round(F.max("aggression_score"), 3).alias("strongest"),
                                      F.count_if(F.col("aggression_level") == "high").alias("heated_turns"))
