"""Queries over retrieval, redaction, drafts and letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.scale import shared_dir
from docketry.operators import drafts as D, privacy as P, retrieval as R
from docketry.plans import bindings as B
from docketry.plans.registry import query, values
from docketry.sources import fixed
from docketry.sources.loaders import load_policy, policy_map, table

_STOP = ", ".join(f"'{w}'" for w in B.STOPWORDS)
_WORDS = lambda text: (f"list_filter(regexp_extract_all(lower(replace(replace({text}, 'I', 'ı'), 'İ', 'i')), '[{B.CHARSET}]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))")


def _bm25_sql(queries: str, chunks: str) -> str:
    """raw(qid, cid, s): unnormalised scores; queries/chunks are CTEs with (qid|cid, text)."""
    return f"""
ct AS (SELECT cid, {_WORDS('text')} AS ws FROM {chunks}), cl AS (SELECT cid, len(ws) AS n FROM ct),
st AS (SELECT count(*) AS docs, avg(n) AS av FROM cl), tf AS (SELECT cid, w, count(*) AS f FROM (SELECT cid, unnest(ws) AS w FROM ct) GROUP BY 1, 2),
dfq AS (SELECT w, count(*) AS d FROM tf GROUP BY 1), qt AS (SELECT qid, w, count(*) AS m FROM (SELECT qid, unnest({_WORDS('text')}) AS w FROM {queries}) GROUP BY 1, 2),
raw AS (SELECT qid, tf.cid, sum(m * ln(1 + (docs - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n / av))) AS s
  FROM qt JOIN tf ON tf.w = qt.w JOIN dfq ON dfq.w = qt.w JOIN cl ON cl.cid = tf.cid CROSS JOIN st GROUP BY 1, 2)"""


@query("bm25_topk", f"""
WITH q AS (SELECT item_id AS qid, text FROM benchmark), c AS (SELECT doc_id AS cid, text FROM documents), {_bm25_sql('q', 'c')},
lex AS (SELECT qid, cid, s / max(s) OVER (PARTITION BY qid) AS l FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(l, 9) DESC, cid) AS rank FROM lex)
SELECT qid AS query_id, cid AS chunk_id, round(l, 6) AS lexical_score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")
def bm25_topk(spark, folder):
    """The five documents closest to every benchmark item by words."""
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = table(spark, folder, "documents", spread="doc_id").select(F.col("doc_id").alias("chunk_id"), "text")
    out = R.bm25_top_k(queries, chunks, 5, B.STOPWORDS, B.CHARSET)
    return out.select("query_id", "chunk_id", F.round("lexical_score", 6).alias("lexical_score"), F.col("rank").cast("bigint").alias("rank"))


@query("dense_topk", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
s AS (SELECT c.label AS qid, e.vec_id AS cid, sum(c.x * e.x) AS d FROM e JOIN c ON c.i = e.i GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9) DESC, cid) AS rank FROM s)
SELECT qid AS query_id, cid AS chunk_id, round(d, 5) AS dense_score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")
def dense_topk(spark, folder):
    """The five vectors closest to every label's mean vector."""
    vectors = table(spark, folder, "embeddings")
    spots = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = spots.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    queries = means.select(F.col("label").alias("query_id"), F.transform("p", lambda e: e["x"]).alias("embedding"))
    out = R.dense_top_k(queries, vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), 5)
    return out.select("query_id", "chunk_id", F.round("dense_score", 5).alias("dense_score"), F.col("rank").cast("bigint").alias("rank"))


def _cases_and_corpus(spark, folder):
    """Documents are the cases, benchmark items the corpus; both with their vector, if there is one."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    cases = table(spark, folder, "documents", spread="doc_id").select(F.col("doc_id").alias("vec_id"), "text").join(vectors, "vec_id", "left").withColumnRenamed("vec_id", "query_id")
    corpus = table(spark, folder, "benchmark").select(F.col("item_id").alias("vec_id"), "text").join(vectors, "vec_id", "left").withColumnRenamed("vec_id", "chunk_id")
    return cases, corpus


_GATE = 0.35
_FUSED = f"""
q AS (SELECT doc_id AS qid, text, embedding AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
c AS (SELECT item_id AS cid, text, embedding AS v FROM benchmark LEFT JOIN embeddings ON vec_id = item_id), {_bm25_sql('q', 'c')},
lex AS (SELECT qid, cid, s / max(s) OVER (PARTITION BY qid) AS l FROM raw),
p AS (SELECT qid, c.cid, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS d FROM q CROSS JOIN c),
b AS (SELECT p.*, coalesce(l, 0) AS l FROM p LEFT JOIN lex USING (qid, cid)),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9) DESC NULLS LAST, cid) AS rd, row_number() OVER (PARTITION BY qid ORDER BY round(l, 9) DESC, cid) AS rl FROM b),
f AS (SELECT * REPLACE (coalesce(d, 0.0) AS d), CASE WHEN d IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rd) END + CASE WHEN l > 0 THEN 1.0::DOUBLE / (60 + rl) ELSE 0 END AS rs FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rs, 12) DESC, cid) AS rank FROM f)"""


@query("hybrid_retrieve", f"""
WITH {_FUSED}, e AS (SELECT *, d >= {_GATE} OR l >= {_GATE} AS ev FROM t WHERE rank <= 5)
SELECT qid AS query_id, CAST(rank AS BIGINT) AS rank, cid AS chunk_id, round(d, 5) AS score, round(l, 6) AS lexical_score, round(rs, 6) AS rank_score,
  ev AS evident, CASE WHEN bool_or(ev) OVER (PARTITION BY qid) THEN 'relevant_source_found' ELSE 'no_relevant_source' END AS source_status FROM e""")
def hybrid_retrieve(spark, folder):
    """Map-only hybrid retrieval of every case against the pinned corpus."""
    cases, corpus = _cases_and_corpus(spark, folder)
    out = R.hybrid_retrieve(cases, corpus, 5, _GATE, stopwords=B.STOPWORDS, charset=B.CHARSET)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 5).alias("score"),
                      F.round("lexical_score", 6).alias("lexical_score"), F.round("rank_score", 6).alias("rank_score"), "evident", "source_status")


@query("evidence_gate", f"""
WITH {_FUSED.replace("PARTITION BY qid) AS l FROM raw", "PARTITION BY qid) * 0.5 AS l FROM raw")}, e AS (SELECT qid, cid, rank, round(d, 9) >= {_GATE} OR l >= {_GATE} AS ev FROM t WHERE rank <= 5)
SELECT qid AS query_id, CASE WHEN bool_or(ev) THEN 'relevant_source_found' ELSE 'no_relevant_source' END AS source_status,
  coalesce(string_agg(CAST(cid AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE ev), '') AS kept FROM e GROUP BY 1""")
def evidence_gate(spark, folder):
    """Fusion -> top five -> evidence gate over every document (lexical evidence halved)."""
    cases, corpus = _cases_and_corpus(spark, folder)
    found = R.hybrid_retrieve(cases, corpus, 5, _GATE, stopwords=B.STOPWORDS, charset=B.CHARSET, lexical_weight=0.5)
    context = R.retrieval_context(found.drop("rank"), 5, _GATE)
    return context.select("query_id", "source_status", F.array_join(F.transform("chunks", lambda c: c["chunk_id"].cast("string")), ",").alias("kept"))


@query("retrieval_queries", r"""
SELECT doc_id, regexp_replace(concat_ws(' ', 'Unit ' || source, 'noise report', CASE WHEN lang <> 'en' THEN lang END, regexp_replace(text, '^\s+|\s+$', '', 'g')), '^$', '') AS query FROM documents""")
def retrieval_queries(spark, folder):
    docs = table(spark, folder, "documents")
    values_ = F.array(F.when(F.col("lang") != "en", F.concat(F.lit(" "), "lang")), F.lit("  "))
    return docs.select("doc_id", R.retrieval_query(F.concat(F.lit("Unit "), "source"), F.lit("noise-report"), values_, F.col("text")).alias("query"))


@query("citations", f"""
WITH {_FUSED}, used AS (SELECT qid, cid, rank, d FROM t WHERE rank <= 5 AND cid % 2 = 0)
SELECT q.qid AS query_id, coalesce(string_agg('c' || cid || ':v1:' || (cid % 7), ',' ORDER BY rank), '') AS cited FROM (SELECT DISTINCT qid FROM t) q LEFT JOIN used USING (qid) GROUP BY 1""")
def citations(spark, folder):
    """Only the chunks an answer really used, cut down to citation keys (answers use even ids)."""
    cases, corpus = _cases_and_corpus(spark, folder)
    found = R.hybrid_retrieve(cases, corpus, 5, _GATE, stopwords=B.STOPWORDS, charset=B.CHARSET)
    label = F.concat(F.lit("c"), F.col("chunk_id").cast("string"))
    entry = F.struct("rank", label.alias("chunk_id"), F.lit("v1").alias("corpus_version"), (F.col("chunk_id") % 7).cast("string").alias("locator"), "score")
    context = found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("context"), F.collect_list(F.when(F.col("chunk_id") % 2 == 0, label)).alias("used"))
    cited = D.citations(F.col("context"), F.col("used"), ("chunk_id", "corpus_version", "locator"))
    return context.select("query_id", F.array_join(F.transform(cited, lambda c: F.concat_ws(":", c["chunk_id"], c["corpus_version"], c["locator"])), ",").alias("cited"))


def _greedy_rounds(rounds: int) -> str:
    """Greedy matching spelled out: each round takes the best pair left per payload."""
    parts, seen = [], []
    for n in range(rounds):
        left = "".join(f" AND NOT EXISTS (SELECT 1 FROM g{m} WHERE g{m}.u = p.u AND (g{m}.target = p.target OR g{m}.key = p.key))" for m in seen)
        parts.append(f"g{n} AS (SELECT * FROM p WHERE score >= 0.6{left} QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, target DESC, key DESC) = 1)")
        seen.append(n)
    return ", ".join(parts) + ", done AS (" + " UNION ALL ".join(f"SELECT * FROM g{n}" for n in range(rounds)) + ")"


@query("relabel_keys", f"""
WITH p AS (SELECT user_id AS u, 'target-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) AS target, event_type AS key, round(least(1.0, avg(value) / 40), 4) AS score FROM events GROUP BY 1, 2, 3),
{_greedy_rounds(4)} SELECT u AS payload_id, target, key, score FROM done""")
def relabel_keys(spark, folder):
    """Every user's event kinds matched one-to-one to four targets by similarity."""
    events = table(spark, folder, "events").select("user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    pairs = events.groupBy(F.col("user_id").alias("payload_id"), F.concat(F.lit("target-"), (F.col("k") % 4).cast("string")).alias("target"), F.col("event_type").alias("key")).agg(
        F.round(F.least(F.lit(1.0), F.avg("value") / 40), 4).alias("score"))
    return R.greedy_match(pairs)


# --- redaction --------------------------------------------------------------

def _numbered(text: str, label: str, pattern: str) -> str:
    return (f"array_to_string(list_transform(string_split_regex({text}, '{pattern}'), lambda x, i: CASE WHEN i > 1 THEN '{{{{REDACTED_{label}_' || CAST(i - 1 AS VARCHAR) || '}}}}' || x ELSE x END), '')")


_REDACT_STEPS = ["r0 AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents)"]
for _n, (_label, _pattern) in enumerate(B.PII_PATTERNS):
    _REDACT_STEPS.append(f"r{_n + 1} AS (SELECT doc_id, {_numbered('t', _label, _pattern)} AS t FROM r{_n})")


@query("pii_residual", f"""
WITH {', '.join(_REDACT_STEPS)}
SELECT doc_id, md5(t) AS digest, CAST(len(regexp_extract_all(t, 'REDACTED_')) AS BIGINT) AS placeholders FROM r{len(B.PII_PATTERNS)}""")
def pii_residual(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    clean = docs.select("doc_id", P.sanitize_text(F.col("text"), patterns=B.PII_PATTERNS).alias("t"))
    return clean.select("doc_id", F.md5("t").alias("digest"), F.regexp_count("t", F.lit("REDACTED_")).cast("bigint").alias("placeholders"))


_NAME = "regexp_extract(text, '[A-Za-z]{5,}')"


@query("known_redaction", f"""
WITH n AS (SELECT doc_id, text, {_NAME} AS name FROM documents)
SELECT doc_id, md5(CASE WHEN name = '' THEN text ELSE regexp_replace(text, '(?i)' || name, '{{{{APPLICANT_NAME}}}}', 'g') END) AS digest FROM n""")
def known_redaction(spark, folder):
    """Every document hides its own first long word, whatever its case."""
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]{5,}", 0).alias("name"))
    return docs.select("doc_id", F.md5(P.redact_known(F.col("text"), F.create_map(F.lit("applicant-name"), F.col("name")))).alias("digest"))


@query("policy_redaction", f"""
WITH n AS (SELECT doc_id, text, {_NAME} AS name FROM documents), r AS (SELECT doc_id, CASE WHEN name = '' THEN text ELSE regexp_replace(text, '(?i)' || name, '{{{{WORD}}}}', 'g') END AS t FROM n)
SELECT doc_id, md5(t) AS digest FROM r""")
def policy_redaction(spark, folder):
    """A policy file decides which of two known values is hidden: one is redacted, one kept."""
    path = shared_dir(spark, "policy")
    rules = table(spark, folder, "region").agg(F.count("*").alias("n")).select(F.to_json(F.create_map(F.lit("fieldHandling"), F.create_map(F.lit("word"), F.lit("redact"), F.lit("first-letter"), F.lit("task_required")))).alias("value"))
    rules.coalesce(1).write.text(path)
    handling = policy_map(load_policy(spark, path))
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]{5,}", 0).alias("name"))
    known = F.create_map(F.lit("word"), F.col("name"), F.lit("first-letter"), F.substring("name", 1, 1))
    return docs.select("doc_id", F.md5(P.redact_known(F.col("text"), known, handling)).alias("digest"))


@query("learning_export", f"""
WITH d AS (SELECT doc_id, text, 'Mail me at m' || doc_id || '@x.org' AS note, {_NAME} AS name FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0),
r0 AS (SELECT doc_id, CASE WHEN name = '' THEN text ELSE regexp_replace(text, '(?i)' || name, '{{{{APPLICANT_NAME}}}}', 'g') END AS t FROM d),
{', '.join(_REDACT_STEPS[1:])}
SELECT doc_id AS case_id, md5(t) AS digest, 'applicant-name=' || CASE WHEN name = '' THEN '' ELSE '{{{{APPLICANT_NAME}}}}' END || ';incident-description=Mail me at {{{{REDACTED_EMAIL_1}}}}' AS fields
FROM r{len(B.PII_PATTERNS)} JOIN d USING (doc_id)""")
def learning_export(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    one = F.lit(1).cast("bigint")
    states = labels.select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "completed").otherwise("needs_review").alias("state"), one.alias("revision"))
    field = lambda v: F.struct(v.alias("value"), F.lit(0.8).alias("confidence"))
    notes = docs.join(labels, "doc_id")
    validation = notes.select(
        F.col("doc_id").alias("case_id"), one.alias("revision"), F.col("doc_id").alias("document_id"), F.lit("gurultu-sikayeti").alias("request_type_id"),
        F.when(F.col("toxic") == 0, "complete").otherwise("invalid_information").alias("completion_status"),
        F.create_map(F.lit("applicant-name"), field(F.regexp_extract("text", "[A-Za-z]{5,}", 0)),
                     F.lit("incident-description"), field(F.concat(F.lit("Mail me at m"), F.col("doc_id").cast("string"), F.lit("@x.org"))),
                     F.lit("invoice-number"), field(F.lit("INV-1"))).alias("accepted_fields"))
    intake = docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("normalized_text"))
    out = P.learning_candidates(states, validation, intake, patterns=B.PII_PATTERNS)
    flat = F.array_join(F.transform(F.map_entries("validated_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"])), ";")
    return out.select("case_id", F.md5("sanitized_text").alias("digest"), flat.alias("fields"))


# --- drafts and letters -----------------------------------------------------

_CLAIMS = (r"[0-9]{4,}\s", r"token = ", r"thing(\s+\S+){0,4}\s+(erble|attion|the)", r"nicht(\s+\S+){0,4}\s+(der|die)")
_CLAIM_SQL = lambda text: "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in _CLAIMS) + ")"


@query("legal_guard", f"SELECT doc_id, {_CLAIM_SQL('text')} AS claims FROM documents")
def legal_guard(spark, folder):
    return table(spark, folder, "documents", spread="doc_id").select("doc_id", D.legal_claim(F.col("text"), _CLAIMS).alias("claims"))


@query("draft_checks", f"""
WITH d AS (SELECT conv_id, turn, text, text AS summary, conv_id % 11 = 0 AS extra, conv_id % 13 = 0 AS short,
  CASE role WHEN 'user' THEN 'response_letter' WHEN 'assistant' THEN 'other' ELSE 'memo' END AS kind, CASE WHEN turn % 3 = 0 THEN 'Detail' WHEN turn % 5 = 1 THEN ' ' END AS detail,
  CASE conv_id % 4 WHEN 0 THEN ['c1'] WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['c2', 'c2'] ELSE ['c9'] END AS refs,
  CASE WHEN conv_id % 3 = 0 THEN 'relevant_source_found' ELSE 'no_relevant_source' END AS st, CASE WHEN conv_id % 3 = 0 THEN ['c1', 'c2'] ELSE []::VARCHAR[] END AS ctx FROM conversations)
SELECT conv_id, turn, CASE WHEN extra OR short THEN 'schema_invalid'
  WHEN length(regexp_replace(summary, '\\s', '', 'g')) = 0 OR length(summary) > 600 THEN 'document_summary_invalid' WHEN length(regexp_replace(text, '\\s', '', 'g')) = 0 OR length(text) > 6000 THEN 'draft_text_invalid'
  WHEN kind = 'memo' THEN 'type_invalid' WHEN detail IS NOT NULL AND (kind <> 'other' OR detail = ' ') THEN 'type_detail_invalid'
  WHEN len(refs) <> len(list_distinct(refs)) OR NOT list_has_all(ctx, refs) THEN 'refs_invalid' WHEN st = 'relevant_source_found' AND len(refs) = 0 THEN 'citation_required'
  WHEN st = 'no_relevant_source' AND (len(refs) > 0 OR len(ctx) > 0 OR {_CLAIM_SQL('text')}) THEN 'UNVERIFIED_LEGAL_CLAIM' END AS error_code FROM d""")
def draft_checks(spark, folder):
    """Conversation turns as candidate drafts against the whole guard."""
    turns = table(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    keys = F.when(conv % 11 == 0, strings(*fixed.DRAFT_REQUIRED, "note")).when(conv % 13 == 0, strings(*fixed.DRAFT_REQUIRED[1:])).otherwise(
        strings(*fixed.DRAFT_REQUIRED, *fixed.DRAFT_OPTIONAL))
    drafts = turns.select(
        conv, turn, keys.alias("keys"), F.col("text").alias("document_summary"), F.col("text").alias("draft_text"),
        F.when(F.col("role") == "user", "response_letter").when(F.col("role") == "assistant", "other").otherwise("memo").alias("recommended_correspondence_type"),
        F.when(turn % 3 == 0, "Detail").when(turn % 5 == 1, " ").alias("correspondence_type_detail"),
        F.when(conv % 4 == 0, strings("c1")).when(conv % 4 == 1, strings()).when(conv % 4 == 2, strings("c2", "c2")).otherwise(strings("c9")).alias("used_source_refs"),
        F.when(conv % 3 == 0, "relevant_source_found").otherwise("no_relevant_source").alias("source_status"),
        F.when(conv % 3 == 0, strings("c1", "c2")).otherwise(strings()).alias("retrieved_refs"))
    return D.check_drafts(drafts, patterns=_CLAIMS).select("conv_id", "turn", "error_code")


_TARGETS = tuple(fixed.RELABEL_TARGETS)
_TYPES = tuple(fixed.CORRESPONDENCE_DESCRIPTIONS)
_SCORE = "round(((conv_id * 7 + turn * 3 + {0} * 11 + {1} * 29) % 50 + 50) / 100.0, 2)"


@query("draft_repairs", f"""
WITH d AS (SELECT conv_id, turn, conv_id || '-' || turn AS u, text, CASE WHEN conv_id % 3 = 0 THEN 'relevant_source_found' ELSE 'no_relevant_source' END AS st, conv_id % 5 AS style,
  CASE WHEN turn % 2 = 0 THEN 'cover_letter' ELSE 'Cover note' END AS kind, CASE WHEN conv_id % 3 = 0 THEN ['c1', 'c2'] ELSE []::VARCHAR[] END AS ctx, CASE WHEN conv_id % 3 = 0 THEN ['c1'] ELSE []::VARCHAR[] END AS refs FROM conversations),
names AS (SELECT d.*, unnest(CASE style WHEN 0 THEN ['document_summary', 'recommended_correspondence_type', 'draft_text', 'used_source_refs'] WHEN 1 THEN ['summary', 'type', 'body', 'sources']
  WHEN 2 THEN ['sanitized_document', 'type', 'draft_text', 'used_source_refs'] WHEN 3 THEN ['document_summary', 'recommended_correspondence_type', 'draft_text', 'sources'] ELSE ['summary', 'recommended_correspondence_type', 'body'] END) AS key,
  unnest([0, 1, 2, 3][:CASE WHEN style = 4 THEN 3 ELSE 4 END]) AS part FROM d),
strict AS (SELECT *, CASE WHEN style <> 0 THEN 'schema_invalid' WHEN length(regexp_replace(text, '\\s', '', 'g')) = 0 OR length(text) > 600 THEN 'document_summary_invalid' WHEN kind <> 'cover_letter' THEN 'type_invalid'
  WHEN st = 'no_relevant_source' AND {_CLAIM_SQL('text')} THEN 'UNVERIFIED_LEGAL_CLAIM' END AS err FROM d),
p AS (SELECT n.u, t.target, key, part, {_SCORE.format("t.n", "part").replace("conv_id", "n.conv_id").replace("turn", "n.turn")} AS score FROM names n JOIN strict s ON s.u = n.u AND s.err IS NOT NULL AND s.err <> 'UNVERIFIED_LEGAL_CLAIM' CROSS JOIN (VALUES ('document_summary', 0), ('recommended_correspondence_type', 1), ('draft_text', 2), ('used_source_refs', 3)) t(target, n)),
{_greedy_rounds(4)},
got AS (SELECT u, max(part) FILTER (WHERE target = 'document_summary') AS ps, max(part) FILTER (WHERE target = 'recommended_correspondence_type') AS pk, max(part) FILTER (WHERE target = 'draft_text') AS pt, max(part) FILTER (WHERE target = 'used_source_refs') AS pr FROM done GROUP BY 1),
best AS (SELECT u, arg_max(t.type_id, s * 100 - t.n / 100.0) AS type_id, max(s) AS s FROM (SELECT d.u, y.type_id, y.n, {_SCORE.format("y.n", "3")} AS s FROM d CROSS JOIN (VALUES ('response_letter', 0), ('information_letter', 1), ('referral_letter', 2), ('cover_letter', 3), ('other', 4)) y(type_id, n)) t GROUP BY 1),
cut AS (SELECT u, list_reduce(list_prepend({{{{'kept': '', 'stop': FALSE, 's': ''}}}}, list_transform(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {{{{'kept': '', 'stop': FALSE, 's': x}}}})),
  lambda a, x: CASE WHEN a.stop OR x.s = '' OR length(a.kept) + length(x.s) + CASE WHEN a.kept <> '' THEN 1 ELSE 0 END > 600 THEN {{{{'kept': a.kept, 'stop': TRUE, 's': ''}}}}
  ELSE {{{{'kept': CASE WHEN a.kept = '' THEN x.s ELSE a.kept || ' ' || x.s END, 'stop': FALSE, 's': ''}}}} END).kept AS prefix FROM d),
v AS (SELECT s.*, got.*EXCLUDE (u), {', '.join(f"CASE p{c} WHEN 0 THEN text WHEN 1 THEN kind WHEN 2 THEN text WHEN 3 THEN '[' || array_to_string(list_transform(refs, lambda x: chr(34) || x || chr(34)), ',') || ']' END AS v{c}" for c in "sktr")}, prefix, best.type_id AS bt, best.s AS bs
  FROM strict s LEFT JOIN got USING (u) JOIN cut USING (u) JOIN best USING (u)),
w AS (SELECT *, coalesce(vs, CASE WHEN style = 2 AND prefix <> '' THEN prefix END) AS fs, CASE WHEN vk IS NOT NULL AND vk NOT IN ('response_letter', 'information_letter', 'referral_letter', 'cover_letter', 'other') AND bs >= 0.6 THEN bt ELSE vk END AS fk,
  CASE WHEN pr = 3 THEN refs END AS fr FROM v)
SELECT u AS draft_id, CASE WHEN err IS NULL OR err = 'UNVERIFIED_LEGAL_CLAIM' THEN 'strict' ELSE 'repaired' END AS lane,
  CASE WHEN err IS NULL OR err = 'UNVERIFIED_LEGAL_CLAIM' THEN err WHEN fs IS NULL OR fk IS NULL OR vt IS NULL OR fr IS NULL THEN 'schema_invalid' WHEN length(regexp_replace(fs, '\\s', '', 'g')) = 0 OR length(fs) > 600 THEN 'document_summary_invalid'
    WHEN length(regexp_replace(vt, '\\s', '', 'g')) = 0 OR length(vt) > 6000 THEN 'draft_text_invalid' WHEN fk NOT IN ('response_letter', 'information_letter', 'referral_letter', 'cover_letter', 'other') THEN 'type_invalid'
    WHEN NOT list_has_all(ctx, fr) THEN 'refs_invalid' WHEN st = 'relevant_source_found' AND len(fr) = 0 THEN 'citation_required'
    WHEN st = 'no_relevant_source' AND {_CLAIM_SQL('vt')} THEN 'UNVERIFIED_LEGAL_CLAIM' END AS error_code,
  CASE WHEN err IS NULL OR err = 'UNVERIFIED_LEGAL_CLAIM' THEN kind ELSE fk END AS kind, CASE WHEN err IS NULL OR err = 'UNVERIFIED_LEGAL_CLAIM' THEN md5(text) ELSE md5(fs) END AS summary_digest FROM w""".replace("{{{{", "{{").replace("}}}}", "}}").replace("{{", "{").replace("}}", "}"))
def draft_repairs(spark, folder):
    """Turns as answers in five styles of keys; similarities follow from the row's numbers."""
    turns = table(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    style = (conv % 5).cast("int")
    named = (_TARGETS, ("summary", "type", "body", "sources"), ("sanitized_document", "type", "draft_text", "used_source_refs"),
             ("document_summary", "recommended_correspondence_type", "draft_text", "sources"), ("summary", "recommended_correspondence_type", "body"))
    sourced = conv % 3 == 0
    values_ = (F.col("text"), F.when(turn % 2 == 0, "cover_letter").otherwise("Cover note"), F.col("text"), F.when(sourced, '["c1"]').otherwise("[]"))
    payload, keys = None, None
    for n, some in enumerate(named):
        made = F.map_from_arrays(F.array(*map(F.lit, some)), F.array(*values_[:len(some)]))
        payload = F.when(style == n, made) if payload is None else payload.when(style == n, made)
    base = turns.select(conv, turn, F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("draft_id"), payload.alias("payload"), style.alias("style"),
                        F.when(sourced, F.array(F.lit("c1"), F.lit("c2"))).otherwise(F.array().cast("array<string>")).alias("retrieved_refs"),
                        F.when(sourced, "relevant_source_found").otherwise("no_relevant_source").alias("source_status"))
    score = lambda a, b: F.round(((conv * 7 + turn * 3 + a * 11 + b * 29) % 50 + 50) / 100.0, 2).alias("score")
    numbered = lambda names: F.array(*[F.struct(F.lit(v).alias("name"), F.lit(n).alias("n")) for n, v in enumerate(names)])
    parts = base.select("draft_id", conv, turn, F.posexplode(F.map_keys("payload")).alias("part", "key"), F.lit(1).alias("one"))
    key_scores = parts.select("*", F.inline(numbered(_TARGETS))).select("draft_id", F.col("name").alias("target"), "key", score(F.col("n"), F.col("part")))
    type_scores = base.select("draft_id", conv, turn, F.inline(numbered(_TYPES))).select("draft_id", F.col("name").alias("type_id"), score(F.col("n"), F.lit(3)))
    out = D.repair_drafts(base.select("draft_id", "payload", "retrieved_refs", "source_status"), key_scores, type_scores, patterns=_CLAIMS)
    return out.select("draft_id", "lane", "error_code", F.col("recommended_correspondence_type").alias("kind"), F.md5("document_summary").alias("summary_digest"))


_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query("sentence_prefixes", rf"""
WITH s AS (SELECT doc_id, string_split(regexp_replace({_TRIM}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
f AS (SELECT doc_id, list_reduce(list_prepend({{'kept': '', 'stop': FALSE, 's': ''}}, list_transform(ss, lambda x: {{'kept': '', 'stop': FALSE, 's': x}})),
  lambda a, x: CASE WHEN a.stop OR x.s = '' OR length(a.kept) + length(x.s) + CASE WHEN a.kept <> '' THEN 1 ELSE 0 END > 300 THEN {{'kept': a.kept, 'stop': TRUE, 's': ''}}
    ELSE {{'kept': CASE WHEN a.kept = '' THEN x.s ELSE a.kept || ' ' || x.s END, 'stop': FALSE, 's': ''}} END).kept AS prefix FROM s)
SELECT doc_id, prefix FROM f""")
def sentence_prefixes(spark, folder):
    return table(spark, folder, "documents", spread="doc_id").select("doc_id", D.sentence_prefix(F.col("text"), 300).alias("prefix"))


@query("chunk_documents", rf"""
WITH s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(regexp_replace({_TRIM}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM documents),
f AS (SELECT doc_id, text, list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': '', 's': ''}}, list_transform(ss, lambda x: {{'done': []::VARCHAR[], 'open': '', 's': x}})),
  lambda a, x: CASE WHEN length(x.s) > 900 THEN {{'done': a.done || CASE WHEN a.open = '' THEN []::VARCHAR[] ELSE [a.open] END || list_transform(range(0, CAST(ceil(length(x.s) / 900.0) AS BIGINT)), lambda i: x.s[(i * 900 + 1):(i * 900 + 900)]), 'open': '', 's': ''}}
    WHEN a.open <> '' AND length(a.open) + length(x.s) + 1 > 900 THEN {{'done': a.done || [a.open], 'open': x.s, 's': ''}}
    ELSE {{'done': a.done, 'open': regexp_replace(a.open || ' ' || x.s, '^\s+|\s+$', '', 'g'), 's': ''}} END) AS r FROM s),
c AS (SELECT doc_id, CASE WHEN len(r.done) = 0 AND r.open = '' THEN [text] WHEN r.open = '' THEN r.done ELSE r.done || [r.open] END AS chunks FROM f)
SELECT doc_id, CAST(len(chunks) AS BIGINT) AS n_chunks, md5(array_to_string(chunks, '|')) AS digest FROM c""")
def chunk_documents(spark, folder):
    chunks = table(spark, folder, "documents", spread="doc_id").select("doc_id", D.chunk_text(F.col("text")).alias("chunks"))
    return chunks.select("doc_id", F.size("chunks").cast("bigint").alias("n_chunks"), F.md5(F.array_join("chunks", "|")).alias("digest"))


_ROUTES = ("yönlendirme birimi", "Duyuru masası", "bilgi güncelleme", "üst yazı", "Genel")
_ROUTE_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {n} THEN '{r}'" for n, r in enumerate(_ROUTES)) + " END"


@query("letters", rf"""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS document, regexp_replace(text, '^\s+|\s+$', '', 'g') AS summary, {_ROUTE_SQL} AS routing, doc_id % 6 = 5 AS gaps FROM documents),
t AS (SELECT *, CASE WHEN gaps THEN 'eksik_bilgi_talebi' WHEN contains(x, 'yönlendir') THEN 'yönlendirme' WHEN contains(x, 'bilgilendirme') OR contains(x, 'duyuru') OR (contains(x, 'bilgi') AND contains(x, 'güncelleme')) THEN 'bilgilendirme'
  WHEN contains(x, 'üst yazı') OR contains(x, 'üst yazi') OR (contains(x, 'kurum') AND contains(x, 'gönder')) THEN 'üst_yazı' ELSE 'cevap' END AS letter_type,
  CASE WHEN length(summary) > 120 THEN regexp_replace(summary[1:117], '\s+$', '') || '...' ELSE summary END AS subject FROM (SELECT *, lower(summary || ' ' || routing) AS x FROM d))
SELECT doc_id, letter_type, subject, md5('Sayın ' || routing || ',' || chr(10) || chr(10) || CASE letter_type
  WHEN 'eksik_bilgi_talebi' THEN subject || ' konulu başvuruda işlem için eksik bilgi bulunmaktadır. Aşağıdaki hususların gönderilmesi gerekmektedir: Adres, Telefon.' || chr(10) || chr(10) || 'İlave bilgi iletilmesi halinde işleme devam edilecektir.'
  WHEN 'yönlendirme' THEN subject || ' konulu dosya, ilgili iş akışı kapsamında tarafınıza yönlendirilmiştir. İşlem ve gerekli takip için ilgili birim tarafından değerlendirme yapılacaktır.'
  WHEN 'bilgilendirme' THEN subject || ' konusu kapsamında bilgilendirme yapılmıştır. Belge içeriğinde yer alan hususların dikkate alınması ve gerekli işlemlerin yürütülmesi önem arz etmektedir.'
  WHEN 'üst_yazı' THEN subject || ' konusu ilişiğinde tarafımıza ulaştırılan evrak değerlendirilmiş olup, ilgili kurum/kuruluş bilgileri dikkate alınarak üst yazı kapsamında gerekli işlemler yapılacaktır.'
  ELSE subject || ' konusundaki talep/başvurunuz incelenmiş olup, aşağıdaki şekilde cevap verilmiştir.' || chr(10) || chr(10) || document || chr(10) || chr(10) || 'Gerekli işlemler çerçevesinde tarafınıza dönüş sağlanacaktır.' END
  || chr(10) || chr(10) || 'Saygılarımla,') AS draft_digest FROM t""")
def letters(spark, folder):
    docs = table(spark, folder, "documents", spread="doc_id")
    doc = F.col("doc_id")
    routing = F.lit(_ROUTES[-1])
    for n, name in reversed(list(enumerate(_ROUTES[:-1]))):
        routing = F.when(doc % 5 == n, name).otherwise(routing)
    requests = docs.select(
        doc, F.col("text").alias("document"), F.col("text").alias("summary"), routing.alias("routing"),
        F.array().cast("array<string>").alias("regulations"), F.when(doc % 6 == 5, F.array(F.lit("Adres"), F.lit(" "), F.lit("Telefon "))).alias("missing_info"))
    return D.generate_letters(requests).select("doc_id", "letter_type", "subject", F.md5("draft").alias("draft_digest"))


@query("notice_rows", r"""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
r AS (SELECT k, a.audience, CASE WHEN k % 17 = 0 THEN ' ' WHEN k % 19 = 0 THEN repeat('x', 4001) ELSE ' Order ' || k || ' moved ' END AS body, s FROM o CROSS JOIN (VALUES ('applicant'), ('target_unit')) a(audience))
SELECT k AS case_id, audience, CASE WHEN k % 17 = 0 THEN 'body_required' WHEN k % 19 = 0 THEN 'bounds_exceeded' END AS error,
  CASE WHEN k % 17 <> 0 AND k % 19 <> 0 THEN CASE audience WHEN 'applicant' THEN 'Başvurunuz işleme alındı' ELSE 'Yeni başvuru yönlendirildi' END END AS notice_title,
  CASE WHEN k % 17 <> 0 AND k % 19 <> 0 THEN 'Order ' || k || ' moved' END AS notice_body,
  CASE WHEN k % 17 <> 0 AND k % 19 <> 0 AND audience = 'target_unit' THEN 'document_summary=' || s || ';request_type_id=t' || (k % 3) END AS context,
  CASE WHEN audience = 'applicant' AND s = 'O' THEN 'en' ELSE 'tr' END AS language FROM r""")
def notice_rows(spark, folder):
    k = F.col("case_id")
    routes = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"))
    body = F.when(k % 17 == 0, " ").when(k % 19 == 0, F.repeat(F.lit("x"), 4001)).otherwise(F.concat(F.lit(" Order "), k.cast("string"), F.lit(" moved ")))
    context = F.create_map(F.lit("request_type_id"), F.concat(F.lit("t"), (k % 3).cast("string")), F.lit("document_summary"), F.col("status"), F.lit("applicant_phone"), F.lit("secret"))
    rows = D.notification_rows(routes.withColumn("body", body).withColumn("context", context))
    language = D.output_language(F.col("audience"), F.when(F.col("status") == "O", "en").otherwise("unknown"))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("case_context"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return rows.select("case_id", "audience", "error", "notice_title", "notice_body", flat.alias("context"), language.alias("language"))
