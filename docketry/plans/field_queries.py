"""Queries over fields: candidates, validation, revisions, change requests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketry.operators import fields as V, requests as Q
from docketry.plans.registry import query, values
from docketry.sources import fixed
from docketry.sources.loaders import default_registry, table


def _tckn(key: Column) -> Column:
    """Checksum-correct number for a key; every fourth one is spoiled."""
    base = (F.lit(100000000) + key).cast("string")
    digit = lambda i: F.substring(base, i, 1).cast("int")
    odd, even = sum((digit(i) for i in (1, 3, 5, 7, 9)), F.lit(0)), sum((digit(i) for i in (2, 4, 6, 8)), F.lit(0))
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    last = F.pmod(odd + even + tenth + F.when(key % 4 == 0, 1).otherwise(0), F.lit(10))
    return F.concat(base, tenth.cast("string"), last.cast("string"))


_SQL_DIGIT = lambda i: f"CAST(substr(CAST(100000000 + k AS VARCHAR), {i}, 1) AS INTEGER)"
_ODD, _EVEN = " + ".join(map(_SQL_DIGIT, (1, 3, 5, 7, 9))), " + ".join(map(_SQL_DIGIT, (2, 4, 6, 8)))
SQL_TENTH = f"((({_ODD}) * 7 - ({_EVEN})) % 10 + 10) % 10"
SQL_TCKN = f"CAST(100000000 + k AS VARCHAR) || CAST({SQL_TENTH} AS VARCHAR) || CAST((({_ODD}) + ({_EVEN}) + {SQL_TENTH} + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR)"


def _padded(key: Column, width: int) -> Column:
    return F.lpad(key.cast("string"), width, "0")


@query("field_validate", rf"""
WITH c AS (SELECT c_custkey AS k, c_name FROM customer),
raw AS (
  SELECT k, 'tckn' AS kind, {SQL_TCKN} AS v, k % 4 <> 0 AS ok, {SQL_TCKN} AS val, 'tckn_checksum' AS err FROM c
  UNION ALL SELECT k, 'phone-tr', CASE k % 5 WHEN 0 THEN '5' WHEN 1 THEN '0(5' WHEN 2 THEN ' +90 5' WHEN 3 THEN '02' ELSE '55' END || lpad(CAST(k AS VARCHAR), 8, '0') || CASE WHEN k % 5 IN (0, 1, 2) THEN '7' ELSE '' END,
    k % 5 <> 3, CASE WHEN k % 5 = 4 THEN '+9055' || lpad(CAST(k AS VARCHAR), 8, '0') ELSE '+905' || lpad(CAST(k AS VARCHAR), 8, '0') || '7' END, 'phone_format' FROM c
  UNION ALL SELECT k, 'date', CASE WHEN k % 2 = 0 THEN '2026-' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0') ELSE CAST(k % 33 AS VARCHAR) || '.' || CAST(k % 14 AS VARCHAR) || '.2026' END,
    try_strptime('2026-' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0'), '%Y-%m-%d') IS NOT NULL,
    '2026-' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0'), 'date_format' FROM c
  UNION ALL SELECT k, 'money-try', CAST(k % 7 AS VARCHAR) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0'), k % 7 <> 0, CAST(k % 7 AS VARCHAR) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0'), 'money_format' FROM c
  UNION ALL SELECT k, 'free-text', CASE WHEN k % 11 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END, k % 11 <> 0, c_name, 'schema_rule' FROM c
  UNION ALL SELECT k, 'attachment', 'attachment', k % 3 <> 0, CASE k % 3 WHEN 1 THEN 'present' END, 'attachment_missing' FROM c)
SELECT k AS case_id, kind, CASE WHEN ok THEN val END AS value, CASE WHEN NOT ok THEN err END AS error FROM raw""")
def field_validate(spark, folder):
    """Every field kind over values derived from the customers, good and bad."""
    k = F.col("k")
    base = table(spark, folder, "customer", spread="c_custkey").select(F.col("c_custkey").alias("k"), "c_name")
    body = _padded(k, 8)
    head = F.when(k % 5 == 0, "5").when(k % 5 == 1, "0(5").when(k % 5 == 2, " +90 5").when(k % 5 == 3, "02").otherwise("55")
    phone = F.concat(head, body, F.when(k % 5 < 3, "7").otherwise(""))
    day = F.when(k % 2 == 0, F.concat(F.lit("2026-"), _padded(k % 14, 2), F.lit("-"), _padded(k % 33, 2))).otherwise(
        F.concat_ws(".", (k % 33).cast("string"), (k % 14).cast("string"), F.lit("2026")))
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    rows = base.select("k", F.explode(F.array(
        entry("tckn", _tckn(k)), entry("phone-tr", phone), entry("date", day),
        entry("money-try", F.concat((k % 7).cast("string"), F.lit("."), _padded(k % 100, 2))),
        entry("free-text", F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))), entry("attachment", F.lit("attachment")))).alias("e"))
    metadata = F.when(k % 3 == 0, '{"attachments":[{}]}').when(k % 3 == 1, '{"attachments":[{"attachmentId":"a"}]}').otherwise("{}")
    judged = rows.select("k", "e.kind", V.validate_value(F.col("e.kind"), F.col("e.v"), metadata).alias("r"))
    return judged.select(F.col("k").alias("case_id"), "kind", F.col("r.value").alias("value"), F.col("r.error").alias("error"))


def case_texts(spark, folder):
    """Filled-in forms derived from the orders: ``field-id: value`` lines."""
    k, cust = F.col("k"), F.col("cust")
    orders = table(spark, folder, "orders", spread="o_orderkey").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"))
    form = F.when(k % 2 == 0, "adres-bildirimi").otherwise("fatura-islemi")
    line = lambda field, value, keep: F.when(keep, F.concat(F.lit(f"{field}: "), value))
    lines = F.when(k % 2 == 0, F.array(
        F.lit("To whom it may concern"), line("applicant-name", F.concat(F.lit("Customer "), cust.cast("string")), k % 7 != 0), line("tckn", _tckn(k), k % 3 != 0),
        line("new-address", F.concat(F.lit("Street "), cust.cast("string")), k % 5 != 0), line("phone", F.concat(F.lit("5"), _padded(cust, 9)), k % 9 != 0),
    )).otherwise(F.array(
        F.lit("Invoice enclosed"), line("supplier-name", F.concat(F.lit("Supplier "), cust.cast("string")), k % 7 != 0), line("invoice-number", F.concat(F.lit("INV-"), k.cast("string")), k % 6 != 3),
        line("invoice-date", F.concat(_padded(k % 33, 2), F.lit("."), _padded(k % 14, 2), F.lit(".2026")), k % 5 != 0),
        line("invoice-amount", F.concat((k % 8).cast("string"), F.lit(".50")), k % 9 != 0)))
    metadata = F.when(k % 3 == 0, '{"attachments":[{}]}').when(k % 3 == 1, '{"attachments":[{"attachmentId":"a"}]}').otherwise("{}")
    name = F.when(k % 2 == 0, "applicant-name").otherwise("supplier-name")
    prior = F.when(k % 10 < 2, F.map_from_arrays(F.array(name), F.array(F.struct(F.lit("Prior").alias("value"), F.lit(0.9).alias("confidence")))))
    return orders.select(k.alias("case_id"), form.alias("request_type_id"), F.array_join(F.array_compact(lines), "\r\n").alias("normalized_text"),
                         metadata.alias("source_metadata"), prior.alias("prior_fields"))


_FORM_FIELDS = f"""
o AS (SELECT o_orderkey AS k, o_custkey AS cust FROM orders),
fld AS (
  SELECT k, 0 AS ord, 'applicant-name' AS id, TRUE AS req, CASE WHEN k % 7 <> 0 THEN 'Customer ' || cust END AS v, TRUE AS ok, '' AS err FROM o WHERE k % 2 = 0
  UNION ALL SELECT k, 1, 'tckn', TRUE, CASE WHEN k % 3 <> 0 THEN {SQL_TCKN} END, k % 4 <> 0, 'tckn_checksum' FROM o WHERE k % 2 = 0
  UNION ALL SELECT k, 2, 'new-address', TRUE, CASE WHEN k % 5 <> 0 THEN 'Street ' || cust END, TRUE, '' FROM o WHERE k % 2 = 0
  UNION ALL SELECT k, 3, 'phone', FALSE, CASE WHEN k % 9 <> 0 THEN '+905' || lpad(CAST(cust AS VARCHAR), 9, '0') END, TRUE, '' FROM o WHERE k % 2 = 0
  UNION ALL SELECT k, 0, 'supplier-name', TRUE, CASE WHEN k % 7 <> 0 THEN 'Supplier ' || cust END, TRUE, '' FROM o WHERE k % 2 = 1
  UNION ALL SELECT k, 1, 'invoice-number', TRUE, CASE WHEN k % 6 <> 3 THEN 'INV-' || k END, TRUE, '' FROM o WHERE k % 2 = 1
  UNION ALL SELECT k, 2, 'invoice-date', TRUE, CASE WHEN k % 5 <> 0 THEN '2026-' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0') END,
    try_strptime('2026-' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0'), '%Y-%m-%d') IS NOT NULL, 'date_format' FROM o WHERE k % 2 = 1
  UNION ALL SELECT k, 3, 'invoice-amount', TRUE, CASE WHEN k % 9 <> 0 THEN (k % 8) || '.50' END, k % 8 <> 0, 'money_format' FROM o WHERE k % 2 = 1
  UNION ALL SELECT k, 4, 'invoice-attachment', TRUE, CASE WHEN k % 3 <> 2 THEN 'present' END, k % 3 <> 0, 'attachment_missing' FROM o WHERE k % 2 = 1)"""


@query("field_candidates", f"""
WITH {_FORM_FIELDS.replace("'+905'", "'5'")},
raw AS (SELECT k, id, CASE WHEN id = 'invoice-date' THEN lpad(CAST(k % 33 AS VARCHAR), 2, '0') || '.' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '.2026' ELSE v END AS v, '0.8' AS c FROM fld WHERE v IS NOT NULL AND id <> 'invoice-attachment'
  UNION ALL SELECT k, 'incident-date', lpad(CAST(k % 33 AS VARCHAR), 2, '0') || '.' || lpad(CAST(k % 14 AS VARCHAR), 2, '0') || '.2026', '1.0' FROM fld WHERE id = 'invoice-date' AND v IS NOT NULL)
SELECT o.k AS case_id, coalesce(string_agg(id || '=' || v || ':' || c, ';' ORDER BY id), '') AS candidates FROM o LEFT JOIN raw ON raw.k = o.k GROUP BY 1""")
def field_candidates(spark, folder):
    found = V.labeled_candidates(case_texts(spark, folder), default_registry(spark))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("candidates"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["value"], F.lit(":"), e["value"]["confidence"].cast("string")))), ";")
    return found.select("case_id", flat.alias("candidates"))


@query("field_evaluate", f"""
WITH {_FORM_FIELDS},
j AS (SELECT *, id IN ('applicant-name', 'supplier-name') AND k % 10 < 2 AS has_prior, CASE WHEN id = 'invoice-attachment' THEN '1.0' ELSE '0.8' END AS conf FROM fld),
a AS (SELECT k, string_agg(id || '=' || CASE WHEN v IS NOT NULL AND ok THEN v || ':' || conf ELSE 'Prior:0.9' END, ';' ORDER BY ord) FILTER (WHERE (v IS NOT NULL AND ok) OR has_prior) AS accepted,
  string_agg(id, ';' ORDER BY ord) FILTER (WHERE v IS NULL AND NOT has_prior AND req) AS missing, string_agg(id || ':' || err, ';' ORDER BY ord) FILTER (WHERE v IS NOT NULL AND NOT ok) AS invalid FROM j GROUP BY k)
SELECT k AS case_id, coalesce(accepted, '') AS accepted, coalesce(missing, '') AS missing, coalesce(invalid, '') AS invalid,
  CASE WHEN invalid IS NOT NULL THEN 'invalid_information' WHEN missing IS NOT NULL THEN 'missing_information' ELSE 'complete' END AS completion_status FROM a""")
def field_evaluate(spark, folder):
    registry = default_registry(spark)
    out = V.evaluate_fields(V.labeled_candidates(case_texts(spark, folder), registry), registry)
    joined = lambda name, f: F.array_join(F.transform(name, f), ";").alias(name.split("_")[0])
    return out.select(
        "case_id", F.array_join(F.transform("extracted_fields", lambda f: F.concat(f["id"], F.lit("="), f["value"], F.lit(":"), f["confidence"].cast("string"))), ";").alias("accepted"),
        joined("missing_fields", lambda f: f["id"]), joined("invalid_fields", lambda f: F.concat(f["id"], F.lit(":"), f["code"])), "completion_status")


@query("answer_candidates", r"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS cust FROM orders)
SELECT k AS case_id, CASE WHEN k % 4 < 2 THEN NULL ELSE 'invalid_answer' END AS answer_error,
  CASE k % 4 WHEN 0 THEN 'applicant-name=Customer ' || cust || ':0.5;new-address=Street ' || k || ':0.5;phone=05' || lpad(CAST(cust AS VARCHAR), 9, '0') || ':1.0;tckn=05' || lpad(CAST(cust AS VARCHAR), 9, '0') || ':1.0'
    WHEN 1 THEN 'new-address=Street ' || k || ':0.5;phone=05' || lpad(CAST(cust AS VARCHAR), 9, '0') || ':1.0;tckn=05' || lpad(CAST(cust AS VARCHAR), 9, '0') || ':1.0' END AS candidates FROM o""")
def answer_candidates(spark, folder):
    """Noisy model answers: fenced, prefixed with broken JSON, off-schema, no object."""
    k, cust = F.col("case_id"), F.col("cust")
    base = table(spark, folder, "orders", spread="o_orderkey").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("cust"))
    street = F.concat(F.lit('"new-address":"Street '), k.cast("string"), F.lit('"'))
    answer = (
        F.when(k % 4 == 0, F.concat(F.lit('Sure:\n```json\n{"applicant-name":"Customer '), cust.cast("string"), F.lit('",'), street, F.lit("}\n``` done {x")))
        .when(k % 4 == 1, F.concat(F.lit("{broken {"), street, F.lit("} trailing }")))
        .when(k % 4 == 2, F.concat(F.lit('{"new-address":5,"tckn":"'), cust.cast("string"), F.lit('"}'))).otherwise(F.lit("I found nothing.")))
    text = F.concat(F.lit("Call 05"), F.lpad(cust.cast("string"), 9, "0"))
    docs = base.select("case_id", F.lit("adres-bildirimi").alias("request_type_id"), answer.alias("answer"), text.alias("normalized_text"))
    out = V.answer_candidates(docs, default_registry(spark))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("candidates"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["value"], F.lit(":"), e["value"]["confidence"].cast("string")))), ";")
    return out.select("case_id", "answer_error", flat.alias("candidates"))


@query("validation_revisions", """
WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders),
m AS (SELECT k, k % 3 <> 0 AS has_prior, k % 5 <> 0 AS has_new, k % 2 = 0 AS same FROM o WHERE k % 3 <> 0 OR k % 5 <> 0)
SELECT k AS case_id, CASE WHEN NOT has_new OR (has_prior AND same) THEN 1 + k % 4 WHEN has_prior THEN 2 + k % 4 ELSE 1 END AS revision,
  CASE WHEN NOT has_new OR (has_prior AND same) THEN 'unchanged' WHEN has_prior THEN 'changed' ELSE 'created' END AS outcome,
  CASE WHEN NOT has_new OR (has_prior AND same) THEN 'g' || k END AS current_generation_id,
  CASE WHEN NOT has_new OR same THEN 'complete' ELSE 'missing_information' END AS completion_status FROM m""")
def validation_revisions(spark, folder):
    k = F.col("case_id")
    base = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderpriority")
    field = lambda order: F.map_from_entries(F.array(*[
        F.struct(F.lit(n).alias("k"), F.struct(F.col("o_orderpriority").alias("value"), F.lit(0.8).alias("confidence")).alias("v")) for n in order]))
    missing = lambda gap: F.when(gap, F.array(F.struct(F.lit("phone").alias("id"), F.lit("Telefon").alias("label")))).otherwise(F.array().cast("array<struct<id:string,label:string>>"))
    invalid = F.array().cast("array<struct<id:string,label:string,code:string>>").alias("invalid_fields")
    status = lambda gap: F.when(gap, "missing_information").otherwise("complete").alias("completion_status")
    # The maps hold the same entries in another order, which must not count as a change.
    prior = base.where(k % 3 != 0).select(k, field(("a", "b")).alias("accepted_fields"), missing(F.lit(False)).alias("missing_fields"), invalid, status(F.lit(False)),
                                          (1 + k % 4).alias("revision"), F.concat(F.lit("g"), k.cast("string")).alias("current_generation_id"))
    gap = k % 2 != 0
    new = base.where(k % 5 != 0).select(k, field(("b", "a")).alias("accepted_fields"), missing(gap).alias("missing_fields"), invalid, status(gap))
    out = V.merge_validation(prior, new)
    return out.select("case_id", "revision", "outcome", "current_generation_id", "completion_status")


_PRIORITY_TYPES = (("1-URGENT", "adres-bildirimi"), ("2-HIGH", "fatura-islemi"), ("3-MEDIUM", "ruhsat-sorgusu"))


@query("eligible_cases", f"""
WITH {values('m', 'p, rt', _PRIORITY_TYPES)}
SELECT o_orderkey AS case_id, rt AS request_type_id FROM orders JOIN m ON p = o_orderpriority WHERE o_orderstatus <> 'P'""")
def eligible_cases(spark, folder):
    types = F.create_map(*[F.lit(v) for pair in _PRIORITY_TYPES for v in pair])
    cases = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("classified").alias("status"),
        F.coalesce(F.try_element_at(types, F.col("o_orderpriority")), F.lit("other-type")).alias("request_type_id"))
    return V.eligible(cases, default_registry(spark)).select("case_id", "request_type_id")


@query("supplement_answers", r"""
WITH c AS (SELECT c_custkey AS k, c_name, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS p FROM customer),
r AS (SELECT k, 'phone' AS kind, CASE WHEN k % 3 = 0 THEN '' ELSE ' 05' || CASE WHEN k % 3 = 1 THEN '0 ' ELSE '-' END || p || ' ' END AS v FROM c
  UNION ALL SELECT k, 'date', CASE WHEN k % 2 = 0 THEN '2026-08-' || lpad(CAST(k % 40 AS VARCHAR), 2, '0') ELSE 'soon' END FROM c
  UNION ALL SELECT k, 'text', '  ' || c_name || chr(10) || ' of  ' || k || ' ' FROM c)
SELECT k AS case_id, kind, CASE kind WHEN 'phone' THEN regexp_replace(v, '[ ()-]', '', 'g') WHEN 'date' THEN regexp_replace(v, '^(\d{4})-(\d{2})-(\d{2})$', '\3.\2.\1') ELSE c_trim END AS value,
  CASE WHEN regexp_replace(v, '\s', '', 'g') = '' THEN kind || ' alanını doldurun.' WHEN kind = 'phone' AND k % 3 <> 2 THEN 'Cep telefonu 05XX XXX XX XX biçiminde olmalıdır.'
    WHEN kind = 'date' AND v = 'soon' THEN 'date geçerli bir tarih olmalıdır.' END AS issue
FROM (SELECT *, regexp_replace(regexp_replace(v, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS c_trim FROM r)""")
def supplement_answers(spark, folder):
    k = F.col("k")
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    phone = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" 05"), F.when(k % 3 == 1, "0 ").otherwise("-"), _padded(k, 9), F.lit(" ")))
    day = F.when(k % 2 == 0, F.concat(F.lit("2026-08-"), _padded(k % 40, 2))).otherwise("soon")
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    rows = base.select("k", F.explode(F.array(entry("phone", phone), entry("date", day), entry(
        "text", F.concat(F.lit("  "), "c_name", F.lit("\n of  "), k.cast("string"), F.lit(" "))))).alias("e"))
    kind, v = F.col("e.kind"), F.col("e.v")
    return rows.select(F.col("k").alias("case_id"), kind.alias("kind"), V.supplement_value(kind, v).alias("value"), V.supplement_issue(kind, kind, v).alias("issue"))


# --- change requests over conversations -------------------------------------
# A conversation is a case, a turn a request; the role is the idempotency key.

def _requests(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("idempotency_key"),
                        (1 + F.floor(F.col("turn") / 2)).cast("bigint").alias("revision"), "text")


_REQ = "req AS (SELECT conv_id * 1000 + turn AS seq, conv_id, CAST(conv_id AS VARCHAR) AS case_id, role, 1 + turn // 2 AS rev, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM conversations)"


@query("supplement_outcomes", rf"""
WITH RECURSIVE {_REQ},
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n, regexp_replace(body, '^\s+|\s+$', '', 'g') AS v FROM req),
st AS (
  SELECT case_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, CASE WHEN conv_id % 10 <> 9 THEN CAST(1 + conv_id % 2 AS BIGINT) END AS cur, CAST(NULL AS VARCHAR) AS adr, MAP {{}}::MAP(VARCHAR, VARCHAR) AS rec, '' AS outcome FROM (SELECT DISTINCT case_id, conv_id FROM r)
  UNION ALL
  SELECT case_id, n, seq, CASE WHEN o = 'applied' THEN cur + 1 ELSE cur END, CASE WHEN o = 'applied' THEN v ELSE adr END,
    CASE WHEN o IN ('applied', 'unchanged') THEN map_concat(rec, MAP {{role: fp}}) ELSE rec END, o
  FROM (SELECT r.case_id, r.n, r.seq, s.cur, s.adr, s.rec, r.role, r.v, r.rev || '|' || r.f || '|' || r.v AS fp,
      CASE WHEN r.v = '' THEN 'bad_fields' WHEN s.rec[r.role] IS NOT NULL THEN CASE WHEN s.rec[r.role] = r.rev || '|' || r.f || '|' || r.v THEN 'replay' ELSE 'key_reused' END
        WHEN s.cur IS NULL THEN 'not_found' WHEN s.cur <> r.rev THEN 'revision_conflict' WHEN r.f <> 'new-address' THEN 'unknown_field'
        WHEN s.adr IS NOT DISTINCT FROM r.v THEN 'unchanged' ELSE 'applied' END AS o
    FROM st s JOIN (SELECT *, CASE WHEN conv_id % 7 = 3 AND n % 3 = 0 THEN 'colour' ELSE 'new-address' END AS f FROM r) r ON r.case_id = s.case_id AND r.n = s.n + 1))
SELECT seq, case_id, outcome, coalesce(cur, -1) AS revision_after FROM st WHERE n > 0""")
def supplement_outcomes(spark, folder):
    requests = _requests(spark, folder)
    turn = F.col("seq") % 1000
    odd_field = (F.col("case_id").cast("long") % 7 == 3) & ((turn + 1) % 3 == 0)
    value = Q.strip(F.col("text"))
    requests = requests.withColumn("fields", F.create_map(F.when(odd_field, "colour").otherwise("new-address"), value)).drop("text")
    cases = requests.select("case_id").distinct().where(F.col("case_id").cast("long") % 10 != 9)
    gaps = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(l).alias("label")) for i, l, _k, need in fixed.FIELD_REGISTRY["adres-bildirimi"] if need])
    state = cases.select(
        "case_id", (1 + F.col("case_id").cast("long") % 2).alias("revision"), F.lit("adres-bildirimi").alias("request_type_id"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{V.CANDIDATE}>")).alias("accepted_fields"), gaps.alias("missing_fields"),
        F.array().cast("array<struct<id:string,label:string,code:string>>").alias("invalid_fields"), F.lit("{}").alias("source_metadata"))
    return Q.apply_supplements(requests, state, default_registry(spark))


@query("start_outcomes", rf"""
WITH {_REQ},
j AS (SELECT *, CASE WHEN conv_id % 10 = 9 THEN 'CASE_NOT_FOUND' WHEN rev <> 1 + conv_id % 3 THEN 'CASE_REVISION_CONFLICT' WHEN conv_id % 4 = 0 THEN 'CASE_NOT_READY_FOR_CORRESPONDENCE' END AS bad FROM req),
w AS (SELECT case_id, role, min(seq) AS won, arg_min(rev, seq) AS won_rev FROM j WHERE bad IS NULL GROUP BY 1, 2)
SELECT j.seq, j.case_id, CASE WHEN j.seq > won AND won_rev <> rev THEN 'IDEMPOTENCY_KEY_REUSED' WHEN j.seq > won THEN 'replay' WHEN bad IS NOT NULL THEN bad ELSE 'queued' END AS outcome
FROM j LEFT JOIN w ON w.case_id = j.case_id AND w.role = j.role""")
def start_outcomes(spark, folder):
    requests = _requests(spark, folder).drop("text")
    case = F.col("case_id").cast("long")
    state = requests.select("case_id").distinct().where(case % 10 != 9).select(
        "case_id", (1 + case % 3).alias("revision"), F.when(case % 4 == 0, "missing_information").otherwise("complete").alias("completion_status"))
    return Q.start_requests(requests, state).select("seq", "case_id", "outcome")


@query("review_outcomes", rf"""
WITH {_REQ},
j AS (SELECT *, CASE WHEN conv_id % 10 = 9 OR rev <> 1 + conv_id % 3 THEN 'CASE_REVISION_CONFLICT' WHEN conv_id % 4 = 0 THEN 'CASE_NOT_REVIEWABLE' END AS bad FROM req),
w AS (SELECT case_id, min(seq) AS won, arg_min(role, seq) AS won_role, arg_min(rev, seq) AS won_rev FROM j WHERE bad IS NULL GROUP BY 1)
SELECT j.seq, j.case_id, CASE WHEN j.seq > won AND role = won_role THEN CASE WHEN rev = won_rev THEN 'replay' ELSE 'IDEMPOTENCY_KEY_REUSED' END
  WHEN bad IS NOT NULL THEN bad WHEN j.seq > won THEN 'CASE_NOT_REVIEWABLE' ELSE 'completed' END AS outcome FROM j LEFT JOIN w USING (case_id)""")
def review_outcomes(spark, folder):
    requests = _requests(spark, folder).drop("text")
    case = F.col("case_id").cast("long")
    state = requests.select("case_id").distinct().where(case % 10 != 9).select(
        "case_id", (1 + case % 3).alias("revision"), F.when(case % 4 == 0, "extracting").otherwise("needs_review").alias("state"))
    return Q.complete_reviews(requests, state).select("seq", "case_id", "outcome")
