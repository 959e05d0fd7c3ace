import pytest
from pyspark.sql import functions as F

from docketry.operators import fields as V, requests as Q
from docketry.sources import contracts, loaders

VALUES = [
    ("tckn", "10000000146", "10000000146", None), ("tckn", "12345678901", None, "tckn_checksum"), ("tckn", "1000000014", None, "tckn_checksum"),
    ("tckn", "00000000000", None, "tckn_checksum"), ("phone-tr", "5321234567", "+905321234567", None), ("phone-tr", "05321234567", "+905321234567", None),
    ("phone-tr", "+905321234567", "+905321234567", None), ("phone-tr", "0532 123-45(67)", "+905321234567", None), ("phone-tr", "02121234567", None, "phone_format"),
    ("date", "25.08.2026", "2026-08-25", None), ("date", "5.8.2026", "2026-08-05", None), ("date", "2026-02-30", None, "date_format"), ("date", "29.02.2024", "2024-02-29", None),
    ("date", "123.8.2026", None, "date_format"), ("date", "soon", None, "date_format"), ("date", "2026-8-5", None, "date_format"), ("money-try", "12.50", "12.50", None), ("money-try", "012.50", None, "money_format"), ("money-try", "12.5", None, "money_format"),
    ("free-text", "x" * 4096, "x" * 4096, None), ("free-text", "x" * 4097, None, "schema_rule"), ("free-text", "  ", None, "schema_rule"), ("document-number", " A-1 ", "A-1", None), ("free-text", None, None, "schema_rule"),
]


def test_typed_values(frame):
    rows = frame([(n, k, v) for n, (k, v, _o, _e) in enumerate(VALUES)], "n int, k string, v string")
    got = rows.select("n", V.validate_value(F.col("k"), F.col("v"), F.lit("{}")).alias("r")).orderBy("n").collect()
    assert [(r.r.value, r.r.error) for r in got] == [(o, e) for _k, _v, o, e in VALUES]


@pytest.mark.parametrize("metadata, verdict", [
    ("{}", "absent"), ('{"attachments":null}', "absent"), ('{"attachments":[]}', "attachment_missing"), ('{"attachments":[{}]}', "attachment_missing"),
    ('{"attachments":"a"}', "attachment_missing"), ('{"attachments":[{"attachmentId":5}]}', "attachment_missing"), ('{"attachments":[{"attachmentId":"a"}]}', "present"),
    ('{"attachments":[{"attachmentId":"a","filename":""}]}', "attachment_missing"), ('{"attachments":[{"attachmentId":"a","contentType":"görsel"}]}', "attachment_missing"),
    ('{"attachments":[{"attachmentId":"a","filename":"f","contentType":"image/png"}]}', "present")])
def test_attachments(frame, metadata, verdict):
    assert frame([(metadata,)], "m string").select(V.validate_attachments(F.col("m")).alias("v")).first().v == verdict


def evaluate(spark, frame, text, prior=None, metadata="{}", kind="adres-bildirimi"):
    registry = loaders.default_registry(spark)
    case = frame([(kind, text, prior, metadata)], f"request_type_id string, normalized_text string, prior_fields {V.CANDIDATES}, source_metadata string")
    return V.evaluate_fields(V.labeled_candidates(case, registry), registry).first()


def test_labels_override_patterns_and_empty_label_keeps_the_next(spark, frame):
    row = evaluate(spark, frame, "applicant-name: Ali Veli\r\nPHONE : 5321234567\r\nnew-address:\r\ntckn: 10000000146")
    assert {f.id: (f.value, f.confidence) for f in row.extracted_fields} == {
        "applicant-name": ("Ali Veli", 0.8), "tckn": ("10000000146", 0.8), "new-address": ("tckn: 10000000146", 0.8), "phone": ("+905321234567", 0.8)}
    assert row.completion_status == "complete" and not row.user_action_required


def test_invalid_keeps_prior_and_dominates_missing(spark, frame):
    row = evaluate(spark, frame, "tckn: 12345678901", {"tckn": ("10000000146", 1.0)})
    assert [(f.id, f.value) for f in row.extracted_fields] == [("tckn", "10000000146")]
    assert [f.id for f in row.missing_fields] == ["applicant-name", "new-address"]
    assert [(f.id, f.code) for f in row.invalid_fields] == [("tckn", "tckn_checksum")]
    assert row.completion_status == "invalid_information"


def test_first_json_object(frame):
    answers = [('```json\n{"a": "b"}\n``` bye',), ("{bad {\"x\": 1} y}",), ("[1, 2]",), (None,), ("{",)]
    got = [r.v for r in frame(answers, "t string").select(V.first_json_object(F.col("t")).alias("v")).collect()]
    assert got == ['{"a": "b"}', '{"x": 1}', None, None, None]


def test_contract_messages(frame):
    ok = '{"schemaVersion":"2.0","requestId":"r","documentId":"d","sourceType":"text","text":"x"}'
    rows = frame([(1, ok), (2, ok.replace('"text":"x"', '"text":7')), (3, ok.replace("}", ',"z":1}')), (4, ok.replace("}", ',"correlationId":null}')), (5, "nope"), (6, "[1]"), (7, ok.replace('"d"', '""'))], "n int, payload string")
    good, bad = contracts.conform(rows, contracts.DOCUMENT_INPUT)
    assert {r.n for r in good.collect()} == {1, 4}
    assert {r.n: r.error for r in bad.collect()} == {2: "text must be a string", 3: "Invalid request fields", 5: "Invalid JSON", 6: "Invalid request fields", 7: "documentId must be a non-empty string"}


def broken_path(schema, value, refs, path="$"):
    """The first broken part of a schema, walked value by value."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    is_a = lambda name: isinstance(value, kinds[name]) and not (name in ("number", "integer") and isinstance(value, bool))
    same = lambda a, b: type(a) is type(b) and a == b
    if "$ref" in schema:
        inner = broken_path(refs[schema["$ref"]], value, refs, path)
        if inner:
            return inner
    if "const" in schema and not same(schema["const"], value) or "enum" in schema and not any(same(v, value) for v in schema["enum"]):
        return path
    if "type" in schema and not any(is_a(n) for n in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])):
        return path
    if isinstance(value, dict):
        for key in schema.get("required", []):
            if key not in value:
                return f"{path}.{key}"
        if schema.get("additionalProperties") is False and set(value) - set(schema.get("properties", {})):
            return path
        for key, part in schema.get("properties", {}).items():
            inner = broken_path(part, value[key], refs, f"{path}.{key}") if key in value else None
            if inner:
                return inner
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", 99):
            return path
        for n, item in enumerate(value):
            inner = broken_path(schema["items"], item, refs, f"{path}[{n}]") if "items" in schema else None
            if inner:
                return inner
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 99):
        return path
    if is_a("number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return path
    if "oneOf" in schema and sum(broken_path(s, value, refs, path) is None for s in schema["oneOf"]) != 1:
        return path
    return None


def test_nested_schemas_against_a_walk(frame):
    import json
    import random

    schema = {
        "type": "object", "additionalProperties": False, "required": ["a"],
        "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 3}, "b": {"enum": ["x", None, 2, True]}, "c": {"type": ["array", "null"], "minItems": 1, "maxItems": 2, "items": {"$ref": "#/$defs/n"}},
                       "d": {"oneOf": [{"type": "string", "minLength": 2}, {"type": "string", "maxLength": 3}, {"type": "null"}]}, "e": {"const": "1.0"}},
        "$defs": {"n": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "minLength": 1}, "l": {"type": "array", "items": {"type": "number", "maximum": 5}}, "m": {"$ref": "other"}}}}}
    refs = {"#/$defs/n": schema["$defs"]["n"], "other": {"type": "object", "additionalProperties": False, "properties": {"z": {"type": "boolean"}}}}
    rng = random.Random(3)
    loose = lambda: rng.choice([None, True, 0, 1, 2, 2.5, 9, "", "x", "ş😀", "long", [], {}, [1], {"k": 1}])
    some = lambda make, odds=0.15: loose() if rng.random() < odds else make()
    item = lambda: {k: v for k, v in {"k": some(lambda: "ok"), "l": some(lambda: [some(lambda: rng.randint(0, 6), 0.1) for _ in range(rng.randint(0, 4))]), "m": some(lambda: {"z": some(lambda: True)})}.items() if rng.random() < 0.8}
    parts = {"a": lambda: rng.randint(1, 3), "b": lambda: rng.choice(["x", None, 2, True]), "c": lambda: [some(item, 0.1) for _ in range(rng.randint(0, 3))], "d": lambda: rng.choice(["a", "abcd", None, "ab"]), "e": lambda: "1.0"}
    values = [some(lambda: {**{k: some(make) for k, make in parts.items() if rng.random() < 0.85}, **({"zz": 1} if rng.random() < 0.05 else {})}, 0.05) for _ in range(600)]
    broken = [None, "{", "", '{"a":1}}', '{"a":1}] x', '{"a":1},{"a":1}', '{"a":1} x', '{"a":1}{"a":1}', '1,"v":2']
    rows = frame([(n, json.dumps(v)) for n, v in enumerate(values)] + [(-1 - n, text) for n, text in enumerate(broken)] + [(700, ' {"a":1}\n')], "n int, payload string")
    got = {r.n: r.error for r in contracts.with_schema_error(rows, schema, schemas={"other": refs["other"]}).collect()}
    assert got.pop(700) is None and [got.pop(-1 - n) for n in range(len(broken))] == ["Invalid JSON"] * len(broken)
    assert got == {n: broken_path(schema, v, refs) for n, v in enumerate(values)}
    assert len(set(got.values())) > 15 and sum(v is None for v in got.values()) > 10
    for bad in ({"uniqueItems": True}, {"$ref": "nowhere"}, {"properties": {"it's": {}}}, {"$defs": {"r": {"items": {"$ref": "#/$defs/r"}}}, "$ref": "#/$defs/r"}):
        with pytest.raises(ValueError):
            contracts.with_schema_error(rows, bad)


def supplement_state(frame):
    fields = [{"id": i} for i in ("applicant-name", "tckn", "new-address")]
    return frame([("c", 1, "adres-bildirimi", {}, fields, [], "{}")],
                 f"case_id string, revision long, request_type_id string, accepted_fields {V.CANDIDATES}, missing_fields array<struct<id:string>>, invalid_fields array<struct<id:string,code:string>>, source_metadata string")


def test_supplement_chain(spark, frame):
    requests = frame([
        (1, "c", "k1", 1, {"new-address": " Street 1 "}), (2, "c", "k1", 1, {"new-address": "Street 1"}), (3, "c", "k1", 1, {"new-address": "Street 2"}),
        (4, "c", "k2", 1, {"new-address": "Street 3"}), (5, "c", "k3", 2, {"new-address": "Street 1"}), (6, "c", "k4", 2, {"colour": "red"}), (7, "c", "k5", 2, {"tckn": "1"}),
        (8, "c", "k6", 3, {"tckn": "10000000146"}), (9, "c", "k7", 4, {"phone": " "}), (10, "x", "k8", 1, {"phone": "5321234567"})],
        "seq long, case_id string, idempotency_key string, revision long, fields map<string,string>")
    for parts in (1, 7):
        got = Q.apply_supplements(requests.repartition(parts), supplement_state(frame), loaders.default_registry(spark)).orderBy("seq").collect()
        assert [(r.outcome, r.revision_after) for r in got] == [
            ("applied", 2), ("replay", 2), ("key_reused", 2), ("revision_conflict", 2), ("unchanged", 2), ("unknown_field", 2), ("applied", 3), ("applied", 4), ("bad_fields", 4), ("not_found", -1)]


def test_revision_merge_ignores_map_order(frame):
    schema = f"case_id long, accepted_fields {V.CANDIDATES}, missing_fields array<string>, invalid_fields array<string>, completion_status string"
    prior = frame([(1, {"a": ("x", 1.0), "b": ("y", 1.0)}, [], [], "complete", 3, "g"), (2, {}, [], [], "complete", 1, "h")], schema + ", revision long, current_generation_id string")
    new = frame([(1, {"b": ("y", 1.0), "a": ("x", 1.0)}, [], [], "complete"), (2, {}, ["p"], [], "missing_information"), (3, {}, [], [], "complete")], schema)
    got = {r.case_id: (r.revision, r.outcome, r.current_generation_id) for r in V.merge_validation(prior, new).collect()}
    assert got == {1: (3, "unchanged", "g"), 2: (2, "changed", None), 3: (1, "created", None)}


def test_review_and_start_replays(frame):
    requests = frame([(1, "c", "k", 2), (2, "c", "j", 1), (3, "c", "m", 1), (4, "c", "j", 1), (5, "c", "j", 2), (6, "d", "k", 1)], "seq long, case_id string, idempotency_key string, revision long")
    state = frame([("c", 1, "needs_review", "complete"), ("d", 1, "completed", "missing_information")], "case_id string, revision long, state string, completion_status string")
    review = [r.outcome for r in Q.complete_reviews(requests, state).orderBy("seq").collect()]
    assert review == ["CASE_REVISION_CONFLICT", "completed", "CASE_NOT_REVIEWABLE", "replay", "IDEMPOTENCY_KEY_REUSED", "CASE_NOT_REVIEWABLE"]
    start = [r.outcome for r in Q.start_requests(requests, state).orderBy("seq").collect()]
    assert start == ["CASE_REVISION_CONFLICT", "queued", "queued", "replay", "IDEMPOTENCY_KEY_REUSED", "CASE_NOT_READY_FOR_CORRESPONDENCE"]
    stored = frame([("c", "j", 1)], "case_id string, idempotency_key string, revision long")
    assert [r.outcome for r in Q.complete_reviews(requests, state, stored).orderBy("seq").collect()] == [
        "CASE_REVISION_CONFLICT", "replay", "completed", "replay", "IDEMPOTENCY_KEY_REUSED", "CASE_NOT_REVIEWABLE"]


def test_decomposed_letters_are_composed_before_evaluation(spark, frame):
    import unicodedata
    plain = "Şişli Çağlayan Öğretmenler Sokağı 5"
    split = unicodedata.normalize("NFD", plain)
    case = frame([(1, "adres-bildirimi", split, "{}")], "case_id int, request_type_id string, v string, source_metadata string")
    case = case.withColumn("candidates", F.create_map(F.lit("new-address"), F.struct(F.col("v").alias("value"), F.lit(0.8).alias("confidence"))))
    case = case.withColumn("prior_fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{V.CANDIDATE}>")))
    got = V.evaluate_fields(case, loaders.default_registry(spark)).first()
    assert got.accepted_fields["new-address"].value == plain
    request = frame([(1, "c", "k", 1, {"new-address": split}), (2, "c", "l", 2, {"new-address": plain})], "seq long, case_id string, idempotency_key string, revision long, fields map<string,string>")
    state = frame([("c", 1, "adres-bildirimi", {}, [], [], "{}")], f"case_id string, revision long, request_type_id string, accepted_fields {V.CANDIDATES}, missing_fields array<struct<id:string,label:string>>, "
                  "invalid_fields array<struct<id:string,label:string,code:string>>, source_metadata string")
    out = Q.apply_supplements(request, state, loaders.default_registry(spark)).orderBy("seq").collect()
    assert [r.outcome for r in out] == ["applied", "unchanged"]
