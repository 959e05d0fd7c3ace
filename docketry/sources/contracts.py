"""Payload contracts: first failure wins.

``Rule`` lists are flat contracts with a message per rule; ``with_schema_error`` compiles
a nested JSON schema into one expression over the parsed payload.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.scale import once
from docketry.functions.text import let


@dataclass(frozen=True)
class Rule:
    check: str          # keys | exact_keys | const | filled | enum | string | object | nullable_string
    field: str | None
    values: tuple
    message: str
    optional: bool = False


DOCUMENT_INPUT = (
    Rule("keys", None, ("schemaVersion", "requestId", "documentId", "sourceType", "text", "sourceMetadata", "correlationId"), "Invalid request fields"),
    Rule("const", "schemaVersion", ("2.0",), "schemaVersion must be 2.0"),
    Rule("filled", "requestId", (), "requestId must be a non-empty string"),
    Rule("filled", "documentId", (), "documentId must be a non-empty string"),
    Rule("enum", "sourceType", ("text", "ocr"), "sourceType must be text or ocr"),
    Rule("string", "text", (), "text must be a string"),
    Rule("object", "sourceMetadata", (), "sourceMetadata must be an object", optional=True),
    Rule("nullable_string", "correlationId", (), "correlationId must be a string or null", optional=True),
)
_INTAKE_MESSAGE = "Invalid ocr-result payload"
INTAKE_RESULT = (
    Rule("exact_keys", None, ("schemaVersion", "requestId", "documentId", "workflowId", "caseId", "text", "language", "confidence", "ingestStatus", "warnings"), _INTAKE_MESSAGE),
    Rule("const", "schemaVersion", ("2.0",), _INTAKE_MESSAGE),
    *(Rule("filled", name, (), _INTAKE_MESSAGE) for name in ("requestId", "documentId", "workflowId", "text")),
)
_CLASS_MESSAGE = "Invalid classification-result payload"
CLASSIFICATION_RESULT = (
    Rule("exact_keys", None, ("schemaVersion", "requestId", "documentId", "workflowId", "status", "department", "unit", "requestType",
                              "confidence", "taxonomyVersion", "classifierVersion", "classificationReason"), _CLASS_MESSAGE),
    Rule("const", "schemaVersion", ("3.0",), _CLASS_MESSAGE),
    *(Rule("filled", name, (), _CLASS_MESSAGE) for name in ("requestId", "documentId", "workflowId")),
)


def _with_json(df: DataFrame, payload: str) -> DataFrame:
    """Add _doc, the value of a text that holds exactly one JSON value, null otherwise.

    The parser stops behind the first value and accepts whatever follows. Text that parses as the
    only item of an array and as a member of an object has nothing behind its value.
    """
    around = lambda head, tail: F.try_parse_json(F.concat(F.lit(head), F.col(payload), F.lit(tail)))
    both = once(df, _item=around("[", "]"), _member=around('{"v":', "}"))
    alone = F.col("_member").isNotNull() & (F.size(F.try_variant_get("_item", "$", "array<variant>")) == 1)
    return once(both, _doc=F.when(alone, F.try_variant_get("_item", "$[0]", "variant"))).drop("_item", "_member")


def with_first_error(df: DataFrame, contract: tuple[Rule, ...], payload: str = "payload", out: str = "error") -> DataFrame:
    """Add the message of the first broken rule, null for a conforming payload.

    The payload is parsed once, then the type of every named field is read once;
    the rules themselves only compare those small columns.
    """
    names = sorted({rule.field for rule in contract if rule.field})
    parsed = once(_with_json(df, payload), _keys=F.json_object_keys(payload))
    kind_of = lambda name: F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant"))
    text_of = lambda name: F.try_variant_get("_doc", f"$.{name}", "string")
    read = once(parsed, _kinds=F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(kind_of, names))),
                _texts=F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(text_of, names))))
    keys = F.col("_keys")
    kind = lambda name: F.try_element_at(F.col("_kinds"), F.lit(name))
    text = lambda name: F.try_element_at(F.col("_texts"), F.lit(name))

    def holds(rule: Rule) -> Column:
        allowed = F.array(*[F.lit(v) for v in rule.values])
        is_string = kind(rule.field) == "STRING" if rule.field else None
        if rule.check == "keys":
            return F.size(F.array_except(keys, allowed)) == 0
        if rule.check == "exact_keys":
            return (F.size(F.array_except(keys, allowed)) == 0) & (F.size(F.array_except(allowed, keys)) == 0)
        if rule.check in ("const", "enum"):
            return is_string & text(rule.field).isin(*rule.values)
        if rule.check == "filled":
            return is_string & (text(rule.field) != "")
        if rule.check == "string":
            return is_string
        if rule.check == "object":
            return kind(rule.field).startswith("OBJECT")
        return is_string | (kind(rule.field) == "VOID")

    def broken(rule: Rule) -> Column:
        fails = ~F.coalesce(holds(rule), F.lit(False))
        return fails & F.array_contains(keys, rule.field) if rule.optional else fails

    not_object = F.when(F.col("_doc").isNull(), "Invalid JSON").when(keys.isNull(), contract[0].message)
    error = F.coalesce(not_object, *[F.when(broken(rule), rule.message) for rule in contract])
    return once(read, **{out: error}).drop("_doc", "_keys", "_kinds", "_texts")


def conform(df: DataFrame, contract: tuple[Rule, ...], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Split records into conforming rows and quarantined rows with the reason."""
    checked = with_first_error(df, contract, payload)
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


# --- nested schemas -----------------------------------------------------------

INVALID_JSON = "Invalid JSON"
_KEYWORDS = {"type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength",
             "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "oneOf", "anyOf", "allOf", "$ref"}
_NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment", "format"}


@dataclass(frozen=True)
class _Place:
    """A value inside a parsed payload: a variant column and the way down from it.

    Checks read the value straight from ``root``, so an expression does not grow with
    the depth of its schema; only array items start a new root.
    """
    root: Column
    steps: str = "$"
    shown: tuple = ("$",)

    def child(self, key: str) -> _Place:
        if "'" in key or "\\" in key:
            raise ValueError(f"unsupported property name: {key}")
        return _Place(self.root, f"{self.steps}['{key}']", (*self.shown, f".{key}"))

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.root, self.steps, kind)

    def path(self) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in self.shown])


def _is_type(name: str, kind: Column) -> Column:
    if name == "integer":
        return kind.rlike(r"^(BIGINT$|DECIMAL\((19|[23]\d),0\)$)")
    if name == "number":
        return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if name in ("object", "array"):
        return kind.startswith(name.upper())
    return kind == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]


def _equals(place: _Place, kind: Column, value) -> Column:
    if value is None:
        return _is_type("null", kind)
    if isinstance(value, bool):
        return _is_type("boolean", kind) & (place.get("boolean") == value)
    if isinstance(value, (int, float)):
        return _is_type("number", kind) & (place.get("double") == float(value))
    if isinstance(value, str):
        return _is_type("string", kind) & (place.get("string") == value)
    raise ValueError("only plain values can be constants")


def _violation(schema: Mapping | bool, place: _Place, schemas: Mapping[str, Mapping], open_refs: tuple = (), kind: Column | None = None) -> Column:
    """Path of the first broken part of ``schema``, null when the value conforms or is absent.

    ``kind`` is the kind of a value that is known to be there; without it the value is read once.
    """
    if isinstance(schema, bool):
        here = place.path() if kind is not None else F.when(place.get("variant").isNotNull(), place.path())
        return F.lit(None).cast("string") if schema else here
    unknown = set(schema) - _KEYWORDS - _NOTES
    if unknown:
        raise ValueError(f"unsupported keywords: {sorted(unknown)}")
    first_broken = lambda kind: F.coalesce(F.lit(None).cast("string"), *_checks(schema, place, kind, schemas, open_refs))
    if kind is not None:
        return first_broken(kind)
    # The kind is read once per value: inside lambdas nothing else would share it.
    return let(F.schema_of_variant(place.get("variant")), lambda kind: F.when(kind.isNotNull(), first_broken(kind)))


def _checks(schema: Mapping, place: _Place, kind: Column, schemas: Mapping[str, Mapping], open_refs: tuple) -> list[Column]:
    """One expression per keyword, in order: the path where it is broken, or null."""
    also = lambda part: _violation(part, place, schemas, open_refs, kind)
    inside = lambda part, at: _violation(part, at, schemas, open_refs)
    is_a = lambda name: _is_type(name, kind)
    found = []

    def must(holds: Column, at: _Place = place) -> None:
        found.append(F.when(~F.coalesce(holds, F.lit(False)), at.path()))

    if "$ref" in schema:
        ref = schema["$ref"]
        if ref in open_refs:
            raise ValueError(f"recursive schema: {ref}")
        if ref not in schemas:
            raise ValueError(f"unknown schema: {ref}")
        found.append(_violation(schemas[ref], place, schemas, (*open_refs, ref), kind))
    if "const" in schema:
        must(_equals(place, kind, schema["const"]))
    if "enum" in schema:
        must(F.array_contains(F.array(*[F.coalesce(_equals(place, kind, v), F.lit(False)) for v in schema["enum"]]), True))
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        must(F.array_contains(F.array(*map(is_a, names)), True))

    properties = schema.get("properties", {})
    for key in schema.get("required", ()):
        must(~is_a("object") | place.child(key).get("variant").isNotNull(), place.child(key))
    extra = schema.get("additionalProperties", True)
    if extra is False:
        foreign = F.array_except(F.map_keys(place.get("map<string,variant>")), F.array(*map(F.lit, properties)).cast("array<string>"))
        must(~is_a("object") | (F.size(foreign) == 0))
    elif extra is not True:
        raise ValueError("additionalProperties must be true or false")
    # What is no object has no children: absent values conform.
    found += [inside(part, place.child(key)) for key, part in properties.items()]
    found += _item_checks(schema, place, kind, inside)

    text, number = place.get("string"), place.get("double")
    for name, fits in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n), ("pattern", lambda p: text.rlike(p))):
        if name in schema:
            must(~is_a("string") | fits(schema[name]))
    for name, fits in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n), ("exclusiveMinimum", lambda n: number > n), ("exclusiveMaximum", lambda n: number < n)):
        if name in schema:
            must(~is_a("number") | fits(schema[name]))
    found += [also(part) for part in schema.get("allOf", ())]
    for name, fits in (("oneOf", lambda n: n == 1), ("anyOf", lambda n: n >= 1)):
        if name in schema:
            must(fits(sum((also(part).isNull().cast("int") for part in schema[name]), F.lit(0))))
    return found


def _item_checks(schema: Mapping, place: _Place, kind: Column, inside) -> list[Column]:
    """Length and item checks of an array, which is taken apart once."""
    if not {"minItems", "maxItems", "items"} & set(schema):
        return []

    def broken(items: Column) -> Column:
        found = [F.lit(None).cast("string")]
        if "minItems" in schema:
            found.append(F.when(F.size(items) < schema["minItems"], place.path()))
        if "maxItems" in schema:
            found.append(F.when(F.size(items) > schema["maxItems"], place.path()))
        if "items" in schema:
            number = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
            paths = F.transform(items, lambda item, i: inside(schema["items"], _Place(item, "$", (*place.shown, number(i)))))
            found.append(F.get(F.filter(paths, lambda p: p.isNotNull()), F.lit(0)))
        return F.coalesce(*found)

    return [F.when(_is_type("array", kind), let(place.get("array<variant>"), broken))]


def with_schema_error(df: DataFrame, schema: Mapping, payload: str = "payload", out: str = "error", schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Add the path of the first broken part of a JSON schema, null for a conforming payload.

    The schema (types, const, enum, required and closed properties, array and text lengths,
    pattern, ranges, items, oneOf, anyOf, allOf) becomes one expression, with nested objects and
    arrays checked in place: map-only, no Python, one parsed value per row. A ``$ref`` is looked up in
    ``schemas`` by its text, local ones (``#/$defs/x``) included; recursive and unknown ones, and
    keywords outside this list, are refused. Within a value the order is: $ref, const, enum, type, required,
    foreign keys, properties in their order, items, lengths, ranges, alternatives. A null payload
    or text that is no JSON gives ``Invalid JSON``; whole numbers written with a fraction are no integers.
    """
    local = {f"#/{group}/{name}": part for group in ("$defs", "definitions") for name, part in schema.get(group, {}).items()}
    parsed = _with_json(df, payload)
    broken = _violation(schema, _Place(F.col("_doc")), {**local, **(schemas or {})})
    return once(parsed, **{out: F.when(F.col("_doc").isNull(), INVALID_JSON).otherwise(broken)}).drop("_doc")


def integrity_violations(classification: DataFrame, tickets: DataFrame, states: DataFrame) -> DataFrame:
    """Table constraints as data-quality rows (rule, id)."""
    chain = ["department_id", "department_label", "unit_id", "unit_label", "request_type_id", "request_type_label"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in chain), F.lit(0))
    rule = lambda df, name, bad, key: df.where(F.coalesce(bad, F.lit(True))).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("id"))
    return (
        rule(classification, "chain_all_or_none", ~filled.isin(0, len(chain)), "document_id")
        .unionByName(rule(classification, "confidence_range", ~F.col("confidence").between(0, 1), "document_id"))
        .unionByName(rule(classification.where("status = 'classified'"), "classified_needs_score",
                          ~((F.col("confidence") > 0.80) & F.col("department_id").isNotNull()), "document_id"))
        .unionByName(rule(tickets, "ticket_format", ~F.col("ticket_reference").rlike("^CA-[0-9A-F]{8}$"), "case_id"))
        .unionByName(rule(states, "priority_score_known", ~F.col("priority_score").isin(40, 70, 100), "case_id"))
    )
