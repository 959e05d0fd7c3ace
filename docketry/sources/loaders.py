"""Readers for documents and for the small reference tables that drive decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docketry.functions.scale import lookup, small_table, spread_small
from docketry.functions.text import text_fold
from docketry.sources import fixed

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("schemaVersion", T.StringType()),
    T.StructField("requestId", T.StringType()),
    T.StructField("documentId", T.StringType()),
    T.StructField("sourceType", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("sourceMetadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("correlationId", T.StringType()),
])
_NODE = "id string, label string, active boolean"
TAXONOMY_SCHEMA = (
    f"taxonomyVersion string, departments array<struct<{_NODE}>>, "
    f"units array<struct<{_NODE}, departmentId string>>, "
    "requestTypes array<struct<id string, label string, unitId string, keywords string, signals string>>"
)
FIELD_STRUCT = "array<struct<id string, label string, kind string, required boolean>>"
CORPUS_SCHEMA = (
    "corpus_version string, sources array<struct<source_id string, title string, source_type string, "
    "official_source_url string, chunks array<struct<chunk_id string, locator string, excerpt string, content string>>>>"
)


def table(spark: SparkSession, folder: str, name: str, spread: str | None = None) -> DataFrame:
    """A table of the folder; ``spread`` names a key to hash few small files over the cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_small(df, spread) if spread else df


def read_documents(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    """Document-input records; the streaming twin reads the same folder as files arrive."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(DOCUMENT_SCHEMA).format(fmt).load(path)


# --- taxonomy ---------------------------------------------------------------

def flatten_taxonomy(doc: DataFrame) -> dict[str, DataFrame]:
    """One taxonomy document per row -> departments, units, request types, keywords, signals.

    Keywords given as a plain list mean Turkish; a type without concept signals
    is read as one concept per keyword.
    """
    departments = doc.select(F.explode("departments").alias("d")).select(
        F.col("d.id").alias("department_id"), F.col("d.label").alias("department_label"),
        F.coalesce("d.active", F.lit(True)).alias("active"))
    units = doc.select(F.explode("units").alias("u")).select(
        F.col("u.id").alias("unit_id"), F.col("u.label").alias("unit_label"), F.col("u.departmentId").alias("department_id"),
        F.coalesce("u.active", F.lit(True)).alias("active"))
    types = doc.select("taxonomyVersion", F.posexplode("requestTypes").alias("type_ord", "t")).select(
        "type_ord", F.col("t.id").alias("request_type_id"), F.col("t.label").alias("request_type_label"),
        F.col("t.unitId").alias("unit_id"), F.col("taxonomyVersion").alias("taxonomy_version"),
        F.col("t.keywords").alias("_keywords"), F.col("t.signals").alias("_signals"))
    by_language = F.coalesce(
        F.from_json("_keywords", "map<string,array<string>>"),
        F.create_map(F.lit(fixed.DEFAULT_KEYWORD_LANGUAGE), F.from_json("_keywords", "array<string>")),
    )
    keywords = types.select("request_type_id", F.explode(by_language).alias("language", "words")).select(
        "request_type_id", "language", F.posexplode("words").alias("keyword_ord", "keyword"))
    groups = types.select("request_type_id", F.explode(F.from_json("_signals", "map<string,array<string>>")).alias("language", "listed"))
    forms = groups.select("request_type_id", "language", F.posexplode("listed").alias("group_ord", "raw")).select(
        "request_type_id", "language", "group_ord",
        F.posexplode(F.coalesce(F.from_json("raw", "array<string>"), F.array("raw"))).alias("form_ord", "form"))
    return {
        "departments": departments, "units": units,
        "request_types": types.drop("_keywords", "_signals"),
        "keywords": keywords, "signals": with_keyword_signals(keywords, forms),
    }


def with_keyword_signals(keywords: DataFrame, forms: DataFrame) -> DataFrame:
    implied = keywords.join(forms.select("request_type_id").distinct(), "request_type_id", "left_anti").select(
        "request_type_id", "language", F.col("keyword_ord").alias("group_ord"), F.lit(0).alias("form_ord"), F.col("keyword").alias("form"))
    return forms.unionByName(implied)


def load_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return flatten_taxonomy(spark.read.schema(TAXONOMY_SCHEMA).json(path, multiLine=True))


def default_taxonomy(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in chain and keyword lists; concept signals come from a file."""
    departments = small_table(spark, [(i, l, True) for i, l in fixed.DEPARTMENTS], "department_id string, department_label string, active boolean")
    units = small_table(spark, [(i, l, d, True) for i, l, d in fixed.UNITS], "unit_id string, unit_label string, department_id string, active boolean")
    types = small_table(spark, 
        [(n, r[0], r[1], r[2], fixed.TAXONOMY_VERSION) for n, r in enumerate(fixed.REQUEST_TYPES)],
        "type_ord int, request_type_id string, request_type_label string, unit_id string, taxonomy_version string")
    keywords = small_table(spark, 
        [(r[0], lang, n, w) for r in fixed.REQUEST_TYPES for lang, words in (("tr", r[3]), ("en", r[4])) for n, w in enumerate(words)],
        "request_type_id string, language string, keyword_ord int, keyword string")
    empty = small_table(spark, [], "request_type_id string, language string, group_ord int, form_ord int, form string")
    return {"departments": departments, "units": units, "request_types": types, "keywords": keywords,
            "signals": with_keyword_signals(keywords, empty)}


def _violation(df: DataFrame, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("id"))


def _duplicates(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    return _violation(df.groupBy(*keys).count().where("count > 1"), rule, F.concat_ws("/", *keys))


def taxonomy_violations(tax: dict[str, DataFrame]) -> DataFrame:
    """Broken rules of a taxonomy as (rule, id); an empty result means it is sound."""
    dep, units, types, words = tax["departments"], tax["units"], tax["request_types"], tax["keywords"]
    folded = words.select("request_type_id", "language", text_fold(F.col("keyword")).alias("keyword"))
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    parts = [
        _duplicates(dep, "department_id_unique", ["department_id"]),
        _duplicates(units, "unit_id_unique", ["unit_id"]),
        _duplicates(types, "request_type_id_unique", ["request_type_id"]),
        _violation(dep.where(missing("department_label")), "department_label_required", F.col("department_id")),
        _violation(units.where(missing("unit_label")), "unit_label_required", F.col("unit_id")),
        _violation(types.where(missing("request_type_label")), "request_type_label_required", F.col("request_type_id")),
        _violation(units.join(dep, "department_id", "left_anti"), "unit_department_reference", F.col("unit_id")),
        _violation(types.join(units, "unit_id", "left_anti"), "request_type_unit_reference", F.col("request_type_id")),
        _violation(types.join(words, "request_type_id", "left_anti"), "request_type_keywords_required", F.col("request_type_id")),
        _violation(folded.where(missing("keyword")), "keyword_non_empty", F.concat_ws("/", "request_type_id", "language")),
        _duplicates(folded.where(~missing("keyword")), "keyword_unique", ["request_type_id", "language", "keyword"]),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- field registry ---------------------------------------------------------

def flatten_registry(doc: DataFrame) -> DataFrame:
    """``schemas`` holds request type -> field list; one row per field definition."""
    return doc.select("schemaVersion", F.explode(F.from_json("schemas", f"map<string,{FIELD_STRUCT}>")).alias("request_type_id", "fields")).select(
        "request_type_id", F.posexplode("fields").alias("ord", "f"), F.col("schemaVersion").alias("schema_version")).select(
        "request_type_id", "ord", F.col("f.id").alias("field_id"), F.col("f.label").alias("label"), F.col("f.kind").alias("kind"),
        F.col("f.required").alias("required"), "schema_version")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return flatten_registry(spark.read.schema("schemaVersion string, schemas string").json(path, multiLine=True))


def default_registry(spark: SparkSession) -> DataFrame:
    rows = [(t, n, *f, fixed.FIELD_SCHEMA_VERSION) for t, fields in fixed.FIELD_REGISTRY.items() for n, f in enumerate(fields)]
    return small_table(spark, rows, "request_type_id string, ord int, field_id string, label string, kind string, required boolean, schema_version string")


def registry_violations(registry: DataFrame, expected_types: int = fixed.REGISTRY_TYPES) -> DataFrame:
    """Broken rules of a field registry as (rule, id). A registry is often parsed from JSON, so it is read
    three times, not once per rule: for the rules of a row, for the counts, and for the number of types."""
    c = F.col
    key = F.concat_ws("/", "request_type_id", "field_id")
    of_row = {
        "field_id_format": ~F.coalesce(c("field_id").rlike("^[a-z][a-z0-9-]*$"), F.lit(False)), "field_label_required": F.coalesce(F.length("label"), F.lit(0)) == 0,
        "field_kind_known": ~F.coalesce(c("kind").isin(*fixed.FIELD_KINDS), F.lit(False)), "field_required_flag": c("required").isNull(),
        "registry_version": F.coalesce("schema_version", F.lit("")) != fixed.FIELD_SCHEMA_VERSION}
    broken = registry.select(F.explode(F.array_compact(F.array(*[F.when(wrong, rule) for rule, wrong in of_row.items()]))).alias("rule"), key.alias("id"))
    type_id, field_id = c("request_type_id"), c("field_id")
    counts = registry.groupingSets([[type_id, field_id], [type_id]], type_id, field_id).agg(F.grouping("field_id").alias("whole"), F.count("*").alias("n"))
    counted = counts.where(c("n") > F.when(c("whole") == 1, fixed.MAX_FIELDS_PER_TYPE).otherwise(1)).select(
        F.when(c("whole") == 1, "too_many_fields").otherwise("field_id_unique").alias("rule"), F.when(c("whole") == 1, type_id).otherwise(key).alias("id"))
    total = registry.agg(F.countDistinct("request_type_id").alias("n")).where(c("n") != expected_types)
    return broken.unionByName(counted).unionByName(_violation(total, "request_type_count", c("n")))


# --- corpus and policy ------------------------------------------------------

def flatten_corpus(doc: DataFrame) -> DataFrame:
    """Sources x chunks with the source's own columns and the corpus version stamped on."""
    sources = doc.select("corpus_version", F.explode("sources").alias("s"))
    return sources.select("corpus_version", "s.source_id", "s.title", "s.source_type", "s.official_source_url", F.explode("s.chunks").alias("c")).select(
        "source_id", "title", "source_type", "official_source_url", "corpus_version", "c.chunk_id", "c.locator", "c.excerpt", "c.content")


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return flatten_corpus(spark.read.schema(CORPUS_SCHEMA).json(path, multiLine=True))


def build_chunks(articles: DataFrame) -> DataFrame:
    """Article lists per source -> chunk rows.

    ``articles`` carries one row per source with its ordered ``items``
    (locator, text), so numbering needs neither a shuffle nor a window.
    """
    return articles.select("source_id", "title", F.posexplode("items").alias("_i", "item")).select(
        "source_id", F.format_string("%s-chunk-%03d", F.col("source_id"), F.col("_i") + 1).alias("chunk_id"),
        F.col("item.locator").alias("locator"), F.substring("item.text", 1, fixed.MAX_EXCERPT_CHARACTERS).alias("excerpt"),
        F.concat(F.concat_ws(" ", "title", "item.locator"), F.lit(". "), F.col("item.text")).alias("content"))


def load_policy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """field_id -> redact / task_required / exclude."""
    if path is None:
        return small_table(spark, list(fixed.FIELD_HANDLING.items()), "field_id string, handling string")
    return spark.read.schema("fieldHandling string").json(path, multiLine=True).select(
        F.explode(F.from_json("fieldHandling", "map<string,string>")).alias("field_id", "handling"))


def policy_map(policy: DataFrame, most: int = 10_000) -> dict[str, str]:
    """A policy table as the map that redaction takes. One row per field: a table
    with more than ``most`` is refused, not cut."""
    rows = policy.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a policy names at most {most} fields")
    return {r["field_id"]: r["handling"] for r in rows}


# --- staff ------------------------------------------------------------------

def staff_registry(units: DataFrame) -> DataFrame:
    """Two members per unit: number 1 operates, number 2 moderates."""
    return units.select("unit_id", "unit_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select(
        F.format_string("%s-operator-%d", F.col("unit_id"), F.col("n")).alias("staff_id"),
        F.format_string("%s Operatörü %d", F.col("unit_name"), F.col("n")).alias("display_name"),
        F.when(F.col("n") == 1, "operator").otherwise("moderator").alias("role"), "unit_id", F.lit(True).alias("active"))


def default_staff(spark: SparkSession) -> DataFrame:
    return staff_registry(small_table(spark, list(fixed.STAFF_UNITS), "unit_id string, unit_name string"))


def attach_chain(df: DataFrame, tax: dict[str, DataFrame], bounded: bool = False) -> DataFrame:
    """request type -> unit -> department, ids and labels.

    ``bounded`` tells that the caller has measured the taxonomy already.
    """
    chain = (
        tax["request_types"].select("request_type_id", "request_type_label", "unit_id")
        .join(tax["units"].select("unit_id", "unit_label", "department_id"), "unit_id", "left")
        .join(tax["departments"].select("department_id", "department_label"), "department_id", "left")
    )
    return df.join(F.broadcast(chain) if bounded else lookup(chain), "request_type_id", "left")
