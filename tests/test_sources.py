import json

import pytest
from pyspark.sql import functions as F

from docketry.functions.scale import shared_dir
from docketry.operators import cases as C, drafts as D
from docketry.sources import loaders, seeds, sinks
from docketry.streaming import jobs as J


def test_read_documents(spark, tmp_path):
    record = {"schemaVersion": "2.0", "requestId": "r", "documentId": "d", "sourceType": "text", "text": "x", "sourceMetadata": {"title": "t"}}
    (tmp_path / "a.json").write_text(json.dumps(record))
    row = loaders.read_documents(spark, str(tmp_path)).first()
    assert (row.documentId, row.sourceMetadata, row.correlationId) == ("d", {"title": "t"}, None)
    assert loaders.read_documents(spark, str(tmp_path), stream=True).isStreaming


def test_registry_corpus_policy_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"schemaVersion":"v","schemas":{"a":[{"id":"x","label":"X","kind":"date","required":true},{"id":"y","label":"Y","kind":"free-text","required":false}]}}')
    got = loaders.load_registry(spark, str(tmp_path / "r.json")).orderBy("ord").collect()
    assert [(r.request_type_id, r.field_id, r.kind, r.required) for r in got] == [("a", "x", "date", True), ("a", "y", "free-text", False)]
    broken = {r.rule for r in loaders.registry_violations(loaders.load_registry(spark, str(tmp_path / "r.json"))).collect()}
    assert broken == {"registry_version", "request_type_count"}
    (tmp_path / "c.json").write_text('{"corpus_version":"v2","sources":[{"source_id":"S","title":"T","source_type":"law","chunks":[{"chunk_id":"S-1","locator":"L","excerpt":"e","content":"c"}]}]}')
    row = loaders.load_corpus(spark, str(tmp_path / "c.json")).first()
    assert (row.source_id, row.chunk_id, row.corpus_version, row.official_source_url) == ("S", "S-1", "v2", None)
    (tmp_path / "p.json").write_text('{"version":"v","fieldHandling":{"tckn":"redact","n":"exclude"}}')
    assert {(r.field_id, r.handling) for r in loaders.load_policy(spark, str(tmp_path / "p.json")).collect()} == {("tckn", "redact"), ("n", "exclude")}
    assert loaders.load_policy(spark).where("handling = 'exclude'").count() == 4


def test_snapshots_and_logs(spark, frame, tmp_path):
    rows = frame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, version int")
    latest = sinks.merge_latest(frame([(1, "z", 0), (3, "y", 9)], "k int, v string, version int"), rows, ["k"], "version")
    assert {(r.k, r.v) for r in latest.collect()} == {(1, "b"), (2, "c"), (3, "y")}
    for _ in range(2):
        sinks.write_snapshot(rows, str(tmp_path / "snap"))
        sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 3 and spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_replayed_batch_is_exactly_once(spark, frame, tmp_path):
    root = str(tmp_path / "state")
    sinks.merge_batch_into(spark, root, frame([(1, "a", 1)], "k int, v string, version int"), ["k"], "version", 0)
    for _ in range(2):  # the second run repeats a batch whose commit was lost
        target = sinks.merge_batch_into(spark, root, frame([(1, "b", 2), (2, "c", 1)], "k int, v string, version int"), ["k"], "version", 1)
    assert {(r.k, r.v) for r in spark.read.parquet(target).collect()} == {(1, "b"), (2, "c")}


def test_batches_write_only_the_buckets_of_their_keys(spark, frame, tmp_path):
    root, kind = str(tmp_path / "current"), "k int, v string, version int"
    files = lambda: {str(f) for f in (tmp_path / "current" / "rows").rglob("*.parquet")}
    want = {}

    def merge(rows, batch):
        for k, v, version in rows:
            if k not in want or want[k][1] <= version:
                want[k] = (v, version)
        return sinks.merge_buckets(spark, root, frame(rows, kind), ["k"], "version", batch, buckets=8)

    merge([(k, "a", 1) for k in range(40)] + [(None, "n", 1)], 0)
    first = files()
    assert merge([(3, "b", 2), (3, "late", 0), (99, "c", 1)], 1) <= 2
    assert first <= files() and len(files()) <= len(first) + 2  # nothing of batch 0 was written again
    current = lambda: {r.k: (r.v, r.version) for r in sinks.read_buckets(spark, root).collect()}
    assert current() == want
    merge([(3, "b", 2), (3, "late", 0), (99, "c", 1)], 1)  # the commit of batch 1 was lost
    assert current() == want
    assert merge([], 2) == 0 and current() == want
    merge([(3, "d", 3), (5, "older", 0)], 3)
    merge([(3, "e", 4)], 4)
    assert current() == want and want[3] == ("e", 4) and want[5] == ("a", 1)
    assert len(files()) <= 16  # two slots for each bucket


def test_empty_current_table(spark, frame, tmp_path):
    root = str(tmp_path / "current")
    sinks.merge_buckets(spark, root, frame([], "k int, v string, version int"), ["k"], "version", 0)
    empty = sinks.read_buckets(spark, root)
    assert empty.columns == ["k", "v", "version"] and empty.count() == 0
    with pytest.raises(ValueError):
        sinks.merge_buckets(spark, root, frame([(1, 1, 1)], "k int, snapshot_slot int, version int"), ["k"], "version", 1)


def test_staff_and_seed_tables(spark, frame):
    staff = loaders.default_staff(spark)
    assert staff.count() == 12 and staff.where("role = 'moderator'").count() == 6
    fixture = frame([("s1", "N", "gurultu-sikayeti", "L", "zabita", "Z", "denetim", "D", "T", "completed", "high", 3, "elevated", 1), ("s2", "N", "manual", "L", None, None, None, None, "T", "needs_review", "normal", 1, "normal", 1)],
                    "slug string, name string, type string, label string, department string, department_label string, unit string, unit_label string, text string, state string, priority string, age int, aggression string, repeat int")
    t = seeds.seed_cases(fixture, F.lit("2026-08-20").cast("timestamp_ntz"))
    assert t["assignment"].first().policy == "topic_resolution_rate" and t["assignment"].first().display_name == "Denetim Operatörü 1"
    assert {r.status for r in t["classification"].collect()} == {"classified", "needs_review"}
    assert t["notification"].count() == 2 and t["validation"].count() == 1
    assert t["ticket"].first().ticket_reference[:3] == "CA-"


def test_role_and_languages(frame):
    with pytest.raises(ValueError):
        C.project_for_role(frame([(1,)], "case_id int"), "GUEST")
    rows = frame([("applicant", "en", "en", "en"), ("applicant", "unknown", "tr", "tr"), ("target_unit", "en", "tr", "en"), ("applicant", None, "tr", "tr")], "a string, l string, want string, draft string")
    got = rows.select("want", "draft", D.output_language(F.col("a"), F.col("l")).alias("o"), D.draft_language(F.col("l")).alias("d")).collect()
    assert all(r.want == r.o and r.draft == r.d for r in got)


def test_stream_keeps_state_across_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), shared_dir(spark, "test-stream")
    schema = "arrival long, document_id string, source_type string, normalized_text string"
    text = "x" * 40
    outcomes = lambda: {r.arrival: r.outcome for r in spark.read.parquet(f"{root}/out").collect()}
    for rows in ([(1, "a", "text", text), (2, "a", "text", text)], [(3, "a", "ocr", text), (4, "b", "text", text), (5, "b", "text", "short")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.drain(J.stream_intake(stream, ("source_type", "normalized_text")), f"{root}/out", f"{root}/checkpoint")
    assert outcomes() == {1: "accepted", 2: "replay", 3: "conflict", 4: "accepted"}


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_a_file_and_a_folder_of_parts(spark, tmp_path, parts):
    """A table may be one file or a folder of part files; its neighbours stay out either way."""
    from docketry.plans.stream_queries import stream
    from docketry.streaming.jobs import drain

    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    for name in ("documents", "documents.parquet2", "pages"):
        target = tmp_path / "in" / (name if "." in name else f"{name}.parquet")
        if parts:
            rows.repartition(parts).write.parquet(str(target))
        else:
            target.parent.mkdir(exist_ok=True)
            rows.toPandas().to_parquet(target)
    drain(stream(spark, str(tmp_path / "in"), "documents"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(50))


def test_registry_rules_share_their_reads(spark, frame):
    """Every rule at its count, null ids too; eight rules read the registry three times."""
    rows = [("a", n, "same", "L", "free-text", True, "x") for n in range(10)] + [("b", 0, None, "", "colour", None, None), ("b", 1, None, "L", "free-text", True, "x"), (None, 0, "Bad", "L", "free-text", True, "x")]
    registry = frame(rows, "request_type_id string, ord int, field_id string, label string, kind string, required boolean, schema_version string")
    registry = registry.withColumn("schema_version", F.when(F.col("schema_version") == "x", loaders.fixed.FIELD_SCHEMA_VERSION))
    out = loaders.registry_violations(registry, expected_types=9)
    assert sorted((r.rule, r.id) for r in out.collect()) == sorted([
        ("too_many_fields", "a"), ("field_id_unique", "a/same"), ("field_id_unique", "b"), ("field_id_format", "b"), ("field_id_format", "b"), ("field_id_format", "Bad"),
        ("field_label_required", "b"), ("field_kind_known", "b"), ("field_required_flag", "b"), ("registry_version", "b"), ("request_type_count", "2")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3
