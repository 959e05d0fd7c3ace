"""Streaming queries: tables read as file streams, run over everything available,
and held against the batch SQL of the same question."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.scale import shared_dir
from docketry.functions.text import normalize_text
from docketry.plans import bindings as B
from docketry.plans.registry import SQL, query
from docketry.sources.sinks import read_buckets
from docketry.streaming import jobs as J


def stream(spark, folder, name):
    """The table as a stream of its files: one file of the folder or a folder of parts.

    The pattern names just this path; a stream takes no plain file as its path.
    """
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _arrivals(spark, folder):
    docs = stream(spark, folder, "documents")
    text = normalize_text(F.col("text"))
    early = F.col("source").isin("src0", "src1", "src2", "src3")
    return docs.select(F.col("doc_id").alias("arrival"), F.md5("text").alias("document_id"), F.when(early, "ocr").otherwise("text").alias("source_type"), F.col("lang").alias("source_metadata"), text.alias("normalized_text"))


@query("stream_intake", f"""
WITH {B.SQL_NORMAL}, g AS (SELECT doc_id, lang, source FROM gated), m AS (SELECT g.*, md5(d.text) AS document_id, CASE WHEN g.source IN ('src0','src1','src2','src3') THEN 'ocr' ELSE 'text' END AS st FROM g JOIN documents d USING (doc_id)),
f AS (SELECT *, first_value(st) OVER w AS fs, first_value(lang) OVER w AS fl, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY document_id ORDER BY doc_id))
SELECT doc_id AS arrival, document_id, CASE WHEN n = 1 THEN 'accepted' WHEN fs = st AND fl IS NOT DISTINCT FROM lang THEN 'replay' ELSE 'conflict' END AS outcome FROM f""")
def stream_intake(spark, folder):
    """First record per document wins across the stream."""
    root = shared_dir(spark, "stream-intake")
    outcomes = J.stream_intake(_arrivals(spark, folder), ("source_type", "source_metadata", "normalized_text"))
    J.drain(outcomes, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("document_id string, arrival long, outcome string").parquet(f"{root}/out").select("arrival", "document_id", "outcome")


@query("stream_classification", SQL["keyword_classify"].replace(
    "SELECT doc_id, CASE WHEN s > 0.80", "SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN s > 0.80").replace(
    """  CASE WHEN s > 0 THEN unit_id END AS unit_id, CASE WHEN s > 0 THEN department_id END AS department_id, s AS confidence,
  CASE WHEN s > 0 THEN lang END AS keyword_language,
  CASE WHEN s = 0 THEN 'No taxonomy keyword matched' ELSE 'Best matching taxonomy chain selected from ' || lang || ' keywords' END AS reason""", "  s AS confidence"))
def stream_classification(spark, folder):
    """Arrivals classified and merged into a current table, batch after batch."""
    root = shared_dir(spark, "stream-classification")
    docs = stream(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("arrival"), normalize_text(F.col("text")).alias("normalized_text"))
    docs = J.length_gate(docs)
    running = J.stream_classification(docs, B.sample_taxonomy(spark), f"{root}/current", f"{root}/checkpoint", "keyword-v2")
    running.awaitTermination()
    return read_buckets(spark, f"{root}/current").select("document_id", "status", "request_type_id", "confidence")


_STAGES = {"signup": "extracting", "view": "waiting_for_user", "click": "draft_prepared", "purchase": "completed", "error": "failed"}


@query("stream_case_states", """
WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS fails FROM events)
SELECT user_id AS case_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'extracting' WHEN 'view' THEN 'waiting_for_user' WHEN 'click' THEN 'draft_prepared' WHEN 'purchase' THEN 'completed'
  ELSE CASE WHEN fails < 4 THEN 'ready_for_processing' ELSE 'failed' END END AS state, fails AS attempts FROM e WHERE n = 1""")
def stream_case_states(spark, folder):
    """Events as stage facts of a user's case; the last emitted state per case."""
    root = shared_dir(spark, "stream-case-states")
    states = F.create_map(*[F.lit(v) for pair in _STAGES.items() for v in pair])
    facts = stream(spark, folder, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("stage"),
        F.try_element_at(states, F.col("event_type")).alias("state"))
    J.drain(J.stream_case_states(facts, cooldown_ms=0), f"{root}/out", f"{root}/checkpoint")
    changes = spark.read.schema("case_id long, seq long, state string, attempts int, event string").parquet(f"{root}/out").where("event = 'state'")
    return changes.groupBy("case_id").agg(F.max_by(F.struct("seq", "state", F.col("attempts").cast("bigint").alias("attempts")), "seq").alias("l")).select("case_id", "l.*")
