"""Streaming intake, classification and case projection.

The batch operators are reused unchanged; only what needs memory across
micro-batches (first record per document, latest facts per case, retry timers)
lives in ``transformWithState`` processors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.operators.classify import classify
from docketry.operators.intake import INTAKE_FACTS, intake_fingerprint, length_gate
from docketry.sources import fixed
from docketry.sources.sinks import merge_buckets

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstRecord(StatefulProcessor):
    """Remembers the digest of a document's first record and judges later ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "print string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One trigger may hand the rows of a key over in several frames: order them all first.
        batch = pd.concat([b[["document_id", "arrival", "print"]] for b in rows]).sort_values("arrival", kind="stable")
        first = self.first.get()  # a call to the state store costs more than a row: ask once
        known = first[0] if first else None
        outcomes = []
        for digest in batch["print"]:
            if known is None:
                known = digest
                self.first.update((known,))
                outcomes.append("accepted")
            else:
                outcomes.append("replay" if digest == known else "conflict")
        yield pd.DataFrame({"document_id": batch["document_id"].to_numpy(), "arrival": batch["arrival"].to_numpy(), "outcome": outcomes})

    def close(self) -> None:
        pass


def stream_intake(documents: DataFrame, facts: tuple[str, ...] = INTAKE_FACTS, text: str = "normalized_text") -> DataFrame:
    """Gated records -> (document_id, arrival, outcome), exactly as batch ``ingest``.

    Only digests enter the state, one short string per document.
    """
    _use_rocksdb(documents.sparkSession)
    marked = length_gate(documents, text).select("document_id", F.col("arrival").cast("long").alias("arrival"), intake_fingerprint(facts).alias("print"))
    return marked.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=FirstRecord(), outputStructType=f"document_id {marked.schema['document_id'].dataType.simpleString()}, arrival long, outcome string", outputMode="Append", timeMode="None")


def stream_classification(documents: DataFrame, tax: dict[str, DataFrame], root: str, checkpoint: str, model: str = "semantic-v3",
                          text: str = "normalized_text", version: str = "arrival"):
    """Classify arrivals and merge them into the current table under ``root`` (``sinks.read_buckets``)."""
    decided = classify(documents, tax, model, text).select("document_id", version, "status", "request_type_id", "confidence")
    merge = lambda batch, batch_id: merge_buckets(batch.sparkSession, root, batch, ["document_id"], version, batch_id)
    return decided.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CaseProjector(StatefulProcessor):
    """Keeps the latest facts of one case and emits its state when it changes.

    A failed draft is retried: each failure arms a cooldown timer, and when the
    timer fires a ``retry`` row asks for the next attempt until the attempts are
    used up, after which the case is ``failed`` for good. Counted failures stay in
    the state, so one that is delivered again, in whatever trigger, changes nothing.
    ``remember_ms`` lets the state of a case that long without facts expire.
    """

    def __init__(self, cooldown_ms: int = fixed.RETRY_COOLDOWN_SECONDS * 1000, remember_ms: int | None = None):
        self.cooldown_ms = cooldown_ms
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "seq long, stage string, state string, attempts int", self.remember_ms)
        # One small entry per failure: a repeated case never rewrites a growing value.
        self.failures = handle.getMapState("failures", "seq long", "counted boolean", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A call to the state store costs more than a row: each failure is asked for once, and only of a case that has any.
        facts = self.facts.get()
        seq, stage, state, attempts = facts or (-1, None, None, 0)
        before, known = state, (seq, attempts)
        asked, counted = set(), attempts > 0
        # Every failure counts, also one that arrives late; the latest fact decides the state.
        for batch in rows:
            for fact in batch[["seq", "stage", "state"]].itertuples(index=False):
                if fact.stage == "failed" and int(fact.seq) not in asked:
                    asked.add(int(fact.seq))
                    if not (counted and self.failures.containsKey((int(fact.seq),))):
                        self.failures.updateValue((int(fact.seq),), (True,))
                        attempts += 1
                if fact.seq > seq:
                    seq, stage, state = int(fact.seq), str(fact.stage), str(fact.state)
        if stage == "failed":
            if attempts < fixed.MAX_START_ATTEMPTS:
                state = "ready_for_processing"
                if self.cooldown_ms and (seq, attempts) != known:  # a repeated failure does not postpone the retry
                    for armed in list(self.handle.listTimers()):
                        self.handle.deleteTimer(armed)
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.cooldown_ms)
            else:
                state = "failed"
        self.facts.update((seq, stage, state, attempts))
        if state != before:
            yield pd.DataFrame({"case_id": [key[0]], "seq": [seq], "state": [state], "attempts": [attempts], "event": ["state"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.facts.exists():
            seq, stage, state, attempts = self.facts.get()
            if stage == "failed" and attempts < fixed.MAX_START_ATTEMPTS:
                yield pd.DataFrame({"case_id": [key[0]], "seq": [seq], "state": [state], "attempts": [attempts], "event": ["retry"]})

    def close(self) -> None:
        pass


def stream_case_states(facts: DataFrame, cooldown_ms: int = fixed.RETRY_COOLDOWN_SECONDS * 1000, remember_ms: int | None = None) -> DataFrame:
    """facts(case_id, seq, stage, state) -> changed states and retry requests.

    ``remember_ms`` bounds the state: a case without facts for that long is forgotten, and
    its failures count anew if they are delivered after that.

    With a cooldown or an expiry the query needs a processing-time trigger: either keeps
    an ``availableNow`` run from ending. Without both no timers are armed.
    """
    _use_rocksdb(facts.sparkSession)
    kind = facts.schema["case_id"].dataType.simpleString()
    return facts.groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=CaseProjector(cooldown_ms, remember_ms), outputStructType=f"case_id {kind}, seq long, state string, attempts int, event string",
        outputMode="Append", timeMode="ProcessingTime" if cooldown_ms or remember_ms else "None")


def drain(result: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a stream over everything available now into a Parquet folder."""
    query = result.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
