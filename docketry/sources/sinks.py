"""Snapshot and log sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the current-state table at ``path``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to an immutable log; existing rows are never touched."""
    df.write.mode("append").parquet(path)


def merge_latest(current: DataFrame | None, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keyed latest-wins merge as one map-side-combined aggregation."""
    rows = changes if current is None else current.unionByName(changes)
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"))
    return latest.select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def merge_batch_into(spark: SparkSession, root: str, changes: DataFrame, keys: list[str], version: str, batch_id: int) -> str:
    """Micro-batch merge into generation ``batch_id`` of a snapshot folder.

    Each batch writes its own generation, so a batch replayed after a failure
    rewrites the same folder and the result stays exactly-once.
    """
    previous = None
    if batch_id > 0:
        previous = spark.read.parquet(f"{root}/generation={batch_id - 1}")
    target = f"{root}/generation={batch_id}"
    write_snapshot(merge_latest(previous, changes, keys, version), target)
    return target


# --- current tables in hash buckets ------------------------------------------

BUCKETS = 64
_BUCKET, _SLOT = "snapshot_bucket", "snapshot_slot"
_HEADS = "batch long, bucket int, slot int, row_schema string, turn int"


def _replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _heads(spark: SparkSession, root: str, batch_id: int | None) -> tuple[dict[int, int], str | None]:
    """Slot of each bucket after a batch (None: the last one) and the schema of the rows; at most two lists of heads."""
    found = spark.read.schema(_HEADS).parquet(f"{root}/heads").collect()
    last = max((h.batch for h in found), default=None) if batch_id is None else batch_id
    listed = [h for h in found if h.batch == last]
    if not listed:
        raise ValueError(f"no heads of batch {last} under {root}")
    return {h.bucket: h.slot for h in listed if h.bucket >= 0}, listed[0].row_schema


def _rows_of(spark: SparkSession, root: str, slots: dict[int, int], schema: StructType) -> DataFrame:
    """Rows of the named buckets; only their folders are listed as partitions to read."""
    stored = StructType([*schema.fields, StructField(_BUCKET, IntegerType()), StructField(_SLOT, IntegerType())])
    if not slots:
        return spark.createDataFrame([], schema)
    place = F.col(_BUCKET) * 2 + F.col(_SLOT)
    return spark.read.schema(stored).parquet(f"{root}/rows").where(place.isin([b * 2 + s for b, s in slots.items()])).drop(_BUCKET, _SLOT)


def merge_buckets(spark: SparkSession, root: str, changes: DataFrame, keys: list[str], version: str, batch_id: int, buckets: int = BUCKETS) -> int:
    """Merge a micro-batch into the current table under ``root``; the latest version of a key stays.

    Rows live in hash buckets of their keys and only buckets with changed keys are read and
    written, so the work follows the batch and not the table; returns how many were written. A bucket has two slots: a batch
    writes the one that is not current, by dynamic partition overwrite, and then the list of
    current slots (at most one row per bucket; even and odd batches take turns). A batch that is
    replayed after a failure starts from the list of the batch before it and writes the same
    slots again, so the result is exactly-once. Batches are numbered from 0 without gaps, ``buckets``
    never changes for a table, and equal versions of a key keep either row. A reader must finish before
    the second batch after it writes.
    """
    if {_BUCKET, _SLOT} & set(changes.columns):
        raise ValueError(f"{_BUCKET} and {_SLOT} are reserved")
    slots = _heads(spark, root, batch_id - 1)[0] if batch_id > 0 else {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    latest = merge_latest(None, changes, keys, version).persist()
    try:
        touched = sorted(r[0] for r in latest.select(bucket).distinct().collect())
        moved = {b: 1 - slots.get(b, 1) for b in touched}
        if touched:
            before = _rows_of(spark, root, {b: slots[b] for b in touched if b in slots}, latest.schema)
            # Rows of a bucket meet in one task, which merges them and writes one file.
            met = before.unionByName(latest).withColumn(_BUCKET, bucket).repartition(_BUCKET)
            merged = merge_latest(None, met, [_BUCKET, *keys], version)
            second = F.col(_BUCKET).isin([b for b, slot in moved.items() if slot == 1])
            _replace_partitions(merged.withColumn(_SLOT, second.cast("int")), f"{root}/rows", _BUCKET, _SLOT)
        shape = latest.schema.json()
        heads = [(batch_id, b, slot, shape, batch_id % 2) for b, slot in [(-1, 0), *{**slots, **moved}.items()]]
        _replace_partitions(spark.createDataFrame(heads, _HEADS).coalesce(1), f"{root}/heads", "turn")
    finally:
        latest.unpersist()
    return len(touched)


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    """The current table that ``merge_buckets`` keeps under ``root``."""
    slots, shape = _heads(spark, root, None)
    return _rows_of(spark, root, slots, StructType.fromJson(json.loads(shape)))
