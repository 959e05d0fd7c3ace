"""Helpers of the training-data operators: shared tables, distributed ranks, components, sorted runs."""

from __future__ import annotations

import contextlib
import os
import pickle
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


OWN: dict[str, str] = {}  # the folder of a session on one machine that names none
NOTED: list[str] | None = None  # the folders written while ``noting``


BATCH_ROWS = 2500


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in Arrow batches. Unless the session asks for fewer,
    a batch has at most ``BATCH_ROWS`` rows, which bounds what a worker holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the place all executors reach.

    Only a single-machine session without that setting gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or OWN.get("root")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = OWN["root"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def keep(df: DataFrame, purpose: str = "kept") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    its rows no longer change, and a lost executor costs only its own tasks."""
    small_batches(df.sparkSession)
    path = shared_folder(df.sparkSession, purpose)
    if NOTED is not None:
        NOTED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def noting():
    """Gives the list of the folders that ``keep`` writes meanwhile."""
    global NOTED
    before, NOTED = NOTED, []
    try:
        yield NOTED
    finally:
        NOTED = before


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``keep`` wrote in this process and that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shipped(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object of this package by value: plain broadcasts name its class, which
    executors without the package cannot load. Tasks read it with ``arrived``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def arrived(shared: Broadcast):
    return pickle.loads(shared.value)


def ranked(df: DataFrame, order: list, rank: str = "rank", weight: str | None = None) -> DataFrame:
    """Number all rows in ``order`` (from 0), or add up ``weight`` before each row.

    Rows are range-sorted, each sorted partition counts for itself, and only the
    partitions' totals (one row each) are added up by the driver. ``weight`` must
    be a long, so that the sums do not depend on where partitions begin. The
    caller hands in a kept table: it is read once for the bounds, once for the sort.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType())])

    def count(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            if weight is None:
                sizes = np.ones(batch.num_rows, dtype=np.int64)
            else:
                sizes = batch.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = run + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(ends - sizes)],
                names=[*batch.schema.names, "_part", "_run"])
            run = int(ends[-1]) if len(ends) else run

    runs = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema), "ranks")
    size = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    totals = runs.groupBy("_part").agg(F.sum(size).cast("long").alias("n")).collect()
    before, rows = 0, []
    for r in sorted(totals, key=lambda r: r["_part"]):
        rows.append((r["_part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long").coalesce(1)  # one row for each partition
    return (runs.join(F.broadcast(offsets), "_part")
            .withColumn(rank, F.col("_run") + F.col("_before")).drop("_part", "_run", "_before"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Alternating large-star and small-star steps. A row (v, p) with p < v says that
    v hangs under p. Both sides of each join are read from written tables, so AQE
    can split a node that holds many rows. Copies of an edge are merged each step.
    """
    spark = edges.sparkSession
    hung = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct(), "edges")
    while True:
        least = keep(hung.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("n")), "least")
        large = keep(
            hung.join(least.select(F.col("v").alias("p"), "m"), "p", "left")
            .select("v", F.coalesce("m", "p").alias("p"), F.col("m").isNotNull().alias("moved")), "large")
        state = least.agg(F.max("n").alias("n")).first()
        if (state.n or 0) <= 1 and not large.where("moved").limit(1).count():
            return least.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                least.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
        large = large.select("v", "p").distinct()
        least = keep(large.groupBy("v").agg(F.min("p").alias("m")), "least")
        small = large.join(least, "v").select(F.col("p").alias("v"), F.col("m").alias("p")).where("v <> p")
        hung = keep(small.unionByName(least.select("v", F.col("m").alias("p"))).distinct(), "edges")


def by_bytes(batches, column: str, most: int = 8 << 20):
    """Arrow batches cut so that ``column`` holds about ``most`` bytes in each, one
    row at least. This bounds what Python holds at once however long the texts are."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # the worker process lives on in later stages
