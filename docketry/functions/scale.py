"""Helpers that keep plans sound when tables or single keys grow."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A lookup side is broadcast only when it is proven to hold at most this many rows.
LOOKUP_ROWS = 100_000
# A key with more rows than this is spread over several reducers.
HOT_KEY_ROWS = 1_000_000


def lookup(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Broadcast ``df`` when a bounded count proves it small; otherwise hand it
    back unhinted, so that Catalyst plans a shuffle join with AQE behind it."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A constant reference table in one partition: one task instead of one per core."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Hash a table over the cores when its files split into fewer pieces than that.

    Large inputs arrive in more splits than there are cores and pass untouched,
    so this costs a shuffle only where the whole table is a few small files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Catalyst inlines a projected expression wherever it is used - into pushed
    filters and into the bodies of lambdas, where it would run per element. A
    one-row generator is not inlined, costs no shuffle and stays in codegen.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str,
                how: str = "left", hot_rows: int = HOT_KEY_ROWS, count_on: DataFrame | None = None) -> DataFrame:
    """Equi-join a possibly skewed ``left`` to a ``right`` with unique keys.

    Keys above ``hot_rows`` get ``ceil(n / hot_rows)`` salts: their left rows are
    spread by a hash of the unique column ``spread_by`` (stable under task
    retries) and only their right rows are replicated. AQE cannot do this here,
    because ``right`` usually ends in an aggregation rather than a plain shuffle.

    The salt table holds at most rows / hot_rows keys - that bound is what makes
    broadcasting it safe. Counting reads the key columns only; ``count_on`` names
    the base table to count when ``left`` is itself derived.
    """
    counted = left if count_on is None else count_on
    salts = F.broadcast(
        counted.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    salted = (
        left.join(salts, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    replicated = (
        right.join(salts, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(replicated, [*keys, "_salt"], how).drop("_salt")


def join_optional(left: DataFrame, right: DataFrame, key: str, spread_by: str, right_key: str | None = None) -> DataFrame:
    """Left join on a reference that many left rows lack.

    Rows without the reference would all meet in one reducer; they are hashed by
    ``spread_by`` instead, under a mark that no right row carries.
    """
    missing = F.col(key).isNull()
    marked = left.withColumn("_none", F.when(missing, F.xxhash64(spread_by)))
    told = right.withColumnRenamed(right_key or key, "_ref").withColumn("_none_ref", F.lit(None).cast("long"))
    joined = marked.join(told, F.col(key).eqNullSafe(F.col("_ref")) & F.col("_none").eqNullSafe(F.col("_none_ref")), "left")
    return joined.drop("_none", "_none_ref", "_ref")


def ordered_stream(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of one key together in one partition and in order, ready to be folded.

    Hashing a digest column keeps the exchange in the plan. Repartitioning by
    the key itself was dropped above a union whose inputs were already hashed by
    that key, and rows of one key then turned up in different partitions.
    """
    return df.withColumn("_slot", F.xxhash64(key)).repartition("_slot").sortWithinPartitions(key, *order).drop("_slot")


def packed_rows(df: DataFrame, order: list[str], limit: int) -> list[Column]:
    """A small reference table as constant array columns for row expressions.

    The table is measured first. Up to ``limit`` rows become one constant array
    (a JSON literal Catalyst folds once); a larger table is cut into slices of
    bounded size, each fetched on its own, so no single constant grows past it.
    """
    entry = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])

    def constant(part: DataFrame) -> Column | None:
        frame = part.limit(limit + 1).agg(F.array_sort(F.collect_list(entry)).alias("p"))
        found = frame.select(F.size("p").alias("n"), F.to_json("p", {"ignoreNullFields": "false"}).alias("text")).first()
        return None if found.n > limit else F.from_json(F.lit(found.text), frame.schema["p"].dataType.json())

    whole = constant(df)
    if whole is not None:
        return [whole]
    slices = -(-df.count() // limit) * 2
    spread = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    parts = [constant(spread.where(F.col("_slice") == i).drop("_slice")) for i in range(slices)]
    if any(p is None for p in parts):
        raise ValueError("a slice of the reference table exceeds its bound")
    return parts


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a small, expensive intermediate result so that later questions
    about it do not scan its inputs again, and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def written(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; gives the path too.

    The shuffle files of the run are deleted when it ends, not when the driver
    happens to collect its garbage.
    """
    spark, cleaning = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_dir(spark, purpose), spark.conf.get(cleaning, None)
    spark.conf.set(cleaning, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(cleaning) if before is None else spark.conf.set(cleaning, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` gave and that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") if spark.sparkContext.master.startswith("local[") else None
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
