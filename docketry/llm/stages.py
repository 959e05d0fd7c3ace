"""Stages of the corpus pipeline: (spark, docs, sf_dir) to DataFrame, built on the operators."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm import near_copies, op2_language, op6_pii, op10_mixing
from docketry.llm.common import keep, noting, release, small_batches, table
from docketry.llm.op7_packing import packed_digest

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEFT: list[str] = []  # what the stage before wrote on its way


def stage(function):
    """A stage's result is written before the next one begins, so the folders it wrote on
    its way are released then, except those that the next one's ``docs`` reads."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        read = {os.path.basename(os.path.dirname(f)) for f in docs.inputFiles()} if LEFT else ()
        release(spark, [path for path in LEFT if os.path.basename(path) not in read])
        LEFT.clear()
        with noting() as made:
            result = function(spark, docs, sf_dir)
        LEFT.extend(made)
        return result

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a unique ``row``: a table's rows are known by file and place, so
    that texts need no other copy; rows of any other origin are written with numbers."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        place = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))])
        return docs.select(*COLUMNS, F.unhex(place).alias("row"))
    return keep(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go; a missing label gets the prediction."""
    judged = op2_language.identify(docs).where(F.col("lang_pred") != op2_language.UNKNOWN)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or
    more) one row stays: the one with the smallest doc_id (none comes last), and of rows
    that share it the one with the smallest hash. Rows of one doc_id in different
    components are different texts and all stay."""
    docs = numbered(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS[1:]).alias("tie"), "row").alias("place")
    found = near_copies.near_copies(docs).join(docs.select("row", order), "row")
    stay = keep(found.groupBy("root").agg(F.min("place").alias("first")).select("first.row"), "stay")
    return docs.join(stay, "row", "left_semi").select(*COLUMNS)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks; n_chars follows the text. Null texts stay null,
    repeated rows stay repeated, no rows give none."""
    found = op6_pii.find(docs, op6_pii.train(docs))
    cleaned = F.when(F.size("entities") > 0, op6_pii.redact(F.col("text"), F.col("entities"))).otherwise(F.col("text"))
    return (found.withColumn("_clean", cleaned)
            .withColumn("n_chars", F.when(F.size("entities") > 0, F.length("_clean").cast("long")).otherwise(F.col("n_chars")))
            .withColumn("text", F.col("_clean")).select(*COLUMNS))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: null and empty texts (size 0) once,
    repeated rows each for themselves, no rows give none."""
    docs = numbered(docs)
    mixed = op10_mixing.mix(docs, row_col="row").where("copies > 0").select("row", "copies")
    return docs.join(mixed, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1,024 tokens; null texts are empty, repeated
    rows are packed each, no rows give none."""
    return packed_digest(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("personal_data", personal_data), ("source_mixing", mixing), ("best_fit_packing", packing)]


def run_stages(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in stages:
        docs = keep(step(spark, docs, sf_dir), name)
    return docs
