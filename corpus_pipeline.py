"""Corpus pipeline: language ID, SimHash near-dedup, PII, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.stages import STAGES, run_stages

ORACLE_SQL = None  # language profiles, tokenizer ids and mixing rates are not expressible in SQL; tests hold each stage to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to the documents, each written to the shared folder and read again."""
    return run_stages(spark, sf_dir, STAGES)
