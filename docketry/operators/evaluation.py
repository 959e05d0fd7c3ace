"""Scenario comparison and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def compare_expected(actual: DataFrame, golden: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per scenario row: which expected columns the actual row misses."""
    condition = [F.col(f"a.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    has_actual, has_golden = F.coalesce("a._here", F.lit(False)), F.coalesce("g._here", F.lit(False))
    joined = actual.withColumn("_here", F.lit(True)).alias("a").join(golden.withColumn("_here", F.lit(True)).alias("g"), condition, "full_outer")
    failed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")), c) for c in columns]))
    verdict = F.when(~has_actual, "missing").when(~has_golden, "unexpected").when(F.size(failed) == 0, "pass").otherwise("fail")
    return joined.select(*[F.coalesce(f"a.{k}", f"g.{k}").alias(k) for k in keys], verdict.alias("verdict"),
                         F.when(has_actual & has_golden, failed).otherwise(F.array().cast("array<string>")).alias("failed_columns"))


def classification_metrics(predicted: DataFrame, gold: DataFrame, key: str = "document_id") -> DataFrame:
    """Accuracy per level, exact chain match and abstain rate over all gold rows."""
    levels = ("department_id", "unit_id", "request_type_id")
    p = predicted.select(key, "status", *[F.col(l).alias(f"p_{l}") for l in levels])
    joined = gold.select(key, *levels).join(p, key, "left")
    right = {l: F.coalesce(F.col(f"p_{l}") == F.col(l), F.lit(False)) for l in levels}
    # A right name under a wrong parent does not count.
    unit = right["department_id"] & right["unit_id"]
    chain = unit & right["request_type_id"]
    rate = lambda cond, name: F.avg(cond.cast("double")).alias(name)
    return joined.agg(
        F.count("*").alias("documents"), rate(right["department_id"], "department_accuracy"), rate(unit, "unit_accuracy"),
        rate(right["request_type_id"], "request_type_accuracy"), rate(chain, "exact_chain"),
        rate(F.coalesce(F.col("status") != "classified", F.lit(True)), "abstain_rate"))


def extraction_metrics(predicted: DataFrame, gold: DataFrame, key: str = "document_id") -> DataFrame:
    """Precision and recall of field values and of missing-field detection.

    predicted(key, field_id, value, is_missing), gold likewise; value equality
    decides a hit, ``is_missing`` marks fields reported absent.
    """
    p = predicted.select(key, "field_id", F.col("value").alias("pv"), F.col("is_missing").alias("pm"))
    g = gold.select(key, "field_id", F.col("value").alias("gv"), F.col("is_missing").alias("gm"))
    joined = p.join(g, [key, "field_id"], "full_outer")
    found, expected = F.col("pv").isNotNull(), F.col("gv").isNotNull()
    hit = F.count_if(F.col("pv") == F.col("gv"))
    gap_hit = F.count_if(F.coalesce("pm", F.lit(False)) & F.coalesce("gm", F.lit(False)))
    ratio = lambda n, d: n / F.nullif(d, F.lit(0))
    return joined.agg(
        hit.alias("field_hits"), ratio(hit, F.count_if(found)).alias("field_precision"), ratio(hit, F.count_if(expected)).alias("field_recall"),
        ratio(gap_hit, F.count_if(F.coalesce("pm", F.lit(False)))).alias("missing_precision"),
        ratio(gap_hit, F.count_if(F.coalesce("gm", F.lit(False)))).alias("missing_recall"))
