"""Queries over experiment runs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_runs(runs: DataFrame, name: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first."""
    out = runs.filter(F.col("name") == name) if name else runs
    out = out.filter(F.col("status") == status) if status else out
    return out.orderBy(F.col("started_at").desc(), "run_id")


def best_run(runs: DataFrame, metric: str, lower: bool = True) -> DataFrame:
    """The finished run with the best value of a metric."""
    value = F.try_element_at("metrics", F.lit(metric))
    have = runs.filter(F.col("status") == "completed").withColumn("value", value).filter("value IS NOT NULL")
    return have.orderBy(F.col("value").asc() if lower else F.col("value").desc(), "run_id").limit(1)


def select_best(scores: DataFrame, key: str = "model", value: str = "rmse") -> DataFrame:
    """The key with the least mean over folds: one row."""
    per = scores.groupBy(key).agg(F.avg(value).alias("mean"))
    return per.agg(F.min_by(key, F.struct("mean", key)).alias(key), F.min("mean").alias("mean"))


def compare_variants(metrics: DataFrame, baseline_rmse: float) -> DataFrame:
    """Variants by error with their gain over a baseline in per cent."""
    gain = F.try_divide((F.lit(baseline_rmse) - F.col("rmse")) * 100, F.lit(baseline_rmse))
    return metrics.withColumn("improvement_pct", gain).orderBy("rmse", "variant")
