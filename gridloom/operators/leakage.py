"""Whether a model really uses its own region's history: donor swaps of lag features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = "consumption_mw"
#: Fixed names: prefixes of the lag family, and of those that are differences and keep their scale.
LAG_FAMILY = ("_lag_", "_rolling_", "_ewma_", "_diff_", "_range_")
DELTAS = ("_diff_", "_range_")
LEAK_BELOW = 1.5


def lag_columns_of(df: DataFrame, target: str = TARGET) -> list[str]:
    return [c for c in df.columns if any(c.startswith(target + p) for p in LAG_FAMILY)]


def donor_swap(test: DataFrame, train: DataFrame | None, lag_cols: list[str], scale: bool = True, target: str = TARGET, donors: list[str] | None = None) -> DataFrame:
    """Rows of every target region with the lag features of every donor at the same time: the test
    columns, ``region`` of the target, and ``donor``. Rows that lack a lag feature are left out.

    With ``scale`` level features are multiplied by the ratio of the regions' training means (1 where
    the donor's is 0).
    """
    other = test.select(F.col("region").alias("donor"), F.col("timestamp").alias("_t"), *[F.col(c).alias(f"_d_{c}") for c in lag_cols])
    other = other.filter(F.col("donor").isin(donors)) if donors else other
    both = test.drop(*lag_cols).join(other, F.col("timestamp") == F.col("_t"))
    if scale:
        means = train.groupBy("region").agg(*[F.avg(c).alias(f"_m_{c}") for c in lag_cols])  # a row for each region
        own = means.select(F.col("region"), *[F.col(f"_m_{c}").alias(f"_o_{c}") for c in lag_cols])
        both = both.join(own, "region", "left").join(means.withColumnRenamed("region", "donor"), "donor", "left")
    new = {}
    for c in lag_cols:
        v = F.col(f"_d_{c}")
        if scale and not any(c.startswith(target + p) for p in DELTAS):
            ratio = F.when(F.abs(f"_m_{c}") > 1e-9, F.col(f"_o_{c}") / F.when(F.abs(f"_m_{c}") > 1e-9, F.col(f"_m_{c}"))).otherwise(F.lit(1.0))
            v = F.when(F.col("region") == F.col("donor"), v).otherwise(v * ratio)
        new[c] = v
    return both.withColumns(new).drop("_t", *[c for c in both.columns if c.startswith(("_d_", "_m_", "_o_"))]).na.drop(subset=lag_cols)


def leakage_matrix(swapped: DataFrame, predict: Callable[[DataFrame], DataFrame], target: str = TARGET) -> DataFrame:
    """region, donor, mape of predictions (column ``prediction``) from swapped features."""
    scored = predict(swapped).filter(F.col(target) != 0)
    err = F.abs((F.col(target) - F.col("prediction")) / F.col(target))
    return scored.groupBy("region", "donor").agg((F.avg(err) * 100).alias("mape"), F.count("*").alias("n"))


def leakage_verdict(matrix: DataFrame, threshold: float = LEAK_BELOW) -> DataFrame:
    """Mean error with own and with others' history, their difference and ratio, and whether it leaks."""
    own = F.avg(F.when(F.col("region") == F.col("donor"), F.col("mape")))
    others = F.avg(F.when(F.col("region") != F.col("donor"), F.col("mape")))
    one = matrix.agg(own.alias("own"), others.alias("others"))
    ratio = F.try_divide("others", F.when(F.col("own") > 0, F.col("own")))
    return one.select("own", "others", (F.col("others") - F.col("own")).alias("degradation"), ratio.alias("ratio"), F.coalesce(ratio < threshold, F.lit(False)).alias("leak"))
