"""Prediction intervals from conformal or normal half-widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Uncertainty scale of each region.
REGION_SCALES = {"Alentejo": 0.90, "Algarve": 0.85, "Centro": 1.00, "Lisboa": 1.10, "Norte": 1.15}
Z90 = 1.645


def hour_scale(hour: Column) -> Column:
    return F.when(hour.between(8, 19), 1.15).when(hour.isin(6, 7, 20, 21), 1.0).otherwise(0.85)


def region_scale(region: Column, scales: dict[str, float] = REGION_SCALES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in sorted(scales.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, region), F.lit(1.0))


def half_width(q90: Column, rmse: Column, region: Column, hour: Column, scales: dict[str, float] = REGION_SCALES) -> Column:
    """Conformal quantile where there is one, else the normal one; by region and hour."""
    return F.coalesce(q90, rmse * Z90) * region_scale(region, scales) * hour_scale(hour)


def prediction_intervals(df: DataFrame, pred: str = "y_pred", q90: str = "q90", rmse: str = "rmse", ts: str = "timestamp") -> DataFrame:
    """ci_lower (not below 0), ci_upper, ci_lower_clipped, ci_method."""
    w = half_width(F.col(q90), F.col(rmse), F.col("region"), F.hour(ts))
    p = F.col(pred)
    return df.withColumns({
        "ci_lower": F.greatest(F.lit(0.0), p - w), "ci_upper": p + w, "ci_lower_clipped": p - w < 0,
        "ci_method": F.when(F.col(q90).isNotNull(), "conformal").otherwise("gaussian_z_rmse"),
    })
