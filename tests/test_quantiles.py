"""Rank selection against ``percentile``."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import drift, quality
from gridloom.operators import quantiles as exact

PS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def rows(spark, n):
    h = F.hash("id")
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 0, h / 1000.0).alias("spread"), F.pmod(h, F.lit(7)).cast("double").alias("ties"),
        F.when(F.col("id") == 4, 1.5).alias("one"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") % 100 == 1, float("nan")).otherwise(F.col("id") % 9).alias("odd"),
        F.lit("x").alias("n"), F.lit(1).alias("before"),
    )


def same(got, df, columns, by):
    for r in got:
        group = df
        for b in by:
            group = group.filter(F.col(b).eqNullSafe(F.lit(r[b])))
        want = group.agg(F.percentile(r["feature"], F.lit(PS))).first()[0]
        assert str(r["q"]) == str(want) or r["q"] == pytest.approx(want, rel=1e-12), r


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("most, accuracy", [(10**9, 5000), (2000, 5000), (50, 40)])
def test_equals_percentile(spark, by, most, accuracy):
    columns = ["spread", "ties", "one", "none", "odd"]
    df = rows(spark, 40_000)
    got = exact.quantiles(df, {c: F.col(c) for c in columns}, PS, by, most, accuracy).collect()
    assert {r["feature"] for r in got} == {"spread", "ties", "one", "odd"} and len(got) == (10 if by else 4)
    same(got, df, columns, by)


def test_one_group_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.xxhash64("id").cast("double").alias("v"), F.lit("all").alias("g"))
    got = exact.quantiles(df, {"v": F.col("v")}, [0.5, 0.9], ["g"]).first()
    want = df.agg(F.percentile("v", F.lit([0.5, 0.9]))).first()[0]
    assert got["q"] == want and got["n"] == 1_000_000


def test_no_rows(spark):
    df = rows(spark, 100).filter("false")
    assert exact.quantiles(df, {"spread": F.col("spread")}, PS).collect() == []
    assert quality.region_stats(df.select(F.lit("r").alias("region"), F.col("spread").alias("consumption_mw"))).collect() == []
    one = drift.feature_stats(df, ["spread"]).first()
    assert one["feature"] == "spread" and one["q50"] is None
    assert quality.outliers(df, "spread").count() == 0


def test_samples_and_outlier_report(spark):
    df = spark.createDataFrame([(float(h), None) for h in [*range(-9, 0), 50, 101, 101]], "humidity double, cloud_cover double")
    got = {r["rule"]: r for r in quality.weather_samples(df).collect()}
    assert got["humidity"]["n_bad"] == 11 and got["humidity"]["samples"] == [-9.0, -8.0, -7.0, -6.0, -5.0]
    assert got["cloud_cover"]["n_bad"] == 0 and got["cloud_cover"]["samples"] == []
    rep = {r["method"]: r for r in quality.outlier_report(df, ["humidity"]).collect()}
    assert rep["iqr"]["n"] == 12 and rep["iqr"]["n_above"] == 3 and rep["z"]["pct"] == 0
