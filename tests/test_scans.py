"""Scans over blocks and chunked windows against windows over whole series."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import metrics, monitor, scans, series
from gridloom.operators.splits import row_index


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for region, n in (("a", 500), ("b", 23), (None, 15), ("c", 1)):
        on = True
        for i in range(n):
            on = on if rng.random() < 0.9 else not on
            y = rng.gauss(50, 10)
            rows.append((start + dt.timedelta(hours=i), region, y, y + rng.gauss(0, 5), y - 6, y + 6, on if rng.random() < 0.95 else None, rng.random() < 0.03, rng.random() * 20 - 4, "x"))
    schema = "timestamp timestamp_ntz, region string, predicted double, actual double, lower double, upper double, condition boolean, reload boolean, temperature double, _part string"
    df = spark.createDataFrame(rows, schema).withColumn("consumption_mw", F.col("actual"))
    return df.repartition(5).cache()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in [tuple(str(x) if not isinstance(x, float) else x for x in r) for r in df.select(columns).collect()])
    assert rows(a) == rows(b)


def test_running_sum(events):
    rows = row_index(events, "_i")
    got = scans.running_sum(rows, "epoch", F.col("reload").cast("int"), ["region"], "_i", 7)
    want = rows.withColumn("epoch", F.sum(F.col("reload").cast("long")).over(Window.partitionBy("region").orderBy("timestamp")))
    same(got, want)


@pytest.mark.parametrize("block", [1, 7, 100])
def test_runs_in_blocks(events, block):
    for hold in ("0 hours", "3 hours"):
        same(monitor.sustained_alerts(events, hold, ["region"], chunk=0, block=block), monitor.sustained_alerts(events, hold, ["region"]))


def test_coverage_in_chunks(events):
    same(monitor.coverage_by_epoch(events, 20, chunk=30, block=7), monitor.coverage_by_epoch(events, 20))
    same(monitor.rolling_coverage(events, 20, chunk=21), monitor.rolling_coverage(events, 20))
    same(monitor.rolling_coverage(events, 20, [], chunk=40), monitor.rolling_coverage(events, 20, []))
    same(monitor.residual_anomalies(events, 20, chunk=25), monitor.residual_anomalies(events, 20))


def test_series_in_chunks(events, monkeypatch):
    df = events.select("timestamp", "region", "consumption_mw", "temperature", "_part")
    makers = [series.lag_features, series.rolling_features, series.diff_features, series.baseline_forecasts, series.horizon_targets]
    whole = [f(df) for f in makers] + [series.trend_features(df), series.seasonal_decompose(df), metrics.mase(events, events, "actual", "predicted")]
    monkeypatch.setattr(series.windowed, "__defaults__", (*series.windowed.__defaults__[:-1], 60))
    parts = [f(df) for f in makers] + [series.trend_features(df, 60), series.seasonal_decompose(df, size=60), metrics.mase(events, events, "actual", "predicted")]
    for a, b in zip(parts, whole, strict=True):
        same(a, b)


def test_one_region_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp"), F.lit("a").alias("region"), F.lit(True).alias("condition"), (F.col("id") * 1.0).alias("consumption_mw"))
    out = series.chunked(df, lambda w: series.lag_columns(w=w), 48, 500)
    per_task = out.select("consumption_mw").mapInPandas(lambda it: (p.iloc[:1].assign(consumption_mw=len(p)) for p in it), "consumption_mw double").collect()
    assert sum(r["consumption_mw"] for r in per_task) == 20_000 and max(r["consumption_mw"] for r in per_task) <= 10_000
    assert monitor.sustained_alerts(df, "1 hour", ["region"], chunk=0, block=500).select("n_samples").collect()[0][0] == 20_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
