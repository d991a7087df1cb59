"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.regions import map_region
from gridloom.operators.drift import z_columns
from gridloom.operators.ingest import clean_readings, kwh_to_mw
from gridloom.operators.monitor import attach_actuals, serving_sketches
from gridloom.streaming.trackers import stream_anomalies, stream_coverage

__all__ = ["event_time", "run_available", "stream_anomalies", "stream_attach_actuals", "stream_coverage", "stream_drift", "stream_regional_hourly", "stream_serving"]


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """A timestamp that watermarks accept."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_regional_hourly(sdf: DataFrame, delay: str = "2 hours") -> DataFrame:
    """timestamp, region, consumption_mw of every closed hour; readings later than ``delay`` are dropped."""
    kept = clean_readings(map_region(event_time(sdf, "datahora").withWatermark("datahora", delay)))
    sums = kept.groupBy(F.window("datahora", "1 hour").alias("_w"), "region").agg(kwh_to_mw(F.sum("consumo")).alias("consumption_mw"))
    return sums.select(F.col("_w.start").alias("timestamp"), "region", "consumption_mw")


def stream_attach_actuals(predictions: DataFrame, actuals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Predictions met by actuals that arrive from 1 to 24 hours later."""
    p = event_time(predictions, "timestamp").withWatermark("timestamp", delay)
    a = event_time(event_time(actuals, "timestamp"), "arrived").withWatermark("arrived", delay)
    return attach_actuals(p, a)


def stream_drift(sdf: DataFrame, columns: list[str], stats: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Mean of each feature by window against its training statistics."""
    timed = event_time(sdf, "timestamp").withWatermark("timestamp", delay)
    means = timed.groupBy(F.window("timestamp", window).alias("_w")).agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("live_mean")) for i, c in enumerate(columns)])
    long = means.select(F.col("_w.start").alias("window_start"), F.inline(rows))
    s = stats.select("feature", F.col("mean").alias("training_mean"), F.col("std").alias("training_std"))
    return long.join(F.broadcast(s), "feature").withColumns(z_columns(F.col("live_mean"), F.col("training_mean"), F.col("training_std")))


def stream_serving(sdf: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts and a latency sketch of every closed window and endpoint (``monitor.serving_sketches``); read and merged
    by ``monitor.from_sketches``."""
    return serving_sketches(event_time(sdf, "timestamp").withWatermark("timestamp", delay), window)


def run_available(sdf: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and give its output as a table in memory (for reports and tests)."""
    writer = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    query = writer.start()
    query.awaitTermination()
    return sdf.sparkSession.table(name)
