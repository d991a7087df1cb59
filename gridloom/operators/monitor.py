"""Monitoring of forecasts over ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import scans
from gridloom.operators.quantiles import attach
from gridloom.operators.series import CHUNK, chunked, longest, windowed
from gridloom.operators.splits import row_index

WINDOW, NOMINAL, ALERT_BELOW = 168, 0.90, 0.80
LEAST, SIGMAS = 10, 3.0


def _coverage(size: int):
    """Columns of trailing coverage over a window's last ``size`` events."""

    def columns(w) -> dict:
        near = w.rowsBetween(-size + 1, 0)
        hit = ((F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))).cast("double")
        share = F.round(F.avg(hit).over(near), 4)
        return {"coverage": share, "n_window": F.count(hit).over(near), "alert": share < ALERT_BELOW, "coverage_error": share - NOMINAL}

    return columns


def rolling_coverage(df: DataFrame, size: int = WINDOW, keys: list[str] | None = None, ties: tuple = (), chunk: int = CHUNK) -> DataFrame:
    """coverage of the last ``size`` events up to each, n, alert and error, by region or other keys. With none
    (``[]``) all events are one order, of time and then ``ties`` (the region unless given). More than ``chunk``
    events of a key are windowed in chunks."""
    keys = ["region"] if keys is None else keys
    ties = ties or (() if keys else ("region",))
    return windowed(df, _coverage(size), size - 1, keys=tuple(keys), ties=ties, size=chunk)


def coverage_by_epoch(df: DataFrame, size: int = WINDOW, keys: list[str] | None = None, chunk: int = CHUNK, block: int = scans.BLOCK) -> DataFrame:
    """The same, begun anew after every event with ``reload`` set. Epochs are numbered by a scan over blocks,
    and one of any length is windowed in chunks, where a key has more than ``chunk`` events."""
    keys = ["region"] if keys is None else keys
    if longest(df, tuple(keys)) <= chunk:
        w = Window.partitionBy(*keys).orderBy("timestamp")
        return df.withColumn("epoch", F.sum(F.col("reload").cast("int")).over(w)).withColumns(_coverage(size)(Window.partitionBy(*keys, "epoch").orderBy("timestamp")))
    rows = scans.running_sum(row_index(df, "_i", "timestamp", keys), "epoch", F.col("reload").cast("int"), keys, "_i", block)
    return chunked(rows, _coverage(size), size - 1, max(chunk, size), indexed=True, keys=tuple(keys), within=("epoch",)).drop("_i")


def residual_anomalies(df: DataFrame, size: int = WINDOW, least: int = LEAST, sigmas: float = SIGMAS, chunk: int = CHUNK) -> DataFrame:
    """Flag against the deviation of the region's previous residuals, the event's own not among them."""

    def columns(w) -> dict:
        r, before = F.col("actual") - F.col("predicted"), w.rowsBetween(-size, -1)
        return {"residual": r, "window_std": F.stddev_pop(r).over(before), "n_window": F.count(r).over(before)}

    out = windowed(df, columns, size, size=chunk)
    ready = (F.col("n_window") >= least) & (F.col("window_std") > 0)
    z = F.when(ready, F.abs("residual") / F.when(F.col("window_std") > 0, F.col("window_std")))
    return out.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.col("z") > sigmas, F.lit(False)))


def anomaly_summary(flagged: DataFrame, size: int = WINDOW) -> DataFrame:
    """By region: events, anomalies, rate, rows in the window and its deviation after the last event."""
    back = F.row_number().over(Window.partitionBy("region").orderBy(F.col("timestamp").desc()))
    # the filter on the rank is applied where rows lie, so no task sorts a whole region
    recent = flagged.select("region", "timestamp", "residual").withColumn("_r", back).filter(F.col("_r") <= size)
    recent = recent.groupBy("region").agg(F.count("residual").alias("window_fill"), F.stddev_pop("residual").alias("current_std"))
    totals = flagged.groupBy("region").agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("n_anomalies"), F.avg(F.col("is_anomaly").cast("double")).alias("rate"))
    return attach(totals, recent, ["region"])


def recent_anomalies(flagged: DataFrame, n: int = 100, region: str | None = None) -> DataFrame:
    rows = flagged.filter("is_anomaly")
    rows = rows.filter(F.col("region") == region) if region else rows
    return rows.orderBy(F.col("timestamp").desc(), "region").limit(min(n, 1000))


def sustained_alerts(df: DataFrame, hold: str, keys: list[str], condition: str = "condition", ts: str = "timestamp", chunk: int = CHUNK, block: int = scans.BLOCK) -> DataFrame:
    """Runs of samples in which the condition holds without a break for ``hold`` or longer: keys,
    started, ended, fired (start plus hold), n_samples. Where a key has more than ``chunk`` samples, runs are
    found in blocks and put together at the blocks' ends."""
    on = F.coalesce(F.col(condition), F.lit(False))
    if longest(df, tuple(keys)) <= chunk:
        w = Window.partitionBy(*keys).orderBy(ts)
        rows = df.withColumns({"_on": on, "_run": F.sum(F.when(on, 0).otherwise(1)).over(w)})
        found = rows.filter("_on").groupBy(*keys, "_run").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_samples")).drop("_run")
    else:
        found = scans.runs(df, on, keys, ts, block)
    wait = F.expr(f"interval {hold}")
    return found.filter(F.col("ended") - wait >= F.col("started")).withColumn("fired", F.col("started") + wait)


#: Upper bounds of latency buckets, in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
#: Size of a latency sketch. At 400 a quantile's rank is off by less than 1 % of the requests, with 99 % confidence.
SKETCH = 400


def serving_sketches(df: DataFrame, window: str = "5 minutes") -> DataFrame:
    """window_start, endpoint, n, n_5xx, latency_le (cumulative buckets) and a mergeable sketch of latencies; on
    batches and on streams with a watermark."""
    le = [F.count_if(F.col("duration") <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    out = df.groupBy(F.window("timestamp", window).alias("_w"), "endpoint").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("n_5xx"), F.kll_sketch_agg_double(F.col("duration").cast("double"), F.lit(SKETCH)).alias("sketch"), *le
    )
    return out.select(F.col("_w.start").alias("window_start"), "endpoint", "n", "n_5xx", F.array(*[f"le_{i}" for i in range(len(le))]).alias("latency_le"), "sketch")


def from_sketches(sketches: DataFrame, by: list[str], span: str | None = None) -> DataFrame:
    """Rates, p95, p99 and alerts by the columns ``by``, and by windows of ``span`` if given, from the parts' sketches."""
    if span:
        sketches = sketches.withColumn("window_start", F.window("window_start", span)["start"])
        by = ["window_start", *by]
    le = F.array(*[F.sum(F.col("latency_le")[i]) for i in range(len(LATENCY_BUCKETS))])
    out = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_5xx").alias("n_5xx"), F.kll_merge_agg_double("sketch").alias("_s"), le.alias("latency_le"))
    rate = F.col("n_5xx") / F.col("n")
    some = F.kll_sketch_get_n_double("_s") > 0
    at = lambda p: F.when(some, F.kll_sketch_get_quantile_double("_s", F.lit(p)))
    out = out.withColumns({"error_rate": rate, "error_alert": rate > 0.05, "p95": at(0.95), "p99": at(0.99)})
    return out.withColumn("latency_alert", (F.col("p95") > 0.5) | (F.col("p99") > 2.0)).drop("_s")


def serving_rollup(df: DataFrame, window: str = "5 minutes") -> DataFrame:
    """By window and endpoint: requests, server errors, rate, p95, p99, alerts and cumulative latency
    buckets, of batches. Streams, and spans put together later, take ``serving_sketches``."""
    buckets = LATENCY_BUCKETS
    span = F.window("timestamp", window)
    out = df.groupBy(span.alias("_w"), "endpoint").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("n_5xx"),
        F.percentile_approx("duration", F.lit(0.95), F.lit(100_000)).alias("p95"), F.percentile_approx("duration", F.lit(0.99), F.lit(100_000)).alias("p99"),
        *[F.count_if(F.col("duration") <= b).alias(f"le_{i}") for i, b in enumerate(buckets)],
    )
    rate = F.col("n_5xx") / F.col("n")
    return out.select(
        F.col("_w.start").alias("window_start"), "endpoint", "n", "n_5xx", rate.alias("error_rate"), (rate > 0.05).alias("error_alert"), "p95", "p99",
        ((F.col("p95") > 0.5) | (F.col("p99") > 2.0)).alias("latency_alert"), F.array(*[f"le_{i}" for i in range(len(buckets))]).alias("latency_le"),
    )


def prediction_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("region", "model_name").agg(F.count("*").alias("n"))


def error_counts(df: DataFrame) -> DataFrame:
    return df.filter("error_type IS NOT NULL").groupBy("endpoint", "error_type").agg(F.count("*").alias("n"))


def attach_actuals(predictions: DataFrame, actuals: DataFrame, first: str = "1 hour", last: str = "24 hours") -> DataFrame:
    """Predictions with the actual of their hour, if it came from ``first`` to ``last`` after it.

    On streams both sides need watermarks on ``timestamp`` and ``arrived``; on batches it is the same join.
    """
    a = actuals.select(F.col("region").alias("_r"), F.col("timestamp").alias("_t"), "arrived", "actual")
    p = predictions
    when = (F.col("arrived") >= p["timestamp"] + F.expr(f"interval {first}")) & (F.col("arrived") <= p["timestamp"] + F.expr(f"interval {last}"))
    return p.join(a, (p["region"] == F.col("_r")) & (p["timestamp"] == F.col("_t")) & when).drop("_r", "_t")
