"""Queries of drift, monitoring and streams. Streams run over files of the given tables and are held
against the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import drift, monitor
from gridloom.queries import base
from gridloom.queries.base import query
from gridloom.streaming import streams

ROWS_PER_FILE = 100_000
COLS = ["temperature", "humidity", "wind_speed", "pressure"]


def _old_new(spark, d):
    w = base.weather(spark, d)
    cut = F.col("timestamp") < F.lit("1997-01-01").cast("timestamp_ntz")
    return w.filter(cut), w.filter(~cut).withColumn("temperature", F.col("temperature") + 8)


_NEW = "(SELECT * REPLACE (temperature + 8 AS temperature) FROM weather WHERE timestamp >= TIMESTAMP '1997-01-01')"
_OLD = "(SELECT * FROM weather WHERE timestamp < TIMESTAMP '1997-01-01')"
_ST = {"mean": "avg({0})", "std": "stddev_pop({0})", "min": "min({0})", "max": "max({0})", "q25": "quantile_cont({0}, 0.25)", "q50": "quantile_cont({0}, 0.5)", "q75": "quantile_cont({0}, 0.75)"}
_STATS = " UNION ALL ".join(f"SELECT '{c}' AS feature, " + ", ".join(f"{e.format(c)} AS {n}" for n, e in _ST.items()) + f" FROM {_OLD}" for c in COLS)


@query("a27_feature_stats", "weather", _STATS, " ".join(_ST))
def a27(spark, d):
    return drift.feature_stats(_old_new(spark, d)[0], COLS)


def _psi_sql(c: str) -> str:
    q = f"(SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS all_q, min({c}) AS lo, max({c}) AS hi FROM {_OLD})"
    count = lambda src: f"SELECT len(list_filter(e, lambda x: v >= x)) AS b, count(*) AS n FROM (SELECT {c} AS v FROM {src}), e GROUP BY 1"
    return (
        f"SELECT '{c}' AS feature, sum((cp - rp) * ln(cp / rp)) AS psi FROM (WITH e AS (SELECT list_sort(list_filter(all_q, lambda x: x > lo AND x < hi)) AS e FROM {q}),"
        f" bins AS (SELECT unnest(range(0, len(e) + 1)) AS b FROM e), r AS ({count(_OLD)}), n AS ({count(_NEW)})"
        " SELECT (coalesce(r.n, 0) + 1e-6) / sum(coalesce(r.n, 0) + 1e-6) OVER () AS rp, (coalesce(n.n, 0) + 1e-6) / sum(coalesce(n.n, 0) + 1e-6) OVER () AS cp FROM bins LEFT JOIN r USING (b) LEFT JOIN n USING (b))"
    )


@query("d1_psi", "weather", " UNION ALL ".join(_psi_sql(c) for c in COLS), "psi", "", 5)
def d1(spark, d):
    old, new = _old_new(spark, d)
    return drift.psi_report(new, COLS, reference=old).select("feature", "psi")


@query("d1_psi_from_stats")
def d1s(spark, d):
    old, new = _old_new(spark, d)
    return drift.psi_report(new.drop("pressure"), COLS, stats=drift.feature_stats(old, COLS))


_Z = f"SELECT s.feature, l.m AS live_mean, s.mean AS training_mean, s.std AS training_std, round((l.m - s.mean) / s.std, 3) AS z_score, CASE WHEN abs((l.m - s.mean) / s.std) < 2 THEN 'normal' WHEN abs((l.m - s.mean) / s.std) < 3 THEN 'elevated' ELSE 'alert' END AS drift_level FROM ({_STATS}) s JOIN (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS m FROM {_NEW}" for c in COLS) + ") l USING (feature)"


@query("d2_zscore", "weather", _Z, "live_mean training_mean training_std z_score")
def d2(spark, d):
    old, new = _old_new(spark, d)
    return drift.zscore_drift(new, COLS, drift.feature_stats(old, COLS)).drop("note")


@query("d3_any_drift", "weather", "SELECT max(psi) >= 0.2 AS drift FROM (" + " UNION ALL ".join(_psi_sql(c) for c in COLS) + ")")
def d3(spark, d):
    old, new = _old_new(spark, d)
    return drift.any_drift(drift.psi_report(new, COLS, reference=old))


def _cov_sql(part: str, extra: str = "", src: str = "judged") -> str:
    return (
        f"SELECT timestamp, region, {extra}round(avg((actual BETWEEN lower AND upper)::INT) OVER f, 4) AS coverage, count(*) OVER f AS n_window, round(avg((actual BETWEEN lower AND upper)::INT) OVER f, 4) < 0.8 AS alert FROM {src}"
        f" WINDOW f AS (PARTITION BY {part} ORDER BY timestamp ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"
    )


@query("w10_rolling_coverage", "judged", _cov_sql("region"), "coverage", "n_window", 4)
def w10(spark, d):
    return monitor.rolling_coverage(base.judged(spark, d)).select("timestamp", "region", "coverage", "n_window", "alert")


@query(
    "w10_global_coverage", "judged",
    "SELECT timestamp, region, round(avg((actual BETWEEN lower AND upper)::INT) OVER f, 4) AS coverage, count(*) OVER f AS n_window, round(avg((actual BETWEEN lower AND upper)::INT) OVER f, 4) < 0.8 AS alert FROM judged"
    " WINDOW f AS (ORDER BY timestamp, region ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)", "coverage", "n_window", 4,
)
def w10g(spark, d):
    return monitor.rolling_coverage(base.judged(spark, d), keys=[], chunk=1_000).select("timestamp", "region", "coverage", "n_window", "alert")


_ANOM = (
    "SELECT timestamp, region, actual - predicted AS residual, CASE WHEN n >= 10 AND s > 0 THEN abs(actual - predicted) / s END AS z, coalesce(n >= 10 AND s > 0 AND abs(actual - predicted) / s > 3, false) AS is_anomaly FROM"
    " (SELECT *, stddev_pop(actual - predicted) OVER f AS s, count(*) OVER f AS n FROM judged WINDOW f AS (PARTITION BY region ORDER BY timestamp ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))"
)


@query("w11_anomalies", "judged", _ANOM, "residual z", "", 5)
def w11(spark, d):
    return monitor.residual_anomalies(base.judged(spark, d)).select("timestamp", "region", "residual", "z", "is_anomaly")


@query(
    "w12_anomaly_summary", "judged",
    f"SELECT region, count(*) AS n, count(*) FILTER (is_anomaly) AS n_anomalies, avg(is_anomaly::INT) AS rate, count(*) FILTER (r <= 168) AS window_fill, stddev_pop(residual) FILTER (r <= 168) AS current_std"
    f" FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY timestamp DESC) AS r FROM ({_ANOM})) GROUP BY 1", "rate current_std", "n n_anomalies window_fill", 5,
)
def w12(spark, d):
    return monitor.anomaly_summary(monitor.residual_anomalies(base.judged(spark, d)))


@query("t1_recent_anomalies", "judged", f"SELECT timestamp, region, residual FROM ({_ANOM}) WHERE is_anomaly ORDER BY timestamp DESC, region LIMIT 20", "residual")
def t1(spark, d):
    return monitor.recent_anomalies(monitor.residual_anomalies(base.judged(spark, d)), 20).select("timestamp", "region", "residual")


@query(
    "j8_attach_actuals", "predicted",
    "SELECT timestamp, region, y_pred, consumption_mw AS actual FROM predicted WHERE hour(timestamp) % 12 <> 0", "y_pred actual",
)
def j8(spark, d):
    p = base.predicted(spark, d)
    late = F.expr("make_dt_interval(0, cast((hour(timestamp) % 12) * 2 AS int))")
    actual = p.select("region", "timestamp", (F.col("timestamp") + late).cast("timestamp_ntz").alias("arrived"), F.col("consumption_mw").alias("actual"))
    return monitor.attach_actuals(p.select("timestamp", "region", "y_pred"), actual).select("timestamp", "region", "y_pred", "actual")


_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


@query(
    "st6_serving_rollup", "serving",
    "SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, endpoint, count(*) AS n, count(*) FILTER (status >= 500) AS n_5xx, count(*) FILTER (status >= 500) / count(*) AS error_rate,"
    " count(*) FILTER (status >= 500) / count(*) > 0.05 AS error_alert, quantile_disc(duration, 0.95) AS p95, quantile_disc(duration, 0.99) AS p99,"
    " quantile_disc(duration, 0.95) > 0.5 OR quantile_disc(duration, 0.99) > 2 AS latency_alert, " + ", ".join(f"count(*) FILTER (duration <= {b}) AS le_{i}" for i, b in enumerate(_BOUNDS))
    + " FROM serving GROUP BY 1, 2", "error_rate p95 p99", "n n_5xx",
)
def st6(spark, d):
    r = monitor.serving_rollup(base.serving(spark, d))
    return r.select("*", *[F.get("latency_le", F.lit(i)).alias(f"le_{i}") for i in range(len(_BOUNDS))]).drop("latency_le")


@query("st6_prediction_counts", "judged", "SELECT region, 'lag_1' AS model_name, count(*) AS n FROM judged GROUP BY 1", "", "n")
def st6p(spark, d):
    return monitor.prediction_counts(base.judged(spark, d).withColumn("model_name", F.lit("lag_1")))


@query("st6_error_counts", "serving", "SELECT endpoint, 'http_' || status AS error_type, count(*) AS n FROM serving WHERE status >= 500 GROUP BY 1, 2", "", "n")
def st6e(spark, d):
    rows = base.serving(spark, d).withColumn("error_type", F.when(F.col("status") >= 500, F.concat(F.lit("http_"), "status")))
    return monitor.error_counts(rows)


_HOLD = (
    "SELECT region, min(timestamp) AS started, max(timestamp) AS ended, count(*) AS n_samples, min(timestamp) + INTERVAL 2 HOUR AS fired FROM"
    " (SELECT *, sum(CASE WHEN actual > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY region ORDER BY timestamp) AS r FROM judged) WHERE actual > 40 GROUP BY region, r HAVING max(timestamp) - INTERVAL 2 HOUR >= min(timestamp)"
)


@query("st7_sustained_alerts", "judged", _HOLD, "", "n_samples")
def st7(spark, d):
    return monitor.sustained_alerts(base.judged(spark, d).withColumn("condition", F.col("actual") > 40), "2 hours", ["region"])


@query("st7_sustained_alerts_blocks", "judged", _HOLD, "", "n_samples")
def st7b(spark, d):
    return monitor.sustained_alerts(base.judged(spark, d).withColumn("condition", F.col("actual") > 40), "2 hours", ["region"], chunk=0, block=64)


_EPOCH = "(SELECT *, sum((hour(timestamp) = 0)::INT) OVER (PARTITION BY region ORDER BY timestamp) AS epoch FROM judged)"


@query("st8_coverage_by_epoch", "judged", _cov_sql("region, epoch", "epoch, ", _EPOCH), "coverage", "epoch n_window", 4)
def st8(spark, d):
    rows = base.judged(spark, d).withColumn("reload", F.hour("timestamp") == 0)
    return monitor.coverage_by_epoch(rows).select("timestamp", "region", "epoch", "coverage", "n_window", "alert")


@query("st8_coverage_by_epoch_blocks", "judged", _cov_sql("region, epoch", "epoch, ", _EPOCH), "coverage", "epoch n_window", 4)
def st8b(spark, d):
    rows = base.judged(spark, d).withColumn("reload", F.hour("timestamp") == 0)
    return monitor.coverage_by_epoch(rows, chunk=300, block=64).select("timestamp", "region", "epoch", "coverage", "n_window", "alert")


def _stream(spark, df, order):
    """Rows dealt by time into three parts, which are written one after the other in equally many files, and
    read as a stream of one part at a time, the oldest first."""
    path = base.scratch(spark, "stream")
    at = F.unix_timestamp(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [1 / 3, 2 / 3]).alias("c")).first()["c"] or [0, 0]  # two numbers
    wanted = [at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1]]
    sizes = df.agg(*[F.count_if(w).alias(f"n{i}") for i, w in enumerate(wanted)]).first()
    files = max(1, min(sizes) // ROWS_PER_FILE)  # so many rows for each file that none stays empty
    for i, w in enumerate(wanted):
        df.filter(w).repartition(files).write.parquet(f"{path}/part={i}")
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
    return read.parquet(f"{path}/part=*"), f"{path}-checkpoint"


def _run(sdf, checkpoint, mode="append"):
    """The stream's output as files below the checkpoint."""
    out = f"{checkpoint}-out"
    q = sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(out)


@query("st1_stream_hourly", "hourly", "SELECT * FROM hourly WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)", "consumption_mw")
def st1(spark, d):
    sdf, cp = _stream(spark, base.readings(spark, d), "datahora")
    return _run(streams.stream_regional_hourly(sdf), cp).select("timestamp", "region", "consumption_mw")


def _events(spark, d):
    rows = base.judged(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return rows.withColumn("event_id", F.unix_timestamp("timestamp"))


#: What the watermark has passed when all has been read: the stream's delay is an hour.
_PASSED = "timestamp <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM judged)"


@query("st2_stream_coverage", "judged", f"SELECT * FROM ({_cov_sql('region')}) WHERE {_PASSED}", "coverage", "n_window", 4)
def st2(spark, d):
    sdf, cp = _stream(spark, _events(spark, d), "timestamp")
    return _run(streams.stream_coverage(sdf), cp).select("timestamp", "region", "coverage", "n_window", "alert")


@query("st8_stream_reload", "judged", f"SELECT * FROM ({_cov_sql('region, epoch', 'epoch, ', _EPOCH)}) WHERE {_PASSED}", "coverage", "epoch n_window", 4)
def st8s(spark, d):
    rows = _events(spark, d).withColumn("reload", F.hour("timestamp") == 0)
    sdf, cp = _stream(spark, rows, "timestamp")
    return _run(streams.stream_coverage(sdf), cp).select("timestamp", "region", "epoch", "coverage", "n_window", "alert")


_SERVED = (
    "SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, endpoint, count(*) AS n, count(*) FILTER (status >= 500) AS n_5xx, count(*) FILTER (status >= 500) / count(*) AS error_rate,"
    " count(*) FILTER (status >= 500) / count(*) > 0.05 AS error_alert, " + ", ".join(f"count(*) FILTER (duration <= {b}) AS le_{i}" for i, b in enumerate(_BOUNDS)) + ", true AS near"
    " FROM serving WHERE time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM serving) GROUP BY 1, 2"
)


@query("st6_stream_serving", "serving", _SERVED, "error_rate", "n n_5xx")
def st6s(spark, d):
    rows = base.serving(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    sdf, cp = _stream(spark, rows, "timestamp")
    hours = monitor.from_sketches(_run(streams.stream_serving(sdf), cp), ["endpoint"], "1 hour")
    # held against the ranks of all latencies of the hour's closed windows, which the watermark has passed
    passed = F.lit(rows.agg(F.max("timestamp")).first()[0]) - F.expr("interval 10 minutes")
    own = rows.filter(F.window("timestamp", "5 minutes")["end"] <= passed).select(F.date_trunc("hour", "timestamp").alias("window_start"), "endpoint", F.nullif("duration", F.lit(float("nan"))).alias("duration"))
    ranks = [
        f(F.col("duration"), F.col(p)).alias(f"{n}_{p}") for p in ("p95", "p99") for n, f in (("below", lambda d, v: F.count_if(d < v)), ("upto", lambda d, v: F.count_if(d <= v)))
    ]
    met = hours.join(own, ["window_start", "endpoint"]).groupBy("window_start", "endpoint").agg(*ranks, F.count("*").alias("rows"), F.count("duration").alias("m"))
    off = F.lit(0.01) * F.col("m") + 1  # in ranks; equal latencies share the ranks from below to upto
    near = F.col("rows") == F.col("n")
    for p, q in (("p95", 0.95), ("p99", 0.99)):
        at = F.lit(q) * F.col("m")
        near = near & F.when(F.col("m") == 0, F.col(p).isNull()).otherwise(F.coalesce((F.col(f"below_{p}") - off <= at) & (at <= F.col(f"upto_{p}") + off), F.lit(False)))
    out = hours.join(met, ["window_start", "endpoint"]).withColumn("near", near)
    le = [F.get("latency_le", F.lit(i)).alias(f"le_{i}") for i in range(len(_BOUNDS))]
    return out.select("window_start", "endpoint", "n", "n_5xx", "error_rate", "error_alert", *le, "near")


@query("st3_stream_anomalies", "judged", f"SELECT * FROM ({_ANOM}) WHERE {_PASSED}", "residual z", "", 5)
def st3(spark, d):
    sdf, cp = _stream(spark, _events(spark, d), "timestamp")
    return _run(streams.stream_anomalies(sdf), cp).select("timestamp", "region", "residual", "z", "is_anomaly")


@query("st4_stream_actuals", "predicted", "SELECT timestamp, region, y_pred, consumption_mw AS actual FROM predicted WHERE hour(timestamp) % 12 <> 0", "y_pred actual")
def st4(spark, d):
    p = base.predicted(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    late = F.expr("make_dt_interval(0, cast((hour(timestamp) % 12) * 2 AS int))")
    actual = p.select("region", "timestamp", (F.col("timestamp") + late).alias("arrived"), F.col("consumption_mw").alias("actual"))
    left, cp = _stream(spark, p.select("timestamp", "region", "y_pred"), "timestamp")
    right, _ = _stream(spark, actual, "arrived")
    return _run(streams.stream_attach_actuals(left, right, "30 days"), cp).select("timestamp", "region", "y_pred", "actual")


_DAYS = "SELECT date_trunc('day', timestamp) AS window_start, 'consumption_mw' AS feature, avg(consumption_mw) AS live_mean FROM ehourly GROUP BY 1"
_DR = f"SELECT window_start, feature, live_mean, m AS training_mean, s AS training_std, round((live_mean - m) / s, 3) AS z_score, CASE WHEN abs((live_mean - m) / s) < 2 THEN 'normal' WHEN abs((live_mean - m) / s) < 3 THEN 'elevated' ELSE 'alert' END AS drift_level FROM ({_DAYS}), (SELECT avg(consumption_mw) AS m, stddev_pop(consumption_mw) AS s FROM ehourly) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM ehourly)"


@query("st5_stream_drift", "ehourly", _DR, "live_mean training_mean training_std z_score")
def st5(spark, d):
    rows = base.event_hourly(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    stats = drift.feature_stats(rows, ["consumption_mw"])
    sdf, cp = _stream(spark, rows, "timestamp")
    return _run(streams.stream_drift(sdf, ["consumption_mw"], stats), cp).drop("note")
