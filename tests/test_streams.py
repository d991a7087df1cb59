"""Stateful trackers on mixed, late and silent events; latency sketches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridloom.operators import monitor
from gridloom.streaming import streams

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, timestamp timestamp, region string, actual double, predicted double, lower double, upper double, reload boolean"


def events(n, regions=("a", "b", None)):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        for k, region in enumerate(regions):
            y = rng.gauss(100, 10)
            rows.append((3 * i + k, START + dt.timedelta(minutes=10 * i, seconds=k), region, y if rng.random() > 0.03 else None, 100.0, 88.0, 115.0, rng.random() < 0.02))
    return rows


def streamed(spark, tmp_path, parts, make):
    """Each part of rows is one micro-batch. Gives the output and the rows that Spark dropped as late."""
    path = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path / f"part={i}"))
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "part=*"))
    query = make(sdf).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    state = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    return spark.read.parquet(str(tmp_path / "out")), late, state


def keyed(df, columns):
    return {r["event_id"]: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


def mixed(rows, batches):
    """Batches of rows in time order, each mixed, and rows moved into the next batch by less than the delay."""
    size, rng, out = -(-len(rows) // batches), random.Random(3), []
    for lo in range(0, len(rows), size):
        out.append(rows[lo : lo + size])
    for a, b in zip(out, out[1:]):
        moved = [r for r in a[-9:] if rng.random() < 0.6]
        a[:] = [r for r in a if r not in moved]
        b[:0] = moved
    for part in out:
        rng.shuffle(part)
    return out


def test_coverage_of_mixed_batches(spark, tmp_path):
    rows = events(120)
    got, late, _ = streamed(spark, tmp_path, mixed(list(rows), 4), lambda s: streams.stream_coverage(s, 20, "2 hours"))
    passed = max(r[1] for r in rows) - dt.timedelta(hours=2)
    batch = monitor.coverage_by_epoch(spark.createDataFrame(rows, SCHEMA), 20).filter(F.col("timestamp") <= F.lit(passed))
    columns = ["region", "epoch", "coverage", "n_window", "alert"]
    assert keyed(got, columns) == keyed(batch, columns) and late == 0


def test_anomalies_of_mixed_batches_and_late_rows(spark, tmp_path):
    rows = [(*r[:7], False) for r in events(120)]
    parts = mixed(list(rows), 4)
    parts[3].append((9999, START, "a", 1.0, 1.0, 1.0, 1.0, False))  # long passed by then
    got, late, _ = streamed(spark, tmp_path, parts, lambda s: streams.stream_anomalies(s, 30, 5, 2.0, "2 hours"))
    passed = max(r[1] for r in rows) - dt.timedelta(hours=2)
    batch = monitor.residual_anomalies(spark.createDataFrame(rows, SCHEMA), 30, 5, 2.0).filter(F.col("timestamp") <= F.lit(passed))
    columns = ["region", "residual", "is_anomaly"]
    assert keyed(got, columns) == keyed(batch, columns) and late == 1
    assert 0 < got.filter("is_anomaly").count() < 60


def test_a_silent_region_loses_its_state(spark, tmp_path):
    old = [r for r in events(30, ("gone",))]
    new = [(1000 + i, START + dt.timedelta(days=10, minutes=i), "here", 1.0, 1.0, 0.0, 2.0, False) for i in range(30)]
    back = [(2000, START + dt.timedelta(days=10, minutes=25), "gone", 100.0, 100.0, 88.0, 115.0, False)]
    end = [(3000, START + dt.timedelta(days=11), "here", 1.0, 1.0, 0.0, 2.0, False)]
    got, _, state = streamed(spark, tmp_path, [old, new, back, end], lambda s: streams.stream_coverage(s, 20, "1 hour", "2 days"))
    assert got.filter("event_id = 2000").first()["n_window"] == 1  # begun anew, not the 20 of old
    assert got.filter("region = 'gone'").count() == 31


def test_sketches_merge(spark):
    df = spark.range(40_000).select(
        (F.lit(START).cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 60).cast("int"))).alias("timestamp"), (F.pmod(F.hash("id"), F.lit(10_000)) / 10_000).alias("duration"),
        F.when(F.col("id") % 9 == 0, 500).otherwise(200).alias("status"), F.lit("e").alias("endpoint"),
    )
    parts = monitor.serving_sketches(df)
    one, exact = monitor.from_sketches(parts, ["endpoint"], "1 hour").first(), monitor.serving_rollup(df, "1 hour").first()
    assert [one[c] for c in ("n", "n_5xx", "error_rate", "latency_le", "error_alert", "latency_alert")] == [exact[c] for c in ("n", "n_5xx", "error_rate", "latency_le", "error_alert", "latency_alert")]
    assert abs(one["p95"] - exact["p95"]) < 0.01 and abs(one["p99"] - exact["p99"]) < 0.01
