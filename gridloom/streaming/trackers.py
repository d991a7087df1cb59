"""Trackers of a region's latest events as stateful processors.

Events wait in the state until the watermark has passed them, and then are followed in order of time and id, so
a stream gives what the batch gives however its rows are mixed within the delay; later ones are dropped and counted
by Spark (``numRowsDroppedByWatermark``). The state of a region is its waiting events, a ring of its last values
and an epoch, which an event with ``reload`` begins. Timers in event time bring back a region whose events wait,
and one that has been silent for ``expire`` loses its state.

State is kept by RocksDB, which these operators set for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.operators.monitor import ALERT_BELOW, LEAST, NOMINAL, SIGMAS, WINDOW

EVENT = ["at", "event_id", "actual", "predicted", "lower", "upper", "reload"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tracker(StatefulProcessor):
    """Holds events until they are due; subclasses say what follows from one."""

    columns: list[str] = []

    def __init__(self, size: int, expire_ms: int):
        self.size, self.expire_ms = size, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, actual double, predicted double, lower double, upper double, reload boolean")
        self.ring = handle.getListState("ring", "value double")
        self.seen = handle.getValueState("seen", "last long, epoch long")

    def follow(self, event: dict, ring: list[float]) -> tuple[tuple, float]:
        """What to report of an event, given the values before it (NaN: unknown), and its own value."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(v) else v for v in r) for pdf in rows for r in pdf[EVENT].itertuples(index=False, name=None)]
        new = [(int(a), int(i), *rest) for a, i, *rest in new]
        yield self._due(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        yield self._due(key, [], now)
        if self.seen.exists() and not self.waiting.exists() and self.seen.get()[0] // 1000 + self.expire_ms <= now:
            self.ring.clear()
            self.seen.clear()

    def _due(self, key: tuple, new: list[tuple], watermark: int) -> pd.DataFrame:
        held = [*(self.waiting.get() if self.waiting.exists() else []), *new]
        held = sorted((tuple(h) for h in held), key=lambda h: h[:2])
        n = sum(h[0] <= watermark * 1000 for h in held)
        out = []
        if n:
            ring = [r[0] for r in self.ring.get()] if self.ring.exists() else []
            last, epoch = self.seen.get() if self.seen.exists() else (held[0][0], 0)
            for h in held[:n]:
                event = dict(zip(EVENT, h, strict=True))
                if event["at"] - last >= self.expire_ms * 1000:  # as if its state had gone, which a waiting event may delay
                    ring, epoch = [], 0
                if event["reload"]:
                    ring, epoch = [], epoch + 1
                row, value = self.follow(event, ring)
                out.append((event["event_id"], key[0], pd.Timestamp(event["at"], unit="us"), epoch, *row))
                ring = [*ring, value][-self.size :]
                last = event["at"]
            self.ring.put([(float(v),) for v in ring])
            self.seen.update((last, epoch))
            self.handle.registerTimer(last // 1000 + self.expire_ms)
        if len(held) > n:
            self.waiting.put(held[n:])
            self.handle.registerTimer(max(held[n][0] // 1000 + 1, watermark + 1))
        else:
            self.waiting.clear()
        return pd.DataFrame(out, columns=["event_id", "region", "timestamp", "epoch", *self.columns])

    def close(self) -> None:
        pass


class Coverage(Tracker):
    columns = ["coverage", "n_window", "alert", "coverage_error"]

    def follow(self, event: dict, ring: list[float]) -> tuple[tuple, float]:
        parts = [event[k] for k in ("lower", "actual", "upper")]
        hit = float("nan") if None in parts else float(parts[0] <= parts[1] <= parts[2])
        known = [h for h in (*ring[-(self.size - 1) :], hit) if h == h] if self.size > 1 else [hit]
        if not known:
            return (None, 0, None, None), hit
        # rounded half up, as SQL does
        share = float((2 * 10_000 * int(sum(known)) + len(known)) // (2 * len(known))) / 10_000
        return (share, len(known), share < ALERT_BELOW, share - NOMINAL), hit


class Anomalies(Tracker):
    columns = ["residual", "z", "is_anomaly"]

    def __init__(self, size: int, expire_ms: int, least: int, sigmas: float):
        super().__init__(size, expire_ms)
        self.least, self.sigmas = least, sigmas

    def follow(self, event: dict, ring: list[float]) -> tuple[tuple, float]:
        known = [v for v in ring if v == v]
        if event["actual"] is None or event["predicted"] is None:
            return (None, None, False), float("nan")
        residual = event["actual"] - event["predicted"]
        std = float(np.std(known)) if known else 0.0
        ready = len(known) >= self.least and std > 0
        z = abs(residual) / std if ready else None
        return (residual, z, bool(ready and z > self.sigmas)), residual


def _tracked(sdf: DataFrame, tracker: Tracker, out: str, delay: str) -> DataFrame:
    sdf.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    have = lambda c, kind: F.col(c).cast(kind) if c in sdf.columns else F.lit(None).cast(kind)
    rows = sdf.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    rows = rows.select(
        "region", "timestamp", F.unix_micros("timestamp").alias("at"), F.col("event_id").cast("long").alias("event_id"),
        *[have(c, "double").alias(c) for c in ("actual", "predicted", "lower", "upper")], F.coalesce(have("reload", "boolean"), F.lit(False)).alias("reload"),
    ).filter("timestamp IS NOT NULL")
    return rows.groupBy("region").transformWithStateInPandas(tracker, out, "Append", "EventTime")


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def stream_coverage(sdf: DataFrame, size: int = WINDOW, delay: str = "1 hour", expire: str = "60 days") -> DataFrame:
    """event_id, region, timestamp, epoch, coverage, n_window, alert, coverage_error of each event (timestamp, event_id,
    region, actual, lower, upper, and ``reload`` if it is there) that the watermark has passed."""
    out = "event_id long, region string, timestamp timestamp, epoch long, coverage double, n_window int, alert boolean, coverage_error double"
    return _tracked(sdf, Coverage(size, _millis(expire)), out, delay)


def stream_anomalies(sdf: DataFrame, size: int = WINDOW, least: int = LEAST, sigmas: float = SIGMAS, delay: str = "1 hour", expire: str = "60 days") -> DataFrame:
    """event_id, region, timestamp, epoch, residual, z, is_anomaly of each event that the watermark has passed, against
    the residuals before it."""
    out = "event_id long, region string, timestamp timestamp, epoch long, residual double, z double, is_anomaly boolean"
    return _tracked(sdf, Anomalies(size, _millis(expire), least, sigmas), out, delay)
