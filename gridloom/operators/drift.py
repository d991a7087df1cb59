"""Feature drift: population stability and mean shift."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.quantiles import attach, quantiles
from gridloom.shared import materialise

BINS = 10
SMOOTH = 1e-6
HIGH, LOW = 0.2, 0.1


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature and value of numeric columns, missing ones left out."""
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*parts))).filter("value IS NOT NULL")


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (population), min, max, q25, q50, q75 in long form, over wide rows."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        parts = {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
        aggs.append(F.struct(F.lit(c).alias("feature"), *[e.alias(k) for k, e in parts.items()]).alias(f"s{i}"))
    one = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))
    q = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    return attach(one, q.select("feature", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]), ["feature"])


def quantile_edges(reference: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """feature, inner edges and mean of the reference. Equal quantiles are one edge; a constant has one bin."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("reference_mean")).alias(f"s{i}") for i, c in enumerate(columns)]
    one = reference.agg(*aggs).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))
    q = quantiles(reference, {c: F.col(c) for c in columns}, [i / bins for i in range(bins + 1)])
    one = attach(one, q.select("feature", "q"), ["feature"])
    edges = F.array_distinct(F.coalesce("q", F.array().cast("array<double>")))
    inner = F.when(F.size(edges) > 2, F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    return one.select("feature", inner.alias("edges"), "reference_mean")


def edges_from_stats(stats: DataFrame, bins: int = BINS, n: int = 10_000, seed: int = 42) -> DataFrame:
    """feature, edges, reference_mean and ref (share of each bin) where only summary statistics are known.

    A normal sample with their mean and deviation, cut to their range, stands for the reference; a
    few numbers for each feature, so it is drawn on the driver.
    """
    rows = []
    for s in stats.collect():
        d = s.asDict()
        mean = d.get("mean") if d.get("mean") is not None else 0.0
        std = d.get("std") or 0.0
        std = std if np.isfinite(std) and std > 0 else max(abs(mean) * 1e-6, 1e-9)
        x = np.random.default_rng(seed).normal(mean, std, n)
        lo, hi = (d.get(a) if d.get(a) is not None else d.get(b) for a, b in (("p1", "min"), ("p99", "max")))
        if lo is not None and hi is not None and hi > lo:
            x = np.clip(x, lo, hi)
        inner = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))[1:-1]
        counts = np.bincount(np.searchsorted(inner, x, side="right"), minlength=len(inner) + 1)
        rows.append((d["feature"], inner.tolist(), d.get("mean"), counts.tolist()))
    return stats.sparkSession.createDataFrame(rows, "feature string, edges array<double>, reference_mean double, counts array<long>")


def _counts(df: DataFrame, columns: list[str], edges: DataFrame) -> DataFrame:
    """feature and the number of values in each bin, as an array with a place for every bin."""
    at = F.size(F.filter("edges", lambda e: F.col("value") >= e))
    binned = melt(df, columns).join(F.broadcast(edges), "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    per = binned.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"), F.sum("s").alias("_s"), F.sum("n").alias("_t"))
    full = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.try_element_at("_n", b), F.lit(0).cast("long")))
    return per.join(F.broadcast(edges), "feature").select("feature", full.alias("counts"), (F.col("_s") / F.col("_t")).alias("mean"))


def _psi(ref: Column, cur: Column) -> Column:
    def share(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x + SMOOTH)
        return F.transform(counts, lambda x: (x + SMOOTH) / total)

    terms = F.zip_with(share(ref), share(cur), lambda r, c: (c - r) * F.ln(c / r))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def psi_report(current: DataFrame, columns: list[str], reference: DataFrame | None = None, stats: DataFrame | None = None, threshold: float = HIGH) -> DataFrame:
    """feature, psi, drift_detected, severity, current_mean, reference_mean, pct_change, missing.

    Edges come from a reference table or, without one, from its statistics. Features that the
    current rows lack, or have no values of, are reported without a psi.
    """
    if reference is not None:
        edges = materialise(quantile_edges(reference, columns), "edges")
        ref = _counts(reference, columns, edges.select("feature", "edges")).select("feature", F.col("counts").alias("_ref"))
        edges = edges.join(ref, "feature", "left")
    else:
        edges = edges_from_stats(stats).withColumnRenamed("counts", "_ref")
    have = [c for c in columns if c in current.columns]
    cur = _counts(current, have, edges.select("feature", "edges")).select("feature", "counts", F.col("mean").alias("current_mean"))
    both = edges.join(cur, "feature", "left")
    psi = F.when(F.col("counts").isNotNull() & F.col("_ref").isNotNull(), _psi(F.col("_ref"), F.col("counts")))
    out = both.select("feature", psi.alias("psi"), "current_mean", "reference_mean")
    c, r = F.col("current_mean"), F.col("reference_mean")
    change = F.when(r == 0, F.when(c == 0, 0.0).when(c.isNotNull(), float("inf"))).otherwise(F.try_divide(c - r, r))
    severity = F.when(F.col("psi") >= threshold, "high").when(F.col("psi") >= LOW, "low").otherwise("none")
    return out.select(
        "feature", "psi", F.coalesce(F.col("psi") >= threshold, F.lit(False)).alias("drift_detected"), severity.alias("severity"),
        "current_mean", "reference_mean", change.alias("pct_change"), (~F.col("feature").isin(have)).alias("missing"),
    )


def any_drift(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("drift"))


def z_columns(live: Column, mean: Column, std: Column) -> dict[str, Column]:
    z = F.try_divide(live - mean, F.when(std != 0, std))
    level = F.when(F.abs(z) < 2, "normal").when(F.abs(z) < 3, "elevated").when(z.isNotNull(), "alert")
    return {"z_score": F.round(z, 3), "drift_level": level, "note": F.when(std == 0, "zero training std")}


def zscore_drift(current: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """feature, live_mean, training mean and std, z_score, drift_level, note."""
    one = current.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)])
    live = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("live_mean")) for i, c in enumerate(columns)])))
    both = live.join(F.broadcast(stats.select("feature", F.col("mean").alias("training_mean"), F.col("std").alias("training_std"))), "feature")
    kept = both.filter("live_mean IS NOT NULL AND training_mean IS NOT NULL AND training_std IS NOT NULL")
    return kept.withColumns(z_columns(F.col("live_mean"), F.col("training_mean"), F.col("training_std")))
