"""Descriptive statistics of series and features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendars import season
from gridloom.operators.gram import correlation_matrix, gram
from gridloom.operators.quantiles import with_quantiles
from gridloom.operators.splits import row_index

TARGET = "consumption_mw"


def corrected_skew(col: str) -> Column:
    """Sample skewness with the usual small-sample correction."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def corrected_kurtosis(col: str) -> Column:
    """Excess kurtosis with the usual small-sample correction."""
    n = F.count(col).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(col) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)))


def describe_target(df: DataFrame, col: str = TARGET, by: list[str] | None = None) -> DataFrame:
    stats = df.groupBy(*(by or [])).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"),
        corrected_skew(col).alias("skew"), corrected_kurtosis(col).alias("kurtosis"),
    )
    return with_quantiles(stats, df, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)


def profile(df: DataFrame, by: list[str], col: str = TARGET, ts: str = "timestamp") -> DataFrame:
    """Mean, deviation and rows by any of hour, day_of_week, month, season and columns."""
    parts = {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts), "season": season(F.col(ts))}
    keys = [parts[b].alias(b) if b in parts and b not in df.columns else F.col(b) for b in by]
    return df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n"))


def peak_trough(profiled: DataFrame, by: str = "hour") -> DataFrame:
    return profiled.agg(F.max_by(by, "mean").alias("peak"), F.min_by(by, "mean").alias("trough"))


def heatmap(df: DataFrame, col: str = TARGET, ts: str = "timestamp") -> DataFrame:
    """day_of_week by hour (columns h0 to h23)."""
    keyed = df.select(F.weekday(ts).alias("day_of_week"), F.concat(F.lit("h"), F.hour(ts)).alias("_h"), col)
    return keyed.groupBy("day_of_week").pivot("_h", [f"h{h}" for h in range(24)]).agg(F.avg(col))


def target_correlation(df: DataFrame, columns: list[str], target: str = TARGET) -> DataFrame:
    """feature, r, ranked by absolute value; all in one pass."""
    one = df.agg(*[F.corr(c, target).alias(f"c{i}") for i, c in enumerate(columns)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("r")) for i, c in enumerate(columns)])))
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("r").desc_nulls_last(), "feature")))  # a row for each feature


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair of columns, a before b in the list, over rows where all are present and finite.

    One matrix of sums of products comes to the driver, columns squared numbers."""
    found = gram(df, columns).first()
    r = correlation_matrix(np.array(found["m"])) if found and found["n"] else np.full((len(columns),) * 2, np.nan)
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    return correlations(df, columns).filter(F.abs("r") > threshold)


def mutual_information(df: DataFrame, columns: list[str], target: str = TARGET, bins: int = 10) -> DataFrame:
    """feature and mutual information in nats between quantile bins of it and of the target."""
    ps = [i / bins for i in range(1, bins)]
    cols = [*columns, target]
    cuts = df.agg(*[F.percentile_approx(c, ps, 10_000).alias(f"c{i}") for i, c in enumerate(cols)]).first()  # bins numbers a column
    at = lambda c, edges: F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: F.col(c) >= e))
    rows = df.select(*[F.when(F.col(c).isNotNull(), at(c, cuts[f"c{i}"] or [])).alias(f"b{i}") for i, c in enumerate(cols)])
    y = f"b{len(columns)}"
    long = rows.select(F.col(y).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b{i}").alias("x")) for i, c in enumerate(columns)])))
    joint = long.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("feature", "x", "y").agg(F.count("*").alias("n"))  # bins squared a feature
    of = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    p = joint.withColumns({"_t": of(), "_x": of("x"), "_y": of("y")})
    term = F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))
    return p.groupBy("feature").agg(F.sum(term).alias("mi"))


def acf(df: DataFrame, lags: int = 72, col: str = TARGET, key: str = "region", ts: str = "timestamp") -> DataFrame:
    """key, lag, r for lags from 0. A row meets its ``lags`` successors by row index, so a long series
    spreads over as many tasks as it has index blocks."""
    block = max(4096, lags)
    mean = df.groupBy(F.col(key).alias("_of")).agg(F.avg(col).alias("_m"))
    rows = row_index(df.select(key, ts, col), "_i", ts, key).join(mean, F.col(key).eqNullSafe(F.col("_of"))).drop("_of")
    rows = rows.withColumns({"_d": F.col(col) - F.col("_m"), "_b": F.floor(F.col("_i") / block).cast("long")})
    home = F.array(F.struct(F.col("_b").alias("c"), F.lit(True).alias("own")))
    near = F.col("_i") % block >= block - lags
    halo = F.array(F.struct((F.col("_b") + 1).alias("c"), F.lit(False).alias("own")))
    placed = rows.select(key, "_i", "_d", F.inline(F.concat(home, F.when(near, halo).otherwise(F.array().cast("array<struct<c:bigint,own:boolean>>")))))
    w = Window.partitionBy(key, "c").orderBy("_i")
    wide = placed.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}).filter("own")
    sums = wide.groupBy(key).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s0"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    r = [F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(f"_s{k}", F.lit(0.0)), F.col("_s0")).alias("r")) for k in range(lags + 1)]
    return sums.select(key, F.inline(F.array(*r)))


def pacf(acfs: DataFrame, key: str = "region") -> DataFrame:
    """key, lag, r: partial autocorrelations from an ACF table by the Levinson-Durbin recursion."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        rho = pdf["r"].to_numpy(float)
        out, phi, err = [1.0], np.zeros(0), 1.0
        for k in range(1, len(rho)):
            last = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / err if k > 1 else rho[1]
            phi = np.append(phi - last * phi[::-1], last)
            err *= 1 - last * last
            out.append(last)
        return pd.DataFrame({key: pdf[key], "lag": pdf["lag"], "r": out})

    kind = acfs.schema[key].dataType.simpleString()
    return acfs.groupBy(key).applyInPandas(run, f"{key} {kind}, lag int, r double")  # a row for each lag


def top_features(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    return scores.orderBy(F.abs(by).desc_nulls_last(), "feature").limit(k)
