"""Windows over regional series: lags, rolling and exponential statistics, baselines, decomposition.

All are ordered by timestamp within a region. With few regions and long histories a window by region
alone is a handful of huge tasks; ``chunked`` splits series by row index into chunks that carry the
rows around them, so that frames of bounded length run in as many tasks as there are chunks. Every operator here
does so for series of more than ``CHUNK`` rows (``windowed``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.splits import row_index
from gridloom.shared import fresh

LAGS = [1, 2, 3, 6, 12, 24, 48]
WINDOWS = [3, 6, 12, 24, 48]
SPANS = [6, 12, 24, 48]
HORIZONS = [1, 6, 12, 24]
TARGET, KEY, TS = "consumption_mw", "region", "timestamp"
#: Rows of a series that one task windows; longer series run in chunks of so many.
CHUNK = 100_000


def over(key: str = KEY, ts: str = TS):
    return Window.partitionBy(key).orderBy(ts)


def lag_columns(lags: list[int] = LAGS, target: str = TARGET, w=None) -> dict[str, Column]:
    w = w if w is not None else over()
    return {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}


def lag_features(df: DataFrame, lags: list[int] = LAGS, target: str = TARGET) -> DataFrame:
    return windowed(df, lambda w: lag_columns(lags, target, w), max(lags))


def rolling_columns(windows: list[int] = WINDOWS, target: str = TARGET, w=None) -> dict[str, Column]:
    """Over the k rows before the current one."""
    w = w if w is not None else over()
    out = {}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{target}_rolling_{name}_{k}"] = f(target).over(frame)
    return out


def rolling_features(df: DataFrame, windows: list[int] = WINDOWS, target: str = TARGET) -> DataFrame:
    return windowed(df, lambda w: rolling_columns(windows, target, w), max(windows))


def diff_columns(target: str = TARGET, w=None) -> dict[str, Column]:
    w = w if w is not None else over()
    day = w.rowsBetween(-24, -1)
    before = F.lag(target, 1).over(w)
    return {
        f"{target}_diff_1": before - F.lag(target, 2).over(w), f"{target}_diff_24": before - F.lag(target, 25).over(w),
        f"{target}_range_24": F.max(target).over(day) - F.min(target).over(day),
    }


def diff_features(df: DataFrame, target: str = TARGET) -> DataFrame:
    return windowed(df, lambda w: diff_columns(target, w), 25)


def filled_forward(col: str, k: int, w, filled: dict[str, str] | None = None) -> Column:
    """The last value at or before the row k rows back; from a lag where ``filled`` names a column that
    ``fill_forward`` has made, so that no frame is unbounded."""
    if filled:
        return F.lag(filled[col], k).over(w) if k else F.col(filled[col])
    return F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -k))


def pct_change(col: str, k: int, w, filled: dict[str, str] | None = None) -> tuple[Column, Column]:
    """Change over k rows in per cent, gaps filled forward, and whether it is 0/0. A change from 0 is
    null here (infinite in theory), so callers that must tell the two apart use the second column."""
    now, old = filled_forward(col, 0, w, filled), filled_forward(col, k, w, filled)
    return (F.try_divide(now, old) - 1) * 100, (old == 0) & (now == 0)


def fill_forward(df: DataFrame, columns: dict[str, str], block: int = 4_096, indexed: bool = False) -> DataFrame:
    """The last value so far of each column, under the given names, over gaps of any length: within blocks
    of rows, and for blocks that start with a gap from the last values of the blocks before.

    ``indexed`` rows have their position ``_i`` already and keep it.
    """
    rows = df if indexed else row_index(df, "_i")
    rows = rows.withColumn("_fb", F.floor(F.col("_i") / block).cast("long"))
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("_i", F.col(c).alias("v"))))["v"].alias(f"_e_{c}") for c in columns]
    ends = rows.groupBy(F.col(KEY).alias("_of"), F.col("_fb").alias("_at")).agg(*last)  # a row for each block
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_of", "_at", *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_e_{c}") for c in columns])
    both = rows.join(carried, F.col(KEY).eqNullSafe(F.col("_of")) & (F.col("_fb") == F.col("_at")))
    so_far = Window.partitionBy(KEY, "_fb").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    new = {name: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_e_{c}")) for c, name in columns.items()}
    return both.withColumns(new).select(*(rows if indexed else df).drop("_fb").columns, *columns.values())


def trend_columns(columns: list[str], w=None, filled: dict[str, str] | None = None) -> dict[str, Column]:
    """Differences, momentum, deviation and volatility of weather, the current row included."""
    w = w if w is not None else over()
    diff = lambda c, k=1: F.col(c) - F.lag(c, k).over(w)
    out: dict[str, Column] = {}
    for c, short in (("temperature", "temp"), ("wind_speed", "wind"), ("humidity", "humidity"), ("pressure", "pressure")):
        if c not in columns:
            continue
        out[f"{short}_diff_1h"] = diff(c)
        if c in ("temperature", "wind_speed"):
            out[f"{short}_momentum"] = pct_change(c, 3, w, filled)[0]
            out[f"{short}_volatility_12h"] = F.stddev_samp(c).over(w.rowsBetween(-11, 0))
        if c == "temperature":
            out["temp_diff2_1h"] = diff(c) - (F.lag(c, 1).over(w) - F.lag(c, 2).over(w))
            out["temp_deviation_24h"] = F.col(c) - F.avg(c).over(w.rowsBetween(-23, 0))
    return out


def undefined_momentum(columns: list[str], w=None, filled: dict[str, str] | None = None) -> Column:
    """Whether a momentum of the row is 0/0, which drops the row from the full feature set."""
    w = w if w is not None else over()
    flags = [F.coalesce(pct_change(c, 3, w, filled)[1], F.lit(False)) for c in ("temperature", "wind_speed") if c in columns]
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def trend_features(df: DataFrame, size: int = CHUNK) -> DataFrame:
    if longest(df) <= size:
        return df.withColumns(trend_columns(df.columns))
    filled = {c: f"_f_{c}" for c in ("temperature", "wind_speed") if c in df.columns}
    rows = fill_forward(row_index(df, "_i"), filled, indexed=True)
    out = chunked(rows, lambda w: trend_columns(df.columns, w, filled), 24, max(size, 24), indexed=True)
    return out.drop("_i", *filled.values())


def ewma_block(spans: list[int], block: int) -> int:
    """The block size, smaller where a power of the fastest decay would leave the range of a double."""
    fastest = 1 - 2 / (min(spans) + 1)
    if not 0 < fastest < 1:
        raise ValueError("spans are whole numbers above 1")
    return max(1, min(block, int(600 / -math.log(fastest))))


def ewma_features(df: DataFrame, spans: list[int] = SPANS, target: str = TARGET, block: int = 256, indexed: bool = False) -> DataFrame:
    """Exponentially weighted means of all rows before the current one, weights (1-a)^i normalised.

    Two-level scan: within blocks of rows weighted sums are taken relative to the block's first row, and
    each block's start state follows from the totals of the blocks before it. Numerators and weights of
    present values go through the same scan, so gaps keep decaying, over any distance. No power grows
    with the series; a series is one group only as a row for each block of it. ``indexed`` rows have their
    position ``_i`` already and keep it.
    """
    block = ewma_block(spans, block)
    rows = df if indexed else row_index(df, "_i")
    w = Window.partitionBy(KEY, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"_b": F.floor(F.col("_i") / block).cast("long"), "_j": (F.col("_i") % block).cast("double")})
    x, seen = F.coalesce(F.col(target).cast("double"), F.lit(0.0)), F.col(target).isNotNull().cast("double")
    inner, totals = {}, []
    for s in spans:
        q = F.lit(1 - 2 / (s + 1))
        up = F.pow(q, -F.col("_j"))
        for k, v in (("n", x), ("d", seen)):
            inner[f"_{k}{s}"] = F.coalesce(F.sum(v * up).over(w), F.lit(0.0))
            totals.append((F.sum(v * up) * F.pow(q, F.lit(block - 1.0))).alias(f"_c{k}{s}"))
    carried = [f"_c{k}{s}" for s in spans for k in "nd"]
    ends = out.groupBy(F.col(KEY).alias("_of"), "_b").agg(*totals)
    decay = np.array([(1 - 2 / (s + 1)) ** block for s in spans for _ in "nd"])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        total, state = pdf[carried].to_numpy(float), np.zeros(len(carried))
        for i in range(len(total)):
            total[i], state = state, state * decay + total[i]
            # after a long gap the mean stays while its weight would vanish; this one is still next to nothing
            faint = (state[1::2] > 0) & (state[1::2] < 1e-100)
            if faint.any():
                state *= np.repeat(np.where(faint, 1e-100 / np.where(faint, state[1::2], 1), 1), 2)
        pdf[carried] = total
        return pdf

    starts = ends.groupBy("_of").applyInPandas(carry, ends.schema).withColumnRenamed("_b", "_at")
    both = out.join(starts, F.col(KEY).eqNullSafe(F.col("_of")) & (F.col("_b") == F.col("_at"))).withColumns(inner)
    final = {}
    for s in spans:
        # both parts stand relative to the block's first row, so their common factor falls out of the quotient
        q = 1 - 2 / (s + 1)
        num, den = F.col(f"_n{s}") + F.col(f"_cn{s}") * q, F.col(f"_d{s}") + F.col(f"_cd{s}") * q
        final[f"{target}_ewma_{s}"] = F.when(den > 0, num / den)
    return both.withColumns(final).select(*df.columns, *final)


def horizon_targets(df: DataFrame, horizons: list[int] = HORIZONS, target: str = TARGET) -> DataFrame:
    """Future targets; rows without all of them are left out."""
    cols = lambda w: {f"target_{h}h": F.lead(target, h).over(w) for h in horizons}
    return windowed(df, cols, 0, max(horizons)).na.drop(subset=[f"target_{h}h" for h in horizons])


def baseline_columns(target: str = TARGET, w=None) -> dict[str, Column]:
    w = w if w is not None else over()
    out = {"persistence": F.lag(target, 1).over(w), "seasonal_24": F.lag(target, 24).over(w), "seasonal_168": F.lag(target, 168).over(w)}
    return out | {f"moving_average_{k}": F.avg(target).over(w.rowsBetween(-k, -1)) for k in (24, 168)}


def baseline_forecasts(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One step ahead: last value, last season, trailing mean."""
    return windowed(df, lambda w: baseline_columns(target, w), 168)


def baseline_multistep(df: DataFrame, steps: int, seasons: tuple = (24, 168), windows: tuple = (24, 168), target: str = TARGET) -> DataFrame:
    """region, step and each baseline's forecast for the next steps of every series."""
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col(TS).desc()))
    longest = max(*seasons, *windows)
    last = df.select(KEY, F.col(target).alias("_y"), back.alias("_r")).filter(F.col("_r") <= longest)
    aggs = [F.max(F.when(F.col("_r") == 1, F.col("_y"))).alias("persistence"), F.count("*").alias("_n")]
    aggs += [F.avg(F.when(F.col("_r") <= k, F.col("_y"))).alias(f"moving_average_{k}") for k in windows]
    # the last season in order, bounded by the season
    aggs += [F.array_sort(F.collect_list(F.when(F.col("_r") <= k, F.struct((-F.col("_r")).alias("o"), F.col("_y").alias("y"))))).alias(f"_s{k}") for k in seasons]
    per = last.groupBy(KEY).agg(*aggs).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    tiled = [F.get(f"_s{k}", (F.col("step") - 1) % F.greatest(F.size(f"_s{k}"), F.lit(1)))["y"].alias(f"seasonal_{k}") for k in seasons]
    return per.select(KEY, "step", "persistence", *tiled, *[f"moving_average_{k}" for k in windows])


def seasonal_decompose(df: DataFrame, period: int = 24, target: str = TARGET, size: int = CHUNK) -> DataFrame:
    """Additive parts of a regular series: centred moving average, phase means (centred), rest."""
    half = period // 2

    def trend(w) -> dict[str, Column]:
        inner = F.sum(target).over(w.rowsBetween(-half + 1, half - 1))
        ends = F.lag(target, half).over(w) + F.lead(target, half).over(w)
        mean = (inner + ends / 2) / period if period % 2 == 0 else F.avg(target).over(w.rowsBetween(-half, half))
        complete = F.lag(target, half).over(w).isNotNull() & F.lead(target, half).over(w).isNotNull()
        return {"trend": F.when(complete, mean)}

    parts = chunked(row_index(df, "_i"), trend, half, max(size, half), indexed=True, ahead=half)
    parts = parts.withColumn("_phase", F.col("_i") % period)
    parts = parts.withColumn("_detrended", F.col(target) - F.col("trend"))
    phase = parts.groupBy(KEY, "_phase").agg(F.avg("_detrended").alias("_m"))  # period rows for each series
    phase = phase.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(KEY))).drop("_m")
    out = parts.join(phase, [KEY, "_phase"]).withColumn("residual", F.col("_detrended") - F.col("seasonal"))
    return out.drop("_i", "_phase", "_detrended")


def explained_variance(parts: DataFrame, target: str = TARGET) -> DataFrame:
    """Share of the variance that trend and season explain, by region."""
    rows = parts.filter("residual IS NOT NULL")
    return rows.groupBy(KEY).agg((F.lit(1.0) - F.try_divide(F.var_pop("residual"), F.var_pop(target))).alias("explained"))


def chunked(
    df: DataFrame, columns: Callable[[object], dict[str, Column]], reach: int, size: int = CHUNK, indexed: bool = False, ahead: int = 0,
    keys: tuple[str, ...] = (KEY,), within: tuple[str, ...] = (), ties: tuple = (),
) -> DataFrame:
    """Window columns of frames that look back ``reach`` rows and forward ``ahead`` rows at most, in chunks
    of ``size`` rows of each series (``keys``; none: all rows in one order).

    ``columns`` gets the window to build on; it is cut by the columns ``within`` too. Rows near the ends of a chunk
    are copied into the next one or the one before and dropped after the windows have run. ``indexed`` rows have
    their position ``_i`` already and keep it.
    """
    if size < max(reach, ahead):
        raise ValueError(f"chunks of {size} rows are shorter than their reach of {max(reach, ahead)}")
    rows = df if indexed else row_index(df, "_i", TS, list(keys), ties)
    c, chunk, own = fresh(rows, "_c", "chunk", "own")
    at, place = F.floor(F.col("_i") / size).cast("long"), F.col("_i") % size
    home = lambda d: F.struct((at + d).alias(chunk), F.lit(d == 0).alias(own))
    homes = F.array_compact(F.array(home(0), F.when(place >= size - reach, home(1)), F.when((place < ahead) & (at > 0), home(-1))))
    placed = rows.withColumn(c, F.explode(homes)).select("*", f"{c}.*").drop(c)
    w = Window.partitionBy(*keys, chunk, *within).orderBy("_i")
    return placed.withColumns(columns(w)).filter(own).drop(chunk, own, *([] if indexed else ["_i"]))


def longest(df: DataFrame, keys: tuple[str, ...] = (KEY,)) -> int:
    """Rows of the longest series."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def windowed(
    df: DataFrame, columns: Callable[[object], dict[str, Column]], reach: int, ahead: int = 0, keys: tuple[str, ...] = (KEY,), within: tuple[str, ...] = (),
    ties: tuple = (), size: int = CHUNK,
) -> DataFrame:
    """Window columns of bounded frames, in ``chunked`` form where a series has more than ``size`` rows; else a
    series is no more than a chunk and is windowed as a whole, which gives the same."""
    size = max(size, reach, ahead)
    if longest(df, keys) <= size:
        return df.withColumns(columns(Window.partitionBy(*keys, *within).orderBy(TS, *ties)))
    return chunked(df, columns, reach, size, ahead=ahead, keys=keys, within=within, ties=ties)
