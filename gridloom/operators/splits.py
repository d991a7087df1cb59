"""Row positions on time order without a one-task sort, and what is cut by them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import fresh

BUCKET = "day"


def row_index(df: DataFrame, name: str, ts: str = "timestamp", key: str | list[str] | None = "region", ties: tuple = ()) -> DataFrame:
    """Position from 0 on time order, within ``key`` (one column or several) or (None) over all rows.

    Rows are counted by day first; running sums of these small counts give each day's offset, and
    the rank within a day is added. Ties are ordered by ``ties`` (the region, over all rows). Rows without
    a timestamp come last, rows without a key are a group of their own.
    """
    keys = [key] if isinstance(key, str) else list(key or [])
    ties = ties or (() if keys else ("region",))
    part, n, before, rank, *of = fresh(df, "_part", "_n", "_before", "_rank", *[f"_of_{k}" for k in (*keys, "part")])
    rows = df.withColumn(part, F.date_trunc(BUCKET, ts))
    counts = rows.groupBy(*keys, part).agg(F.count("*").alias(n))
    order = Window.partitionBy(*keys).orderBy(F.col(part).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*[F.col(k).alias(o) for k, o in zip((*keys, part), of, strict=True)], F.coalesce(F.sum(n).over(order), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(*keys, part).orderBy(F.col(ts).asc_nulls_last(), *ties)) - 1
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip((*keys, part), of, strict=True)])
    ranked = rows.withColumn(rank, place).join(offset, same)
    return ranked.withColumn(name, F.col(before) + F.col(rank)).drop(part, rank, before, *of)


def temporal_split(df: DataFrame, train: float = 0.70, val: float = 0.15, ts: str = "timestamp") -> DataFrame:
    """``split``: train, val or test by position on time order."""
    n = df.count()
    a, b = int(n * train), int(n * (train + val))
    at = row_index(df, "_i", ts, None)
    cut = F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "val").otherwise("test")
    return at.withColumn("split", cut).drop("_i")


def fold_bounds(n: int, k: int, mode: str = "expanding", window: float = 0.6) -> list[tuple[int, int, int, int]]:
    """(fold, first train row, first test row, end) of each fold."""
    if mode == "expanding":
        size = n // (k + 1)
        if size == 0:
            raise ValueError(f"{n} rows are too few for {k} folds")
        return [(f, 0, n - (k - f) * size, n - (k - f - 1) * size) for f in range(k)]
    if mode != "walk-forward":
        raise ValueError(f"unknown mode {mode!r}")
    width = max(1, int(n * window))
    left = n - width
    k = k if left >= k else max(1, left)
    step = max(1, left // k)
    ends = [(f, f * step, f * step + width, min(f * step + width + step, n)) for f in range(k)]
    return [x for x in ends if x[2] < x[3]]


def cv_folds(df: DataFrame, k: int, mode: str = "expanding", ts: str = "timestamp") -> DataFrame:
    """Rows repeated for each fold they belong to, with ``fold`` and ``role`` (train or test)."""
    rows = row_index(df, "_i", ts, None)
    bounds = [F.struct(*[F.lit(int(x)).alias(c) for c, x in zip(("fold", "a", "b", "c"), f, strict=True)]) for f in fold_bounds(df.count(), k, mode)]
    held = F.filter(F.array(*bounds), lambda f: (F.col("_i") >= f["a"]) & (F.col("_i") < f["c"]))
    out = rows.withColumn("_f", F.explode(held))
    return out.withColumns({"fold": F.col("_f.fold"), "role": F.when(F.col("_i") < F.col("_f.b"), "train").otherwise("test")}).drop("_f", "_i")
