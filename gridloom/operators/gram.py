"""Sums of products of many columns in one pass: correlations and normal equations of any width.

Every task keeps one small matrix for each group and adds blocks of rows to it, so a pass costs one matrix product
and shuffles a matrix for each group and task, row by row of it, not the data. Columns are shifted by their
means first, since differences of large sums would lose the digits that matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose matrices a task holds before it hands them on.
HELD = 256


def means(df: DataFrame, columns: list[str]) -> list[float]:
    """The mean of each column, 0 for one without values: a number for each column."""
    one = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [float(v) if v is not None and np.isfinite(v) else 0.0 for v in one]


def gram(df: DataFrame, columns: list[str], shift: list[float] | None = None, by: str | None = None) -> DataFrame:
    """group (text of the column ``by``, null without one), n, and m: the matrix of sums of products of (1, columns less
    their shift), as a list of rows. Rows with a null or non-finite value are left out."""
    shift = np.array(means(df, columns) if shift is None else shift, float)
    k = len(columns) + 1
    rows = df.select((F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("group"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = pa.schema([("group", pa.string()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, m in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * k, pa.string()), pa.array(range(k), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], schema=schema)
            held.clear()

        for b in it:
            x = np.column_stack([np.ones(len(b)), *[b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) - shift[i] for i in range(k - 1)]])
            whole = np.isfinite(x).all(axis=1)
            codes = b.column(0).dictionary_encode()
            of = np.array([-1 if v is None else v for v in codes.indices.to_pylist()])
            names = [*codes.dictionary.to_pylist(), None]  # the last, by index -1, is the null group
            for c in np.unique(of[whole]):
                part = x[whole & (of == c)]
                held[names[c]] = held.get(names[c], 0) + part.T @ part
            if len(held) > HELD:
                yield from out()
        yield from out()

    parts = rows.mapInArrow(run, "group string, i int, row array<double>")
    cells = parts.select("group", "i", F.posexplode("row").alias("j", "v")).groupBy("group", "i", "j").agg(F.sum("v").alias("v"))
    lines = cells.groupBy("group", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))
    whole = lines.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda s: s["row"]).alias("m"))
    return whole.select("group", F.round(F.col("m")[0][0]).cast("long").alias("n"), "m")


def correlation_matrix(m: np.ndarray) -> np.ndarray:
    """Correlations from a matrix of ``gram``; NaN where a column is constant."""
    s, n = m[0, 1:], m[0, 0]
    cov = m[1:, 1:] - np.outer(s, s) / n
    d = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.outer(d, d) > 0, cov / np.outer(d, d), np.nan)


def least_squares(m: np.ndarray, shift: np.ndarray, ridge: float = 1e-6) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the last column on the others, from a matrix of ``gram``."""
    a, y = m[:-1, :-1], m[:-1, -1]
    penalty = ridge * np.eye(len(a))
    penalty[0, 0] = 0.0
    w = np.linalg.lstsq(a + penalty, y, rcond=None)[0]
    return float(w[0] + shift[-1] - w[1:] @ shift[:-1]), w[1:]
