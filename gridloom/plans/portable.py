"""Fitted Spark ML regressors as arrays: scored, stepped and explained in Arrow batches, without the JVM model.

A tree is five arrays over its nodes. Shapley values are those of the path-dependent game, in which a split on
an unknown feature sends a row both ways by the training rows that took them. They are summed leaf by leaf: within
one leaf a feature counts only by whether the row agrees with all its splits on the way (one bit), so every leaf
has a small table from patterns of bits to contributions, and a row looks its pattern up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.shared import scratch

#: Features on the way to a leaf up to which its whole table is made; beyond, only the patterns at hand.
TABLE = 8
NODE = (
    "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,"
    "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    _leaves: list | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return self.value[at]
            f = np.where(inner, self.feature[at], 0)
            down = np.where(x[np.arange(len(x)), f] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)

    def mean(self) -> float:
        """The value of a row of which nothing is known."""
        leaf = self.left < 0
        return float(np.average(self.value[leaf], weights=self.cover[leaf]))

    def leaves(self) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each leaf: value, features on its way, their bounds (above the first, up to the second), and the share
        of rows that their splits let through."""
        if self._leaves is None:
            out, stack = [], [(0, {})]
            while stack:
                i, way = stack.pop()
                if self.left[i] < 0:
                    f = sorted(way)
                    out.append((float(self.value[i]), np.array(f, int), *(np.array([way[k][j] for k in f], float) for j in range(3))))
                    continue
                f, t = int(self.feature[i]), float(self.threshold[i])
                for child, low, high in ((int(self.left[i]), -np.inf, t), (int(self.right[i]), t, np.inf)):
                    lo, hi, share = way.get(f, (-np.inf, np.inf, 1.0))
                    stack.append((child, way | {f: (max(lo, low), min(hi, high), share * self.cover[child] / self.cover[i])}))
            self._leaves = out
        return self._leaves

    def shapley(self, x: np.ndarray, out: np.ndarray, weight: float) -> None:
        """Add ``weight`` times the contributions of each row's features to ``out``."""
        for value, features, lo, hi, share in self.leaves():
            k = len(features)
            if k == 0 or value == 0:
                continue
            own = x[:, features]
            bits = (own > lo) & (own <= hi)
            codes = bits @ (1 << np.arange(k))
            if k <= TABLE:
                table, where = _table(np.arange(1 << k), share), codes
            else:
                kinds, where = np.unique(codes, return_inverse=True)
                table = _table(kinds, share)
            out[:, features] += weight * value * table[where]


def _table(codes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Contributions, for each pattern of agreeing features and a leaf of value 1."""
    k = len(share)
    agree = (codes[:, None] >> np.arange(k)) & 1
    weight = np.array([factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)])
    out = np.empty((len(codes), k))
    for j in range(k):
        e = np.zeros((len(codes), k))  # by how many of the other features are known
        e[:, 0] = 1.0
        for i in range(k):
            if i != j:
                e[:, 1:] = e[:, 1:] * share[i] + e[:, :-1] * agree[:, i : i + 1]
                e[:, 0] *= share[i]
        out[:, j] = (agree[:, j] - share[j]) * (e @ weight)
    return out


@dataclass
class Portable:
    """A regressor as arrays; ``predict`` and ``shapley`` take a matrix with a column for each of ``features``."""

    features: list[str]
    intercept: float = 0.0
    coefficients: np.ndarray | None = None
    means: np.ndarray | None = None
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        known = np.isfinite(x).all(axis=1)
        z = np.where(known[:, None], x, 0.0)
        y = np.full(len(x), self.intercept)
        if self.coefficients is not None:
            y = y + z @ self.coefficients
        for t, w in zip(self.trees, self.weights, strict=True):
            y = y + w * t.predict(z)
        return np.where(known, y, np.nan)

    def base(self) -> float:
        """What contributions are counted from."""
        own = float(self.means @ self.coefficients) if self.coefficients is not None else 0.0
        return self.intercept + own + sum(w * t.mean() for t, w in zip(self.trees, self.weights, strict=True))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape) if self.coefficients is None else (x - self.means) * self.coefficients
        for t, w in zip(self.trees, self.weights, strict=True):
            t.shapley(x, out, w)
        return out


def portable(fitted, train: DataFrame | None = None) -> Portable:
    """A fitted model's arrays (``modeling.Fitted``). Trees are read from the model's own files in the shared folder, a
    row for each node. Linear models take their features' means from ``train`` (0 without it)."""
    model, features = fitted.model, list(fitted.features)
    if isinstance(model, LinearRegressionModel):
        from gridloom.operators.gram import means

        at = np.array(means(train, features) if train is not None else [0.0] * len(features))
        return Portable(features, float(model.intercept), np.array(model.coefficients.toArray(), float), at)
    if not isinstance(model, DecisionTreeRegressionModel | GBTRegressionModel | RandomForestRegressionModel):
        raise TypeError(f"no arrays of a {type(model).__name__}")
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = scratch(spark, "model")
    model.save(path)
    single = isinstance(model, DecisionTreeRegressionModel)
    schema = T.StructType.fromDDL(f"n {NODE}")["n"].dataType if single else T.StructType.fromDDL(f"treeID int, nodeData {NODE}")
    stored = spark.read.schema(schema).parquet(f"{path}/data")
    rows = [(0, r) for r in stored.collect()] if single else [(r["treeID"], r["nodeData"]) for r in stored.collect()]
    trees: dict[int, list] = {}
    for t, n in rows:
        trees.setdefault(t, []).append(n)
    weights = [1.0] if single else list(model.treeWeights)
    if isinstance(model, RandomForestRegressionModel):
        weights = [w / sum(weights) for w in weights]
    made = []
    for t in sorted(trees):
        nodes = sorted(trees[t], key=lambda n: n["id"])
        at = {n["id"]: i for i, n in enumerate(nodes)}
        if any(n["split"]["numCategories"] > -1 for n in nodes):
            raise ValueError("splits by categories have no arrays")
        child = lambda k: np.array([at.get(n[k], -1) for n in nodes])  # noqa: B023, E731
        made.append(Tree(
            np.array([max(n["split"]["featureIndex"], 0) for n in nodes]), np.array([(n["split"]["leftCategoriesOrThreshold"] or [0.0])[0] for n in nodes], float),
            child("leftChild"), child("rightChild"), np.array([n["prediction"] for n in nodes], float), np.array([n["rawCount"] for n in nodes], float),
        ))
    return Portable(features, trees=made, weights=weights)


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    """Columns as one matrix, NaN for nulls."""
    return np.column_stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]) if features else np.zeros((len(batch), 0))


def score(df: DataFrame, model, features: list[str], name: str = "prediction") -> DataFrame:
    """``df`` with predictions of any model that can be pickled and has ``predict`` of a matrix: a model of another
    library, or a ``Portable``. Rows that lack a feature get null."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    columns = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b, features)
            known = np.isfinite(x).all(axis=1)
            y = np.full(len(x), np.nan)
            if known.any():
                y[known] = np.asarray(model.predict(x[known]), float).reshape(-1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y, pa.float64(), mask=~np.isfinite(y))], [*columns, name])

    return df.mapInArrow(run, schema)


def contributions(df: DataFrame, model: Portable, name: str = "contributions") -> DataFrame:
    """``df`` with an array of (feature, value, contribution) of each row; null where a feature is missing."""
    item = T.StructType([T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("contribution", T.DoubleType())])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(item))])
    columns, features = df.columns, model.features

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("feature", pa.string()), ("value", pa.float64()), ("contribution", pa.float64())])
        for b in it:
            x = matrix(b, features)
            known = np.isfinite(x).all(axis=1)
            phi = np.zeros(x.shape)
            if known.any():
                phi[known] = model.shapley(x[known])
            n, k = x.shape
            flat = pa.StructArray.from_arrays([pa.array(np.tile(np.array(features, object), n), pa.string()), pa.array(x.reshape(-1)), pa.array(phi.reshape(-1))], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), flat, mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*columns, name])

    return df.mapInArrow(run, schema)


def explain_model(df: DataFrame, model: Portable | None, features: list[str], top: int = 10, keys: tuple = ("region", "timestamp"), importances: dict[str, float] | None = None) -> DataFrame:
    """keys, rank, feature, value, contribution, importance, method of each row's ``top`` (1 to 50) features: by Shapley
    values; for models without them by global ``importances``, which have no sign; without these all features alike."""
    if model is not None:
        rows, method = contributions(df, model, "_all"), "shapley"
    else:
        known = importances and sum(abs(v) for v in importances.values()) > 0
        method = "importance" if known else "uniform"
        size = {f: abs(importances.get(f, 0.0)) if known else 1.0 / max(len(features), 1) for f in features}
        parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(float(size[f])).alias("contribution")) for f in features]
        rows = df.withColumn("_all", F.array(*parts))
    total = F.aggregate("_all", F.lit(0.0), lambda a, c: a + F.abs(c["contribution"]))
    by_size = F.transform("_all", lambda c: F.struct((-F.abs(c["contribution"])).alias("o"), c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution")))
    out = rows.select(*keys, total.alias("_t"), F.posexplode(F.slice(F.array_sort(by_size), 1, max(1, min(top, 50)))).alias("_i", "_c"))
    share = F.when(F.col("_t") > 0, -F.col("_c.o") / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(F.lit(1.0 / max(len(features), 1)))
    return out.select(*keys, (F.col("_i") + 1).alias("rank"), "_c.feature", "_c.value", "_c.contribution", share.alias("importance"), F.lit(method).alias("method"))
