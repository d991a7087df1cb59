"""Training, validation and forecasting with Spark ML."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.intervals import prediction_intervals
from gridloom.operators.explore import correlations
from gridloom.operators.gram import gram, least_squares, means
from gridloom.operators.metrics import baseline_improvement, conformal_quantile, evaluate_baselines, mase, overall_and_regions, regression_aggs, regression_metrics
from gridloom.operators.quality import valid_prediction
from gridloom.operators.quantiles import attach
from gridloom.operators.series import LAGS, SPANS, WINDOWS, horizon_targets
from gridloom.operators.splits import cv_folds, row_index, temporal_split
from gridloom.shared import materialise

TARGET = "consumption_mw"
DEFAULTS = {
    "gbt": {"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "validationTol": 0.001, "seed": 42}, "forest": {"numTrees": 40, "maxDepth": 8, "seed": 42},
    "linear": {"regParam": 1e-6},
}
SPACES = {
    "gbt": {"maxIter": [20, 40, 80], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1, 0.2]},
    "forest": {"numTrees": [20, 40, 80], "maxDepth": [5, 8, 10]}, "linear": {"regParam": [1e-6, 1e-3, 1e-1]},
}


def make_regressor(kind: str, params: dict | None = None, label: str = TARGET):
    made = {"gbt": GBTRegressor, "forest": RandomForestRegressor, "linear": LinearRegression}
    if kind not in made:
        raise ValueError(f"unknown model {kind!r}; one of {sorted(made)}")
    return made[kind](featuresCol="features", labelCol=label, predictionCol="prediction", **DEFAULTS[kind] | (params or {}))


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


@dataclass
class Fitted:
    """A model with the features it needs."""

    model: Transformer
    features: list[str]
    kind: str = ""
    metrics: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(assemble(df, self.features)).drop("features")


def fit_regressor(kind: str, train: DataFrame, val: DataFrame | None, features: list[str], params: dict | None = None, label: str = TARGET) -> Fitted:
    """Fit; boosted trees stop when the validation error no longer falls."""
    est = make_regressor(kind, params, label)
    rows = train
    if kind == "gbt" and val is not None:
        rows = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
        est = est.setValidationIndicatorCol("_val")
    return Fitted(est.fit(assemble(rows, features)), features, kind)


#: Fits that run at the same time.
SIDE_BY_SIDE = 4


def side_by_side(spark: SparkSession, jobs: list[Callable[[], object]], most: int = SIDE_BY_SIDE) -> list:
    """Results of jobs that run at the same time, in their order. Each has a pool of its own, so that a scheduler in
    FAIR mode shares the executors between them, and all have one tag: when one fails, the others are cancelled."""
    tag = f"fits-{uuid.uuid4().hex}"

    def run(i: int) -> object:
        context = spark.sparkContext
        context.addJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", f"fits-{i % most}")
        return jobs[i]()

    with ThreadPoolExecutor(max(1, min(most, len(jobs)))) as pool:
        found = [pool.submit(inheritable_thread_target(spark)(run), i) for i in range(len(jobs))]
        done, rest = wait(found, return_when=FIRST_EXCEPTION)
        if any(f.exception() for f in done):
            for f in rest:
                f.cancel()
            spark.sparkContext.cancelJobsWithTag(tag)
    failed = [f for f in found if f in done and f.exception()]
    if failed:
        raise failed[0].exception()
    return [f.result() for f in found]


def train_and_select(train: DataFrame, val: DataFrame, features: list[str], kinds: tuple = ("linear", "forest", "gbt"), label: str = TARGET) -> tuple[Fitted, DataFrame]:
    """The candidate with the least validation RMSE, and the metrics of all; candidates are fitted side by side."""
    spark = train.sparkSession

    def one(kind: str) -> Fitted:
        got = fit_regressor(kind, train, val, features, label=label)
        got.metrics = regression_metrics(got.predict(val), label, "prediction").first().asDict()
        return got

    found = side_by_side(spark, [lambda k=kind: one(k) for kind in kinds])
    rows = [(g.kind, float(g.metrics["rmse"]), float(g.metrics["mae"]), g.metrics["mape"], g.metrics["r2"]) for g in found]
    best = min(found, key=lambda g: g.metrics["rmse"])
    return best, spark.createDataFrame(rows, "model string, rmse double, mae double, mape double, r2 double")


def time_series_cv(df: DataFrame, features: list[str], kinds: tuple = ("linear",), k: int = 5, mode: str = "expanding", params: dict | None = None) -> DataFrame:
    """model, fold, rmse, mae, n of each fold; the folds are cut once and fitted side by side."""
    folds = cv_folds(df, k, mode).cache()
    out = side_by_side(df.sparkSession, [lambda kind=kind, f=f: _fold(folds, kind, f, features, params) for kind in kinds for f in range(k)])
    folds.unpersist()
    return df.sparkSession.createDataFrame([r for r in out if r], "model string, fold int, rmse double, mae double, n long")


def _fold(folds: DataFrame, kind: str, f: int, features: list[str], params: dict | None) -> tuple | None:
    part = folds.filter(F.col("fold") == f)
    got = fit_regressor(kind, part.filter("role = 'train'"), None, features, params)
    m = regression_metrics(got.predict(part.filter("role = 'test'")), TARGET, "prediction").first()
    return (kind, f, float(m["rmse"]), float(m["mae"]), int(m["n"])) if m["n"] else None


def _staged(folds: DataFrame, f: int, features: list[str], params: dict, sizes: list[int]) -> list[float] | None:
    """RMSE of a fold after each of several numbers of boosted trees, of one fit: fewer trees are the first of more."""
    part = folds.filter(F.col("fold") == f)
    got = fit_regressor("gbt", part.filter("role = 'train'"), None, features, params | {"maxIter": max(sizes)})
    test = assemble(part.filter(f"role = 'test' AND {TARGET} IS NOT NULL"), features)
    squares = got.model.evaluateEachIteration(test, "squared")
    return None if math.isnan(squares[0]) else [math.sqrt(squares[n - 1]) for n in sizes]


def tune(df: DataFrame, kind: str, features: list[str], n: int = 4, k: int = 3, seed: int = 42, space: dict | None = None, search: str = "random") -> tuple[dict, DataFrame]:
    """The best point of a space by mean fold RMSE: of ``n`` different seeded draws (all points, if it has fewer), or
    of its whole ``grid``. All folds of all points are fitted side by side on folds that are cut once; points of
    boosted trees that differ in nothing but the number of trees share their fits."""
    space = space or SPACES[kind]
    points = [dict(zip(sorted(space), v, strict=True)) for v in product(*[space[p] for p in sorted(space)])]
    if search == "random":
        points = random.Random(seed).sample(points, min(n, len(points)))
    elif search != "grid":
        raise ValueError(f"unknown search {search!r}")
    alike: dict[str, list[int]] = {}
    for i, p in enumerate(points):
        own = {n: v for n, v in p.items() if n != "maxIter"} if kind == "gbt" and "maxIter" in p else p | {"_": i}
        alike.setdefault(str(own), []).append(i)
    groups = list(alike.values())
    folds = cv_folds(df, k).cache()

    def one(group: list[int], f: int) -> list[float] | None:
        p = points[group[0]]
        if len(group) > 1:
            return _staged(folds, f, features, p, [points[i]["maxIter"] for i in group])
        got = _fold(folds, kind, f, features, p)
        return got and [got[2]]

    found = side_by_side(df.sparkSession, [lambda g=g, f=f: one(g, f) for g in groups for f in range(k)])
    folds.unpersist()
    tried = []
    for j, group in enumerate(groups):
        own = [r for r in found[j * k : (j + 1) * k] if r]
        tried += [(i, str(points[i]), sum(r[m] for r in own) / len(own), points[i]) for m, i in enumerate(group)]
    tried.sort(key=lambda t: t[0])
    best = min(tried, key=lambda t: t[2])
    return best[3], df.sparkSession.createDataFrame([t[:3] for t in tried], "trial int, params string, rmse double")


def correlation_filter(df: DataFrame, features: list[str], threshold: float = 0.95) -> list[str]:
    """Features without those that correlate with an earlier kept one; pairs come to the driver."""
    close = {(r["a"], r["b"]) for r in correlations(df, features).filter(F.abs("r") > threshold).collect()}
    kept: list[str] = []
    for f in features:
        if not any((k, f) in close for k in kept):
            kept.append(f)
    return kept


def permutation_importance(fitted: Fitted, df: DataFrame, repeats: int = 10, seed: int = 42, label: str = TARGET) -> DataFrame:
    """feature, importance (mean rise of the squared error), std: each feature in turn gets the values of
    other rows. All features and repeats are one job: every row's number meets the number that it has in
    an order by hash, ranked within buckets of the hash and put together with the buckets' counts."""
    rows = row_index(df.select("timestamp", "region", label, *fitted.features), "_i", key=None)
    trials = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.col(f).cast("double").alias("_v")) for f in fitted.features for r in range(repeats)])
    each = rows.select("_i", F.inline(trials)).withColumn("_h", F.xxhash64(F.lit(seed), "repeat", "feature", "_i"))
    key, bucket = ["feature", "repeat"], F.shiftright("_h", 52)  # 4096 buckets of each trial
    mixed = each.withColumn("_b", bucket)
    counts = mixed.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*key, "_b", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(*key, "_b").orderBy("_h", "_i")) - 1
    place = mixed.withColumn("_rank", rank).join(before, [*key, "_b"]).select(*key, (F.col("_o") + F.col("_rank")).alias("_i"), "_v")
    swapped = rows.join(place, "_i")
    swapped = swapped.withColumns({f: F.when(F.col("feature") == f, F.col("_v")).otherwise(F.col(f)) for f in fitted.features})
    error = F.avg((F.col(label) - F.col("prediction")) ** 2)
    base = fitted.predict(rows).agg(error).first()[0]
    mse = fitted.predict(swapped).groupBy(*key).agg((error - F.lit(base)).alias("rise"))
    return mse.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std"))


def select_features(train: DataFrame, val: DataFrame, features: list[str], most: int = 20, kind: str = "linear", repeats: int = 10, threshold: float = 0.95) -> tuple[list[str], DataFrame]:
    """Correlation filter, then the most important of what stays, with their importances."""
    kept = correlation_filter(train, features, threshold)
    scores = permutation_importance(fit_regressor(kind, train, None, kept), val, repeats)
    top = [r["feature"] for r in scores.orderBy(F.col("importance").desc(), "feature").limit(most).collect()]
    return top, scores


def train_variant(
    df: DataFrame, features: list[str], kind: str = "linear", folds: int = 3, alpha: float = 0.1, trials: int = 4, most: int = 20, repeats: int = 10
) -> dict:
    """One variant from features to report: split, baselines, folds, tuning on the training rows, selection
    of features, fit, calibration on the later half of validation, refit, test report, feature statistics.

    ``trials`` or ``most`` of 0 leave out tuning or selection.
    """
    from gridloom.operators.drift import feature_stats

    split = temporal_split(df).cache()
    train, val, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    cv = time_series_cv(train, features, (kind,), folds)
    params, tuning = tune(train, kind, features, trials, folds) if trials else ({}, None)
    importances = None
    if most:
        features, importances = select_features(train, val, features, most, kind, repeats)
    first = fit_regressor(kind, train, val, features, params)
    late = row_index(val, "_i", key=None)
    late = late.filter(F.col("_i") >= val.count() // 2).drop("_i")
    q = conformal_quantile(first.predict(late), TARGET, "prediction", alpha)
    if kind == "gbt":  # as many trees as validation left
        params = params | {"maxIter": first.model.getNumTrees}
    final = fit_regressor(kind, train.unionByName(val), None, features, params)
    scored = final.predict(test)
    report = {
        "model": final, "cv": cv, "params": params, "tuning": tuning, "features": features, "importances": importances, "conformal": q,
        "metrics": overall_and_regions(scored, TARGET, "prediction"), "mase": mase(scored, train, TARGET, "prediction"),
        "baselines": evaluate_baselines(split, F.col("split") == "test"), "stats": feature_stats(train, features),
    }
    split.unpersist()  # the lazy parts of the report read the input again
    return report


#: Feature sets of the variants.
VARIANTS = ("with_lags", "no_lags", "advanced")


def variant_features(df: DataFrame, variant: str) -> tuple[DataFrame, list[str]]:
    """The full feature set of a variant from clean hourly rows, and its feature columns; rows that lack one are out."""
    from gridloom.plans import features as sets

    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; one of {VARIANTS}")
    out = sets.features_no_lags(df) if variant == "no_lags" else sets.features_full(df, advanced=variant == "advanced")
    columns = sets.feature_columns(out)
    return out.na.drop(subset=[*columns, TARGET]), columns


def train_variants(df: DataFrame, variants: tuple = VARIANTS, kind: str = "linear", **more) -> tuple[dict[str, dict], DataFrame]:
    """Every variant from clean hourly rows to its report, and a table: variant, n_features, rmse, mae, mape, r2, best
    baseline and the gain over it, the best variant first."""
    reports, rows = {}, []
    for variant in variants:
        data, columns = variant_features(df, variant)
        report = train_variant(materialise(data, variant), columns, kind, **more)
        m = report["metrics"].filter("region IS NULL").first()
        best = baseline_improvement(report["baselines"].filter("region IS NULL"), float(m["rmse"])).first()
        reports[variant] = report
        rows.append((variant, len(report["features"]), m["rmse"], m["mae"], m["mape"], m["r2"], best["baseline"], best["rmse"], best["improvement_pct"]))
    schema = "variant string, n_features int, rmse double, mae double, mape double, r2 double, baseline string, baseline_rmse double, improvement_pct double"
    return reports, df.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[2]), schema)


def train_per_region(df: DataFrame, features: list[str], label: str = TARGET, ridge: float = 1e-6) -> DataFrame:
    """region, n, intercept, coefficients of a least-squares model for each region.

    Sums of products are aggregated in Spark, so a region's rows never gather in one task; only the
    small normal equations are solved in Python.
    """
    shift = np.array(means(df, [*features, label]))

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            solved = [least_squares(np.array([list(r) for r in m], float), shift, ridge) for m in pdf["m"]]
            yield pd.DataFrame({"region": pdf["group"], "n": pdf["n"], "intercept": [a for a, _ in solved], "coefficients": [w.tolist() for _, w in solved]})

    return gram(df, [*features, label], shift.tolist(), "region").mapInPandas(solve, "region string, n long, intercept double, coefficients array<double>")


def predict_per_region(df: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    m = models.select("region", "intercept", "coefficients")
    total = F.col("intercept")
    for i, c in enumerate(features):
        total = total + F.get("coefficients", F.lit(i)) * F.col(c)
    return df.join(m, "region").withColumn("prediction", total).drop("intercept", "coefficients")


def train_multistep(df: DataFrame, features: list[str], horizons: tuple = (1, 6, 12, 24), kinds: tuple = ("linear", "forest", "gbt")) -> DataFrame:
    """horizon, model, rmse, mae, q90 of the best of several models for each horizon; choice and q90 come from
    validation, errors from test."""
    rows = temporal_split(horizon_targets(df, list(horizons))).cache()

    def one(h: int) -> tuple:
        label = f"target_{h}h"
        got, _ = train_and_select(rows.filter("split = 'train'"), rows.filter("split = 'val'"), features, kinds, label)
        q = conformal_quantile(got.predict(rows.filter("split = 'val'")), label, "prediction").first()["q"]
        m = regression_metrics(got.predict(rows.filter("split = 'test'")), label, "prediction").first()
        return h, got.kind, float(m["rmse"]), float(m["mae"]), float(q)

    out = side_by_side(df.sparkSession, [lambda h=h: one(h) for h in horizons])
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "horizon int, model string, rmse double, mae double, q90 double")


def _walk(df: DataFrame, part: Column, least: int, fit_predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame | None:
    """Metrics of each part from the ``least`` + 1st on, forecast from the parts before it."""
    parts = df.withColumn("_p", part).cache()
    sizes = parts.groupBy("_p").count().orderBy("_p").collect()  # a row for each month
    rows, schema, seen = [], None, 0
    for i, r in enumerate(sizes):
        if i >= least:
            train, test = parts.filter(F.col("_p") < r["_p"]), parts.filter(F.col("_p") == r["_p"])
            m = overall_and_regions(fit_predict(train, test), TARGET, "prediction")
            m = m.withColumns({"month": F.lit(r["_p"]), "n_train": F.lit(seen).cast("long")})
            rows, schema = rows + m.collect(), m.schema  # a row for each region
        seen += r["count"]
    parts.unpersist()
    return df.sparkSession.createDataFrame(rows, schema) if rows else None


def backtest_monthly(df: DataFrame, features: list[str], kind: str = "linear", least: int = 3) -> DataFrame:
    """Each month from the ``least`` + 1st on, forecast by a model of all months before it: month, n_train,
    region (null: all), n and errors. Linear models need no refits: see ``backtest_linear``."""
    month = F.date_format("timestamp", "yyyy-MM")
    if kind == "linear":
        return backtest_linear(df, features, least)[0]
    out = _walk(df, month, least, lambda tr, te: fit_regressor(kind, tr, None, features).predict(te))
    if out is None:
        raise ValueError(f"a backtest needs more than {least} months")
    return out


def backtest_linear(df: DataFrame, features: list[str], least: int = 3, ridge: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The monthly backtest of least squares by running totals: the sums of products of every month come from one
    pass, their totals so far give the model before each month (a solve for each), and one more pass scores every row
    by its month's model. Returns the errors as ``backtest_monthly`` does, and the models: month, n_train,
    intercept, coefficients."""
    shift = np.array(means(df, [*features, TARGET]))
    rows = df.select("region", F.date_format("timestamp", "yyyy-MM").alias("_month"), *dict.fromkeys([*features, TARGET]))
    parts = gram(rows.filter("_month IS NOT NULL"), [*features, TARGET], shift.tolist(), "_month").orderBy("group").collect()  # a matrix for each month
    total, models = 0.0, []
    for i, r in enumerate(parts):
        if i >= least:
            intercept, w = least_squares(total, shift, ridge)
            models.append((r["group"], int(round(total[0, 0])), intercept, w.tolist()))
        total = total + np.array(r["m"])
    if not models:
        raise ValueError(f"a backtest needs more than {least} months")
    made = df.sparkSession.createDataFrame(models, "month string, n_train long, intercept double, coefficients array<double>")
    own = made.select(F.col("month").alias("_of"), F.col("n_train").alias("_n"), F.struct("intercept", "coefficients").alias("_w"))
    met = rows.join(F.broadcast(own), F.col("_month") == F.col("_of"))  # a row for each month
    y = F.col("_w.intercept")
    for i, c in enumerate(features):
        y = y + F.get("_w.coefficients", F.lit(i)) * F.col(c)
    scored = met.select(F.col("_of").alias("month"), F.col("_n").alias("n_train"), "region", F.col(TARGET).alias("_y"), y.alias("prediction"))
    sets = [[F.col("month"), F.col("n_train")], [F.col("month"), F.col("n_train"), F.col("region")]]
    return scored.groupingSets(sets, F.col("month"), F.col("n_train"), F.col("region")).agg(*regression_aggs("_y", "prediction")), made


def backtest_wide(errors: DataFrame, regions: list[str], columns: tuple = ("mae", "rmse", "mape", "r2")) -> DataFrame:
    """A row for each month of a backtest: month, n_train, n_test, the errors over all regions, and those of each region as
    ``<region>_<error>``."""
    every = errors.filter("region IS NULL").select("month", "n_train", F.col("n").alias("n_test"), *columns)
    own = errors.filter("region IS NOT NULL").groupBy("month").agg(
        *[F.max(F.when(F.col("region") == r, F.col(c))).alias(f"{r}_{c}") for r in regions for c in columns]
    )
    return attach(every, own, ["month"])


def backtest_seasonal(df: DataFrame, features: list[str], kind: str = "linear", share: float = 0.7) -> DataFrame:
    """season and errors; in each season the first rows train and the rest test."""
    from gridloom.functions.calendars import season

    rows = df.withColumn("season", season(F.col("timestamp")))
    at = row_index(rows, "_i", key="season", ties=("region",)).cache()
    out = []
    for r in at.groupBy("season").agg(F.count("*").alias("n")).orderBy("season").collect():
        own = at.filter(F.col("season") == r["season"])
        cut = int(r["n"] * share)
        got = fit_regressor(kind, own.filter(F.col("_i") < cut), None, features)
        m = regression_metrics(got.predict(own.filter(F.col("_i") >= cut)), TARGET, "prediction").withColumns({"season": F.lit(r["season"]), "n_train": F.lit(cut)})
        out += m.collect()  # a row for each season
        schema = m.schema
    at.unpersist()
    return df.sparkSession.createDataFrame(out, schema)


def seed_stability(train: DataFrame, test: DataFrame, features: list[str], seeds: list[int], kind: str = "forest", params: dict | None = None) -> DataFrame:
    """mean and std of MAPE and R2 over seeds, and whether the former varies by less than 0.1."""

    def one(s: int) -> tuple:
        m = regression_metrics(fit_regressor(kind, train, None, features, (params or {}) | {"seed": s}).predict(test), TARGET, "prediction").first()
        return s, m["mape"], m["r2"]

    rows = side_by_side(train.sparkSession, [lambda s=s: one(s) for s in seeds])
    each = train.sparkSession.createDataFrame(rows, "seed int, mape double, r2 double")
    return each.agg(
        F.count("*").alias("n"), F.avg("mape").alias("mape_mean"), F.stddev_pop("mape").alias("mape_std"), F.avg("r2").alias("r2_mean"),
        F.stddev_pop("r2").alias("r2_std"), (F.stddev_pop("mape") < 0.1).alias("stable"),
    )


def predict_batch(fitted: Fitted, df: DataFrame, q90: float | None, rmse: float, name: str = "model") -> DataFrame:
    """Predictions with intervals for all rows at once."""
    out = fitted.predict(df).withColumns({"y_pred": F.col("prediction"), "q90": F.lit(q90).cast("double"), "rmse": F.lit(rmse), "model_name": F.lit(name)})
    return prediction_intervals(out).drop("prediction", "q90", "rmse")


def predict_sequential(
    history: DataFrame, future: DataFrame, step, most: int = 168, least: int = 48, target: str = TARGET
) -> DataFrame:
    """region, timestamp, y_pred: each forecast enters the lags of the next one.

    ``step`` is a model with ``features`` and ``predict`` of a matrix (``portable`` makes one of a fitted model), or a
    function from a dictionary of a future row's columns and of lag features to a number. A series carries its last
    rows and the sums of its exponential means, not features of its whole history, so a step costs the same at
    any length; a task steps ``TOGETHER`` series at once. Regions with more than ``most`` future rows or fewer than
    ``least`` rows of history are rejected with an error.
    """
    need = 49
    ahead_n = future.groupBy(F.col("region").alias("_of")).agg(F.count("*").alias("_ahead"))
    behind_n = history.groupBy("region").agg(F.count("*").alias("_past"))
    sizes = ahead_n.join(behind_n, F.col("region").eqNullSafe(F.col("_of")), "left").select("_of", "_ahead", F.coalesce("_past", F.lit(0)).alias("_past"))
    wrong = sizes.filter((F.col("_ahead") > most) | (F.col("_past") < least) | F.col("_of").isNull()).limit(5).collect()
    if wrong:
        listed = "; ".join(f"{r['_of']}: {r['_ahead']} rows ahead, {r['_past']} behind" for r in wrong)
        raise ValueError(f"a forecast takes {most} rows ahead at most and {least} behind at least: {listed}")
    back = F.row_number().over(Window.partitionBy("region").orderBy(F.col("timestamp").desc()))
    from gridloom.operators.series import ewma_features

    # exponential means after the last row, from the same scan as in training: a row is added behind it
    tail = history.select("region", "timestamp", target)
    nxt = tail.groupBy("region").agg(F.max("timestamp").alias("timestamp"), F.count("*").alias("_n"))
    kind = history.schema["timestamp"].dataType
    probe = nxt.select("region", (F.col("timestamp") + F.expr("interval 1 hour")).cast(kind).alias("timestamp"), F.lit(None).cast("double").alias(target))
    means = ewma_features(tail.unionByName(probe)).join(probe.select("region", "timestamp"), ["region", "timestamp"], "left_semi")
    # the means' weights: of the rows that have a value, by their distance from the end
    back_of = F.row_number().over(Window.partitionBy("region").orderBy(F.col("timestamp").desc())) - 1
    held = tail.withColumn("_k", back_of).filter(F.col(target).isNotNull())
    weights = held.groupBy("region").agg(*[F.sum(F.pow(F.lit(1 - 2 / (s + 1)), F.col("_k"))).alias(f"_d{s}") for s in SPANS])
    state = means.join(weights, "region").select("region", *[f"_d{s}" for s in SPANS], *[f"{target}_ewma_{s}" for s in SPANS])
    last = tail.withColumn("_r", back).filter(F.col("_r") <= need)
    series = last.groupBy("region").agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.col(target).alias("y")))).alias("_h"))
    rows = future.join(series, "region").join(state, "region")

    when = "timestamp_ntz" if kind.typeName() == "timestamp_ntz" else "timestamp"
    ahead = [c for c in future.columns if c not in ("region", "timestamp")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for pdf in it:  # rows come by region, so all but the last one are complete
            held = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
            last = held["region"].iloc[-1]
            whole = held[held["region"] != last]
            if whole["region"].nunique() >= TOGETHER:
                yield _stepped(whole, step, ahead, target, need)
                held = held[held["region"] == last]
        if len(held):
            yield _stepped(held, step, ahead, target, need)

    dealt = rows.repartition("region").sortWithinPartitions("region", "timestamp")
    return dealt.mapInPandas(run, f"region string, timestamp {when}, y_pred double")


#: Series that a task steps at once.
TOGETHER = 512


def _lag_features(y: np.ndarray, target: str) -> dict[str, np.ndarray]:
    """Lag features of the next step, for rows of the latest values (NaN: unknown), the latest last."""
    back = lambda k: y[:, -k] if k <= y.shape[1] else np.full(len(y), np.nan)
    out = {f"{target}_lag_{k}": back(k) for k in LAGS}
    for k in WINDOWS:
        part = y[:, -k:]
        known = np.isfinite(part)
        n = known.sum(axis=1)
        some = lambda v, least=1: np.where(n >= least, v, np.nan)  # noqa: B023, E731
        mean = some(np.where(known, part, 0.0).sum(axis=1) / np.maximum(n, 1))
        off = np.where(known, part - mean[:, None], 0.0)
        out[f"{target}_rolling_mean_{k}"] = mean
        out[f"{target}_rolling_std_{k}"] = some(np.sqrt((off * off).sum(axis=1) / np.maximum(n - 1, 1)), 2)
        out[f"{target}_rolling_min_{k}"] = some(np.where(known, part, np.inf).min(axis=1))
        out[f"{target}_rolling_max_{k}"] = some(np.where(known, part, -np.inf).max(axis=1))
    day = y[:, -24:]
    known = np.isfinite(day)
    span = np.where(known, day, -np.inf).max(axis=1) - np.where(known, day, np.inf).min(axis=1)
    return out | {f"{target}_diff_1": back(1) - back(2), f"{target}_diff_24": back(1) - back(25), f"{target}_range_24": np.where(known.any(axis=1), span, np.nan)}


def _stepped(pdf: pd.DataFrame, step, ahead: list[str], target: str, need: int) -> pd.DataFrame:
    """Forecasts of whole series, one step of all of them after the other."""
    groups = [g for _, g in pdf.groupby("region", sort=False)]
    first = [g.iloc[0] for g in groups]
    y = np.full((len(groups), need), np.nan)
    for i, one in enumerate(first):
        past = [h["y"] for h in one["_h"]][-need:]
        y[i, need - len(past) :] = [np.nan if v is None else v for v in past]
    den = {s: np.array([one[f"_d{s}"] for one in first], float) for s in SPANS}
    num = {s: np.array([one[f"{target}_ewma_{s}"] for one in first], float) * den[s] for s in SPANS}
    columns = {c: [g[c].to_numpy() for g in groups] for c in ahead}
    lengths = np.array([len(g) for g in groups])
    out = [np.full(n, np.nan) for n in lengths]
    for t in range(lengths.max()):
        live = np.flatnonzero(lengths > t)
        feats = {k: v[live] for k, v in _lag_features(y, target).items()}
        feats |= {f"{target}_ewma_{s}": (num[s] / den[s])[live] for s in SPANS}
        feats |= {c: np.array([columns[c][i][t] for i in live]) for c in ahead}
        if hasattr(step, "predict"):
            value = np.asarray(step.predict(np.column_stack([np.asarray(feats[f], float) for f in step.features])), float)
        else:
            base = [{"region": groups[i]["region"].iloc[0], "timestamp": groups[i]["timestamp"].iloc[t]} for i in live]
            value = np.array([float(step(b | {k: v[j] for k, v in feats.items()})) for j, b in enumerate(base)])
        for i, v in zip(live, value, strict=True):
            out[i][t] = v
        y[live] = np.column_stack([y[live, 1:], value])
        for s in SPANS:
            q = 1 - 2 / (s + 1)
            known = np.isfinite(value)
            num[s][live] = num[s][live] * q + np.where(known, value, 0.0)
            den[s][live] = den[s][live] * q + known
    return pd.DataFrame({"region": pdf["region"].to_numpy(), "timestamp": pdf["timestamp"].to_numpy(), "y_pred": np.concatenate(out)})


def fallback_prediction(df: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """y_pred and model_name of the first valid of several prediction columns: (column, name)."""
    picks = [F.when(valid_prediction(F.col(c)), F.struct(F.col(c).alias("y_pred"), F.lit(n).alias("model_name"))) for c, n in order]
    return df.withColumn("_p", F.coalesce(*picks)).select("*", "_p.y_pred", "_p.model_name").drop("_p")


def linear_contributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float]) -> DataFrame:
    """All columns and ``contributions``: array of (feature, value, contribution) of a linear model."""
    parts = [
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), ((F.col(f) - F.lit(means[f])) * F.lit(float(b))).alias("contribution"))
        for f, b in coefficients.items()
    ]
    return df.withColumn("contributions", F.array(*parts))


def explain(df: DataFrame, coefficients: dict[str, float], means: dict[str, float], top: int = 10, keys: tuple = ("region", "timestamp")) -> DataFrame:
    """keys, rank, feature, value, contribution, importance (share of the absolute sum) of the top features."""
    rows = linear_contributions(df, coefficients, means)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + F.abs(c["contribution"]))
    ranked = F.slice(
        F.reverse(F.array_sort(F.transform("contributions", lambda c: F.struct(F.abs(c["contribution"]).alias("size"), c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution"))))),
        1, max(1, min(top, 50)),
    )
    out = rows.select(*keys, total.alias("_t"), F.posexplode(ranked).alias("_i", "_c"))
    share = F.when(F.col("_t") > 0, F.col("_c.size") / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(F.lit(1.0 / max(len(coefficients), 1)))
    return out.select(*keys, (F.col("_i") + 1).alias("rank"), "_c.feature", "_c.value", "_c.contribution", share.alias("importance"))
