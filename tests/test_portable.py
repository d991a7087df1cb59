"""Portable models against Spark ML and brute force; sums of products against numpy; fits side by side."""

import itertools
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import explore, gram
from gridloom.plans import modeling, portable

FEATURES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    cols = [(F.pmod(F.hash("id", F.lit(i)), F.lit(1000)) / 100).alias(f"f{i}") for i in range(6)]
    df = spark.range(3000).select("id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp"), F.lit("r").alias("region"), *cols)
    y = F.col("f0") * F.when(F.col("f1") > 5, 3).otherwise(-1) + F.sin("f2") * 4 + F.col("f3") * F.col("f4") / 5
    return df.withColumn("consumption_mw", y).cache()


def known_value(tree, x, known, at=0):
    if tree.left[at] < 0:
        return tree.value[at]
    f, left, right = tree.feature[at], tree.left[at], tree.right[at]
    if f in known:
        return known_value(tree, x, known, left if x[f] <= tree.threshold[at] else right)
    return sum(tree.cover[c] * known_value(tree, x, known, c) for c in (left, right)) / tree.cover[at]


def brute(model, x):
    n = len(x)
    game = {s: sum(w * known_value(t, x, s) for t, w in zip(model.trees, model.weights)) for k in range(n + 1) for s in map(frozenset, itertools.combinations(range(n), k))}
    weight = lambda s: math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
    return [sum(weight(s) * (game[s | {j}] - game[s]) for s in game if j not in s) for j in range(n)]


@pytest.mark.parametrize("kind, params", [("gbt", {"maxIter": 5}), ("forest", {"numTrees": 4, "maxDepth": 9}), ("linear", {})])
def test_equals_the_fitted_model(spark, rows, kind, params, monkeypatch):
    fitted = modeling.fit_regressor(kind, rows, None, FEATURES, params)
    model = portable.portable(fitted, rows)
    both = portable.score(fitted.predict(rows).withColumnRenamed("prediction", "spark"), model, FEATURES)
    assert both.agg(F.max(F.abs(F.col("spark") - F.col("prediction")))).first()[0] < 1e-9
    x = np.array(rows.select(*FEATURES).limit(40).collect(), float)
    phi = model.shapley(x)
    assert np.allclose(phi.sum(axis=1) + model.base(), model.predict(x))
    if kind != "linear":
        assert np.allclose(phi[:4], [brute(model, r) for r in x[:4]])
        monkeypatch.setattr(portable, "TABLE", 2)
        assert np.allclose(model.shapley(x), phi)
    got = portable.explain_model(rows.limit(20), model, FEATURES, 6)
    per = got.groupBy("timestamp").agg(F.sum("contribution").alias("s"), F.sum("importance").alias("i"), F.max("rank").alias("r")).collect()
    assert len(per) == 20 and all(abs(p["i"] - 1) < 1e-9 and p["r"] == 6 for p in per)


def test_fallbacks_and_missing_values(spark, rows):
    uniform = portable.explain_model(rows.limit(1), None, FEATURES, 50).collect()
    assert len(uniform) == 6 and {r["method"] for r in uniform} == {"uniform"} and abs(uniform[0]["importance"] - 1 / 6) < 1e-12
    model = portable.Portable(["f0"], 1.0, np.array([2.0]), np.array([0.0]))
    gaps = spark.createDataFrame([(1.0, "a", 1), (None, "a", 2), (float("nan"), "b", 3)], "f0 double, region string, timestamp int")
    assert [r["prediction"] for r in portable.score(gaps, model, ["f0"]).orderBy("timestamp").collect()] == [3.0, None, None]
    assert portable.contributions(gaps, model).filter("contributions IS NULL").count() == 2
    assert portable.score(gaps.limit(0), model, ["f0"]).count() == 0


def test_sequential_forecasts_by_a_fitted_model(spark, rows):
    hourly = spark.range(600).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 300).cast("int"))).alias("timestamp"), F.when(F.col("id") < 300, "a").otherwise("b").alias("region"),
        (F.sin(F.col("id") / 4) * 10 + 50 + F.col("id") % 7).alias("consumption_mw"),
    )
    from gridloom.operators.series import lag_features

    features = ["consumption_mw_lag_1", "consumption_mw_lag_24", "k"]
    past = lag_features(hourly.withColumn("k", F.hour("timestamp"))).na.drop()
    fitted = modeling.fit_regressor("gbt", past, None, features, {"maxIter": 10})
    model = portable.portable(fitted)
    ahead = spark.range(336).select(
        (F.lit("2024-01-13 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 168).cast("int"))).alias("timestamp"), F.when(F.col("id") < 168, "a").otherwise("b").alias("region")
    ).withColumn("k", F.hour("timestamp"))
    got = {(r["region"], r["timestamp"]): r["y_pred"] for r in modeling.predict_sequential(hourly, ahead, model).collect()}
    assert len(got) == 336
    y = {r: [x["consumption_mw"] for x in hourly.filter(F.col("region") == r).orderBy("timestamp").collect()] for r in "ab"}
    for (region, when), value in sorted(got.items()):
        want = model.predict(np.array([[y[region][-1], y[region][-24], when.hour]]))[0]
        assert value == pytest.approx(want)
        y[region].append(want)
    # the first step is the fitted model's own
    one = spark.createDataFrame([(y["a"][299], y["a"][276], 12.0)], ["consumption_mw_lag_1", "consumption_mw_lag_24", "k"])
    assert fitted.predict(one).first()["prediction"] == pytest.approx(y["a"][300])


def test_sums_of_products(spark, rows):
    shifted = rows.select(*[(F.col(f) + 1e7).alias(f) for f in FEATURES], F.when(F.col("id") % 4 > 0, F.col("id") % 3).cast("string").alias("g"), F.lit(2.0).alias("same"))
    x = np.array(shifted.select(*FEATURES).collect(), float)
    got = {(r["a"], r["b"]): r["r"] for r in explore.correlations(shifted, [*FEATURES, "same"]).collect()}
    want = np.corrcoef(x.T)
    assert all(abs(got[FEATURES[i], FEATURES[j]] - want[i, j]) < 1e-9 for i in range(6) for j in range(i + 1, 6)) and got["f0", "same"] is None
    by = {r["group"]: r["n"] for r in gram.gram(shifted, FEATURES, by="g").collect()}
    assert by == {r["g"]: r["count"] for r in shifted.groupBy("g").count().collect()} and None in by
    wide = rows.select(*[(F.hash("id", F.lit(i)) / 1e6).alias(f"w{i}") for i in range(78)])
    start = time.time()
    assert explore.correlations(wide, wide.columns).count() == 3003
    assert time.time() - start < 60
    assert explore.correlations(rows.limit(0), ["f0", "f1"]).first()["r"] is None


def test_backtest_by_running_totals(spark, rows):
    errors, models = modeling.backtest_linear(rows, FEATURES[:3], 2)
    for m in models.collect():
        old = rows.filter(F.date_format("timestamp", "yyyy-MM") < m["month"])
        x = np.array(old.select(*FEATURES[:3], "consumption_mw").collect(), float)
        w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x[:, :3]]), x[:, 3], rcond=None)[0]
        assert m["n_train"] == len(x) and np.allclose([m["intercept"], *m["coefficients"]], w, atol=1e-5)
    wide = modeling.backtest_wide(errors, ["r"]).orderBy("month").collect()
    assert len(wide) == 3 and all(r["rmse"] == pytest.approx(r["r_rmse"]) and r["n_test"] > 0 for r in wide)


def test_side_by_side(spark):
    seen, lock = [], threading.Lock()

    def job(i):
        with lock:
            seen.append(i)
        return spark.range(i + 1).count()

    assert modeling.side_by_side(spark, [lambda i=i: job(i) for i in range(7)]) == list(range(1, 8))
    slow = spark.range(0, 10**6, 1, 4).mapInPandas(lambda it: (time.sleep(20) or p for p in it), "id long")

    def fails():
        time.sleep(1)
        raise KeyError("broken")

    start = time.time()
    with pytest.raises(KeyError):
        modeling.side_by_side(spark, [slow.count, fails])
    assert time.time() - start < 15


def test_search(spark, rows):
    rng = random.Random(1)
    df = rows.limit(400).withColumn("noise", F.rand(rng.randint(0, 9)))
    best, tried = modeling.tune(df, "linear", FEATURES[:2], k=2, search="grid")
    assert tried.count() == 3 and best["regParam"] in modeling.SPACES["linear"]["regParam"]
    assert modeling.tune(df, "forest", FEATURES[:2], 2, 2, space={"numTrees": [2, 3], "maxDepth": [2]})[1].count() == 2


def test_points_with_fewer_trees_share_fits(spark, rows, monkeypatch):
    df, fitted = rows.filter("id < 400"), []
    fit = modeling.fit_regressor
    monkeypatch.setattr(modeling, "fit_regressor", lambda *a, **b: fitted.append(1) or fit(*a, **b))
    space = {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.3]}
    best, tried = modeling.tune(df, "gbt", FEATURES[:2], k=2, space=space, search="grid")
    assert len(fitted) == 2 * 2
    folds = modeling.cv_folds(df, 2).cache()
    tries = tried.orderBy("trial").collect()
    assert [r["trial"] for r in tries] == [0, 1, 2, 3] and str(best) == min(tries, key=lambda r: r["rmse"])["params"]
    for r in tries:
        own = [modeling._fold(folds, "gbt", f, FEATURES[:2], eval(r["params"]))[2] for f in range(2)]
        assert abs(r["rmse"] - sum(own) / 2) < 1e-9 * r["rmse"]
