import datetime as dt
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import drift, explore, ingest, leakage, metrics, monitor, quality, series, splits
from gridloom.plans import features, modeling, runs
from gridloom.sources import tables

T0 = dt.datetime(2024, 1, 1)


def hourly(spark, values, region="Lisboa"):
    data = [(T0 + dt.timedelta(hours=i), region, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "timestamp timestamp, region string, consumption_mw double")


def test_ingest_end_to_end(spark):
    rows = [(T0 + dt.timedelta(hours=h), c, 1500.0) for h in range(3) for c in ("4000", "4500", "1100", "1500")]
    got = ingest.regional_hourly(spark.createDataFrame(rows, "datahora timestamp, codigo_postal string, consumo double"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("Lisboa", 3.0)] * 3 + [("Norte", 3.0)] * 3


def test_anomalous_readings_are_dropped(spark):
    rows = [(T0, "4000", v) for v in (-50.0, 0.0, 1500.0, 100000.0, 99000.0, 5000000.0)] + [(T0, "9000", 1.0)]
    df = spark.createDataFrame(rows, "datahora timestamp, codigo_postal string, consumo double")
    assert ingest.regional_hourly(df).first()["consumption_mw"] == pytest.approx(100.5)
    from gridloom.functions.regions import map_region

    assert tuple(ingest.ingest_quality(map_region(df)).first()) == (7, 1, 1, 3)


def test_quarters_need_four_values(spark):
    rows = [(T0 + dt.timedelta(minutes=15 * i), 1000.0) for i in range(7)]
    got = ingest.hourly_from_quarters(spark.createDataFrame(rows, "datahora timestamp, total double"), columns=("total",))
    assert [tuple(r) for r in got.collect()] == [(T0, 4.0)]


def test_missing_hours(spark):
    df = hourly(spark, range(5)).filter(F.hour("timestamp") != 2)
    assert [r["timestamp"] for r in ingest.missing_hours(df, True).collect()] == [T0 + dt.timedelta(hours=2)]
    assert ingest.regularize(df).count() == 5


def test_lags_and_rolling_match_pandas_and_regions_never_mix(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(100, 10, 120), np.full(120, 9999.0)
    df = hourly(spark, x).unionByName(hourly(spark, y, "Norte"))
    got = series.rolling_features(series.lag_features(df)).filter("region = 'Lisboa'").orderBy("timestamp").toPandas()
    s = pd.Series(x)
    for k in series.LAGS:
        np.testing.assert_allclose(got[f"consumption_mw_lag_{k}"], s.shift(k))
    for k in series.WINDOWS:
        roll = s.shift(1).rolling(k, min_periods=1)
        for n, want in (("mean", roll.mean()), ("std", roll.std()), ("min", roll.min()), ("max", roll.max())):
            np.testing.assert_allclose(got[f"consumption_mw_rolling_{n}_{k}"].astype(float), want, atol=1e-9)


def test_chunked_equals_plain(spark):
    df = hourly(spark, np.random.default_rng(2).normal(0, 1, 400))
    a = series.rolling_features(df).orderBy("timestamp").toPandas()
    b = series.chunked(df, lambda w: series.rolling_columns(w=w), 48, 64).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns])


@pytest.mark.parametrize("holes", [False, True])
def test_ewma_matches_pandas(spark, holes):
    x = np.random.default_rng(3).normal(100, 20, 700)
    vals = [None if holes and i % 7 == 3 else v for i, v in enumerate(x)]
    got = series.ewma_features(hourly(spark, vals), block=64).orderBy("timestamp").toPandas()
    s = pd.Series([np.nan if v is None else v for v in vals]).shift(1)
    for k in series.SPANS:
        np.testing.assert_allclose(got[f"consumption_mw_ewma_{k}"].astype(float), s.ewm(span=k, min_periods=1).mean(), rtol=1e-9)


def test_row_index_and_split(spark):
    df = hourly(spark, range(500)).unionByName(hourly(spark, range(500), "Norte"))
    n = splits.temporal_split(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in n} == {"train": 700, "val": 150, "test": 150}
    assert [r["_i"] for r in splits.row_index(df, "_i", key=None).orderBy("timestamp", "region").collect()] == list(range(1000))


def test_fold_bounds():
    assert splits.fold_bounds(12, 3) == [(0, 0, 3, 6), (1, 0, 6, 9), (2, 0, 9, 12)]
    assert splits.fold_bounds(10, 2, "walk-forward") == [(0, 0, 6, 8), (1, 2, 8, 10)]
    assert splits.fold_bounds(3, 5, "walk-forward") == [(0, 0, 1, 2), (1, 1, 2, 3)]
    with pytest.raises(ValueError):
        splits.fold_bounds(10, 2, "other")


def test_regression_metrics_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (None, 1.0), (4.0, 4.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert (r["n"], r["mae"], r["mape"]) == (3, pytest.approx(2 / 3), pytest.approx(25.0))
    zero = metrics.regression_metrics(spark.createDataFrame([(0.0, 1.0)], "y double, p double"), "y", "p").first()
    assert zero["mape"] is None and zero["r2"] is None and zero["nrmse"] is None
    with pytest.raises(ValueError):
        metrics.require_rows(metrics.regression_metrics(df.filter("y > 9"), "y", "p")).count()


def test_day_types_have_all_rows(spark):
    df = hourly(spark, [1.0]).withColumn("y_pred", F.lit(2.0))
    got = {r["category"]: (r["n_hours"], r["direction"]) for r in metrics.day_type_report(df).collect()}
    assert got["fixed_holiday"] == (1, "over-predicts") and got["sunday"] == (0, "n/a") and len(got) == 6


def test_anomalies_warm_up_and_flag(spark):
    vals = [5.0 if i % 2 else -5.0 for i in range(50)] + [500.0]
    df = hourly(spark, vals).select("timestamp", "region", F.col("consumption_mw").alias("actual"), F.lit(0.0).alias("predicted"))
    got = [r["is_anomaly"] for r in monitor.residual_anomalies(df).orderBy("timestamp").collect()]
    assert got[-1] and not any(got[:-1])


def test_coverage_window_evicts(spark):
    hits = [0.0] * 5 + [1.0] * 5
    df = hourly(spark, hits).select("timestamp", "region", F.col("consumption_mw").alias("actual"), F.lit(0.5).alias("lower"), F.lit(1.5).alias("upper"))
    assert monitor.rolling_coverage(df, 10).orderBy(F.col("timestamp").desc()).first()["coverage"] == 0.5
    assert monitor.rolling_coverage(df, 5).orderBy(F.col("timestamp").desc()).first()["coverage"] == 1.0


def test_sustained_alerts(spark):
    df = hourly(spark, [0, 1, 1, 1, 0, 1, 1, 0]).withColumn("condition", F.col("consumption_mw") > 0)
    got = monitor.sustained_alerts(df, "2 hours", ["region"]).collect()
    assert [(r["started"].hour, r["n_samples"], r["fired"].hour) for r in got] == [(1, 3, 3)]


def test_drift(spark):
    rng = np.random.default_rng(4)
    old = spark.createDataFrame(pd.DataFrame({"t": rng.normal(18, 5, 2000), "c": np.ones(2000)}))
    new = spark.createDataFrame(pd.DataFrame({"t": rng.normal(48, 5, 500)}))
    got = {r["feature"]: r for r in drift.psi_report(new, ["t", "c"], reference=old).collect()}
    assert got["t"]["severity"] == "high" and got["c"]["missing"] and got["c"]["psi"] is None
    same = drift.psi_report(old, ["t", "c"], reference=old).collect()
    assert all(r["psi"] < 1e-9 and not r["drift_detected"] for r in same)
    stats = drift.feature_stats(old, ["t", "c"])
    assert {r["feature"]: r["severity"] for r in drift.psi_report(old, ["t"], stats=stats.filter("feature = 't'")).collect()} == {"t": "none"}
    z = {r["feature"]: r for r in drift.zscore_drift(new.withColumn("c", F.lit(2.0)), ["t", "c"], stats).collect()}
    assert z["t"]["drift_level"] == "alert" and z["c"]["z_score"] is None and z["c"]["note"]


def test_quality_rules(spark):
    df = spark.createDataFrame([("Lisboa", 150.0, -1.0), ("Mars", 50.0, 1.0)], "region string, humidity double, wind_speed double").withColumn("timestamp", F.lit(T0))
    assert {r["rule"]: r["n_bad"] for r in quality.weather_violations(df).collect()} == {"humidity": 1, "wind_speed": 1}
    with pytest.raises(ValueError, match="humidity"):
        quality.assert_weather(df)
    good, bad = quality.validate_records(df)
    assert good.count() == 0 and {tuple(r["reasons"]) for r in bad.collect()} == {("humidity", "wind_speed"), ("region",)}
    inf = spark.createDataFrame([(float("inf"), 150.0)], "x double, humidity double")
    assert tuple(quality.validate_features(inf).first()) == (None, 100.0)


def test_fingerprint_ignores_order(spark):
    df = hourly(spark, range(50))
    a, b = quality.fingerprint(df).first(), quality.fingerprint(df.repartition(7).orderBy(F.desc("timestamp"))).first()
    assert a == b and a != quality.fingerprint(df.limit(49)).first()


def test_pacf_of_first_order_series(spark):
    x = [0.0]
    rng = np.random.default_rng(5)
    for _ in range(1500):
        x.append(0.7 * x[-1] + rng.normal())
    got = {r["lag"]: r["r"] for r in explore.pacf(explore.acf(hourly(spark, x), 5)).collect()}
    assert got[1] == pytest.approx(0.7, abs=0.06) and abs(got[3]) < 0.1


def test_donor_swap_is_scaled(spark):
    df = hourly(spark, [10.0] * 30).unionByName(hourly(spark, [20.0] * 30, "Norte"))
    rows = series.lag_features(df, [1]).na.drop()
    swapped = leakage.donor_swap(rows, rows, ["consumption_mw_lag_1"])
    m = leakage.leakage_matrix(swapped, lambda d: d.withColumn("prediction", F.col("consumption_mw_lag_1")))
    assert m.count() == 4 and m.agg(F.max("mape")).first()[0] == pytest.approx(0.0)


def test_full_features(spark):
    n = 200
    df = hourly(spark, np.random.default_rng(6).normal(1000, 50, n)).withColumns({
        "temperature": F.when(F.hour("timestamp") == 5, 0.0).otherwise(F.hour("timestamp") + 1.0), "humidity": F.lit(60.0), "wind_speed": F.lit(5.0),
        "precipitation": F.lit(0.0), "cloud_cover": F.lit(30.0), "pressure": F.lit(1015.0),
    })
    got = features.features_full(df, advanced=True)
    # 48 rows of warm-up; a change from 0 keeps its row without the value
    assert got.count() == n - 48
    assert got.filter("temp_momentum IS NULL").count() > 0
    assert {"consumption_mw_ewma_48", "days_in_holiday_window", "heat_index", "temperature_squared"} <= set(got.columns)
    assert features.features_no_lags(df).count() == n


def full_by_pandas(df):
    """History of the full set, recomputed by region; rows without a value are dropped, changes from 0 stay."""
    out = []
    for _, g in df.toPandas().sort_values("timestamp").groupby("region"):
        g, y = g.reset_index(drop=True), g["consumption_mw"].reset_index(drop=True)
        past = y.shift(1)
        for k in (1, 2, 3, 6, 12, 24, 48):
            g[f"consumption_mw_lag_{k}"] = y.shift(k)
        for k in (3, 6, 12, 24, 48):
            for f in ("mean", "std", "min", "max"):
                g[f"consumption_mw_rolling_{f}_{k}"] = getattr(past.rolling(k, min_periods=1), f)()
        for k in (6, 12, 24, 48):
            g[f"consumption_mw_ewma_{k}"] = past.ewm(span=k, min_periods=1).mean()
        g["consumption_mw_diff_1"], g["consumption_mw_diff_24"] = past - y.shift(2), past - y.shift(25)
        g["consumption_mw_range_24"] = past.rolling(24, min_periods=1).max() - past.rolling(24, min_periods=1).min()
        t = g["temperature"]
        g["temp_diff_1h"], g["temp_diff2_1h"] = t.diff(), t.diff().diff()
        g["temp_deviation_24h"] = t - t.rolling(24, min_periods=1).mean()
        for c, short in (("temperature", "temp"), ("wind_speed", "wind")):
            g[f"{short}_volatility_12h"] = g[c].rolling(12, min_periods=1).std()
            g[f"{short}_momentum"] = g[c].ffill().pct_change(3, fill_method=None) * 100
        out.append(g.dropna().replace([np.inf, -np.inf], np.nan))
    return pd.concat(out)


@pytest.mark.parametrize("chunk", [48, 100_000, None])
def test_full_features_equal_pandas(spark, chunk):
    rng, parts = np.random.default_rng(8), []
    for region, n in (("Lisboa", 170), ("Norte", 90), ("Centro", 20)):
        h = F.hour("timestamp")
        part = hourly(spark, rng.normal(1000, 50, n), region)
        gap = F.dayofmonth("timestamp") == F.dayofmonth(F.lit(T0 + dt.timedelta(days=3)))
        parts.append(part.withColumns({
            "temperature": F.when(gap & (h > 2), None).when(h % 5 == 0, 0.0).otherwise(h + 1.0), "humidity": F.lit(60.0), "wind_speed": F.when(h == 7, 0.0).otherwise(h * 2.0),
            "precipitation": F.lit(0.0), "cloud_cover": F.lit(30.0), "pressure": F.lit(1015.0),
        }))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    want = full_by_pandas(df).sort_values(["region", "timestamp"])
    got = features.features_full(df, advanced=True, chunk=chunk).toPandas().sort_values(["region", "timestamp"])
    assert len(want) > 100 and "_i" not in got.columns
    assert got[["region", "timestamp"]].values.tolist() == want[["region", "timestamp"]].values.tolist()
    for c in want.columns.difference(["region", "timestamp"]):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-7, err_msg=c)


def test_forward_fill_over_blocks(spark):
    vals = [None, 1.0, None, None, None, None, None, 2.0, None, None]
    got = series.fill_forward(hourly(spark, vals), {"consumption_mw": "f"}, block=2).orderBy("timestamp").collect()
    assert [r["f"] for r in got] == [None, 1, 1, 1, 1, 1, 1, 2, 2, 2]


def test_sequential_feeds_predictions_back(spark):
    hist = hourly(spark, range(1, 61))
    fut = spark.createDataFrame([("Lisboa", T0 + dt.timedelta(hours=60 + i)) for i in range(3)], "region string, timestamp timestamp")
    got = modeling.predict_sequential(hist, fut, lambda f: f["consumption_mw_lag_1"] + 1).orderBy("timestamp").collect()
    assert [r["y_pred"] for r in got] == [61.0, 62.0, 63.0]
    full = series.ewma_features(hist.unionByName(hourly(spark, [61.0, 0.0]).withColumn("timestamp", F.col("timestamp") + F.expr("interval 60 hours"))))
    want = full.filter(F.col("timestamp") == F.lit(T0 + dt.timedelta(hours=61))).first()["consumption_mw_ewma_24"]
    ew = modeling.predict_sequential(hist, fut, lambda f: 61.0 if f["consumption_mw_lag_1"] == 60 else f["consumption_mw_ewma_24"]).orderBy("timestamp").collect()
    assert ew[1]["y_pred"] == pytest.approx(want)


def test_correlation_filter_and_per_region(spark):
    df = hourly(spark, np.random.default_rng(7).normal(0, 1, 100)).withColumns({"a": F.rand(1), "b": F.rand(2)}).withColumn("a2", F.col("a") * 2)
    assert modeling.correlation_filter(df, ["a", "a2", "b"]) == ["a", "b"]
    y = df.withColumn("consumption_mw", F.col("a") * 3 + F.col("b") * 2 + 1)
    m = modeling.train_per_region(y, ["a", "b"]).first()
    assert [m["intercept"], *m["coefficients"]] == pytest.approx([1, 3, 2], abs=1e-3)


def test_runs(spark):
    df = spark.createDataFrame([("a", "x", "completed", "2024-01-01", {"rmse": 2.0}), ("b", "x", "completed", "2024-01-02", {"rmse": 1.0}), ("c", "x", "failed", "2024-01-03", {"rmse": 0.1})], "run_id string, name string, status string, started_at string, metrics map<string,double>")
    assert runs.best_run(df, "rmse").first()["run_id"] == "b"
    assert [r["run_id"] for r in runs.list_runs(df, status="completed").collect()] == ["b", "a"]


def test_feature_stats_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"feature_stats": {"t": {"mean": 1.5, "std": 2.0}}}')
    assert tables.read_feature_stats(spark, str(tmp_path / "m.json")).first()["mean"] == 1.5
    (tmp_path / "e.json").write_text("{}")
    with pytest.raises(ValueError):
        tables.read_feature_stats(spark, str(tmp_path / "e.json"))


def test_row_index_keeps_rows_without_key_or_time(spark):
    t = lambda h: T0 + dt.timedelta(hours=h)
    rows = [("a", t(1), 1.0), ("a", None, 2.0), (None, t(0), 3.0), (None, t(30), 4.0), ("a", t(0), 5.0), (None, None, 6.0)]
    df = spark.createDataFrame(rows, "region string, timestamp timestamp_ntz, consumption_mw double")
    got = {r["consumption_mw"]: r["_i"] for r in splits.row_index(df, "_i").collect()}
    assert got == {5.0: 0, 1.0: 1, 2.0: 2, 3.0: 0, 4.0: 1, 6.0: 2}
    parts = splits.temporal_split(df, 0.5, 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 3, "val": 1, "test": 2}
    ewma = {r["consumption_mw"]: r["consumption_mw_ewma_6"] for r in series.ewma_features(df).collect()}
    assert len(ewma) == 6 and ewma[1.0] == 5.0 and ewma[4.0] == 3.0 and ewma[3.0] is None


def test_ewma_of_long_and_short_spans(spark):
    vals = np.random.default_rng(9).normal(100, 20, 12_000)
    vals[:3] = [np.nan, 5000.0, np.nan]
    vals[7000:9000] = np.nan
    got = series.ewma_features(hourly(spark, [None if np.isnan(v) else float(v) for v in vals]), [2, 8760]).orderBy("timestamp").toPandas()
    want = pd.Series(vals).shift(1)
    for k in (2, 8760):
        np.testing.assert_allclose(got[f"consumption_mw_ewma_{k}"].astype(float), want.ewm(span=k, min_periods=1).mean(), rtol=1e-9)
    with pytest.raises(ValueError):
        series.ewma_features(hourly(spark, [1.0]), [1])


def test_sequential_rejects_and_continues_over_gaps(spark):
    vals = [float(i % 7) for i in range(60)]
    vals[-5] = vals[20] = None
    hist = hourly(spark, vals)
    fut = lambda n: hourly(spark, [0.0] * n).select("region", (F.col("timestamp") + F.expr("interval 60 hours")).alias("timestamp"))
    with pytest.raises(ValueError):
        modeling.predict_sequential(hist, fut(169), lambda f: 0.0)
    with pytest.raises(ValueError):
        modeling.predict_sequential(hist.limit(20), fut(2), lambda f: 0.0)
    got = modeling.predict_sequential(hist, fut(3), lambda f: f["consumption_mw_ewma_24"] + 1).orderBy("timestamp").toPandas()["y_pred"].tolist()
    seen = [np.nan if v is None else v for v in vals]
    for y in got:
        assert y == pytest.approx(pd.Series(seen).ewm(span=24).mean().iloc[-1] + 1)
        seen.append(y)


def test_permutation_importance_finds_the_feature_that_counts(spark):
    rng = np.random.default_rng(3)
    rows = [("a", T0 + dt.timedelta(hours=i), float(x), float(z), float(3 * x + 0.01 * z)) for i, (x, z) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "region string, timestamp timestamp_ntz, x double, z double, consumption_mw double")
    fitted = modeling.fit_regressor("linear", df, None, ["x", "z"])
    got = {r["feature"]: (r["importance"], r["std"]) for r in modeling.permutation_importance(fitted, df, 5).collect()}
    # a permuted column adds twice its variance times the squared coefficient, in expectation
    assert got["x"][0] == pytest.approx(2 * 9 * np.var([r[2] for r in rows]), rel=0.15) and got["z"][0] < 0.01 < got["x"][1]


def test_metrics_properties(spark):
    rng = np.random.default_rng(4)
    for scale in (0.1, 10.0, 1e6):
        y, p = rng.normal(size=(2, 50)) * scale
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
        m = metrics.regression_metrics(df, "y", "p").first()
        assert m["rmse"] >= m["mae"] >= 0 and m["r2"] <= 1
        assert m["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2))) and m["mae"] == pytest.approx(np.mean(np.abs(y - p)))
