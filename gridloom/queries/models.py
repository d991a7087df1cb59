"""Queries of model jobs and run records. Models vary with floating-point order, so only what is exact
has SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.calendars import temporal_features
from gridloom.operators import metrics
from gridloom.operators import series as s
from gridloom.operators.splits import temporal_split
from gridloom.plans import modeling, portable, runs
from gridloom.queries import base
from gridloom.queries.base import query
from gridloom.queries.base import scratch as _scratch
from gridloom.sources import tables

FEATURES = ["hour", "day_of_week", "consumption_mw_lag_1", "consumption_mw_lag_2", "consumption_mw_lag_24"]


def _rows(spark, d):
    return s.lag_features(temporal_features(base.event_hourly(spark, d)), [1, 2, 24]).na.drop()


def _parts(spark, d):
    rows = temporal_split(_rows(spark, d))
    return [rows.filter(F.col("split") == p).drop("split") for p in ("train", "val", "test")]


@query("m1_m2_fit")
def m2(spark, d):
    train, val, test = _parts(spark, d)
    got = modeling.fit_regressor("gbt", train, val, FEATURES)
    return metrics.regression_metrics(got.predict(test), "consumption_mw", "prediction")


@query("m3_train_and_select")
def m3(spark, d):
    train, val, _ = _parts(spark, d)
    return modeling.train_and_select(train, val, FEATURES)[1]


@query("m4_time_series_cv")
def m4(spark, d):
    return modeling.time_series_cv(_rows(spark, d), FEATURES)


@query("m5_tune")
def m5(spark, d):
    return modeling.tune(_rows(spark, d), "gbt", FEATURES)[1]


@query("m5_tune_grid")
def m5g(spark, d):
    return modeling.tune(_rows(spark, d), "linear", FEATURES, search="grid")[1]


_BASE = (
    "SELECT * FROM (SELECT timestamp, region, consumption_mw AS y, hour(timestamp)::DOUBLE AS hour, (isodow(timestamp) - 1)::DOUBLE AS day_of_week, lag(consumption_mw, 1) OVER w AS consumption_mw_lag_1,"
    " lag(consumption_mw, 2) OVER w AS consumption_mw_lag_2, lag(consumption_mw, 24) OVER w AS consumption_mw_lag_24 FROM ehourly WINDOW w AS (PARTITION BY region ORDER BY timestamp)) WHERE consumption_mw_lag_24 IS NOT NULL"
)
_SIX = [*FEATURES, "twin"]
_R = ", ".join(f"{{k: '{a}|{b}', v: corr({a}, {b})}}" for i, a in enumerate(_SIX) for b in _SIX[i + 1 :])
_M6 = (
    f"WITH RECURSIVE x AS (SELECT *, consumption_mw_lag_1 * 2 AS twin FROM ({_BASE})), r AS (SELECT map_from_entries([{_R}]) AS m, count(*) AS n FROM x),"
    f" g AS (SELECT 0 AS i, []::VARCHAR[] AS kept UNION ALL SELECT i + 1, CASE WHEN len(list_filter(kept, lambda k: abs(m[k || '|' || f]) > 0.95)) = 0 THEN list_append(kept, f) ELSE kept END"
    f" FROM (SELECT i, kept, m, ({_SIX!r})[i + 1] AS f FROM g, r WHERE i < {len(_SIX)})) SELECT unnest(kept) AS feature, n FROM g, r WHERE i = {len(_SIX)}"
)


@query("m6_correlation_filter", "ehourly", _M6, "", "n")
def m6(spark, d):
    rows = _rows(spark, d).withColumn("twin", F.col("consumption_mw_lag_1") * 2)
    kept = modeling.correlation_filter(rows, [*FEATURES, "twin"])
    return rows.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(k) for k in kept])).alias("feature"), "n")


@query("m7_permutation_importance")
def m7(spark, d):
    train, val, _ = _parts(spark, d)
    return modeling.permutation_importance(modeling.fit_regressor("linear", train, None, FEATURES), val)


@query("m8_select_features")
def m8(spark, d):
    train, val, _ = _parts(spark, d)
    return modeling.select_features(train, val, FEATURES)[1]


@query("m9_train_variant")
def m9(spark, d):
    return modeling.train_variants(base.series_weather(spark, d))[1]


@query("m10_train_per_region")
def m10(spark, d):
    rows = _rows(spark, d)
    return metrics.overall_and_regions(modeling.predict_per_region(rows, modeling.train_per_region(rows, FEATURES), FEATURES), "consumption_mw", "prediction")


@query("m11_train_multistep")
def m11(spark, d):
    return modeling.train_multistep(_rows(spark, d), FEATURES)


@query("m12_backtest_monthly")
def m12(spark, d):
    rows = s.lag_features(temporal_features(base.daily(spark, d)), [1, 2]).na.drop()
    return modeling.backtest_monthly(rows, ["day_of_week", "consumption_mw_lag_1", "consumption_mw_lag_2"])


@query("m12_backtest_wide")
def m12w(spark, d):
    rows = s.lag_features(temporal_features(base.daily(spark, d)), [1, 2]).na.drop()
    errors = modeling.backtest_monthly(rows, ["day_of_week", "consumption_mw_lag_1", "consumption_mw_lag_2"])
    return modeling.backtest_wide(errors, [r["r_name"] for r in base.table(spark, d, "region").orderBy("r_name").collect()])


@query("m13_backtest_seasonal")
def m13(spark, d):
    rows = s.lag_features(temporal_features(base.daily(spark, d)), [1, 2]).na.drop()
    return modeling.backtest_seasonal(rows, ["day_of_week", "consumption_mw_lag_1", "consumption_mw_lag_2"])


@query("m14_seed_stability")
def m14(spark, d):
    train, _, test = _parts(spark, d)
    return modeling.seed_stability(train, test, FEATURES, list(range(10)))


@query("m15_predict_batch")
def m15(spark, d):
    train, _, test = _parts(spark, d)
    return modeling.predict_batch(modeling.fit_regressor("linear", train, None, FEATURES), test, 30.0, 20.0).select("timestamp", "region", "y_pred", "ci_lower", "ci_upper", "ci_method")


@query("m16_predict_sequential")
def m16(spark, d):
    rows = base.event_hourly(spark, d)
    cut = F.col("timestamp") < F.lit("2024-01-25").cast("timestamp_ntz")
    past = s.lag_features(temporal_features(rows.filter(cut)), [1, 2, 24]).na.drop()
    model = portable.portable(modeling.fit_regressor("gbt", past, None, FEATURES))
    future = temporal_features(rows.filter(~cut).select("region", "timestamp")).select("region", "timestamp", "hour", "day_of_week")
    return modeling.predict_sequential(rows.filter(cut), future, model)


class _Naive:
    """A model of no library: half the last value, half that of a day ago."""

    features = FEATURES

    def predict(self, x):
        return x[:, 2] / 2 + x[:, 4] / 2


_LAGS = "(SELECT *, lag(consumption_mw, 1) OVER w AS a, lag(consumption_mw, 2) OVER w AS b, lag(consumption_mw, 24) OVER w AS c FROM ehourly WINDOW w AS (PARTITION BY region ORDER BY timestamp))"


@query("m15_score_foreign", "ehourly", f"SELECT timestamp, region, a / 2 + c / 2 AS prediction FROM {_LAGS} WHERE c IS NOT NULL", "prediction")
def m15f(spark, d):
    return portable.score(_rows(spark, d), _Naive(), FEATURES).select("timestamp", "region", "prediction")


@query("m18_explain_trees")
def m18t(spark, d):
    train, _, test = _parts(spark, d)
    model = portable.portable(modeling.fit_regressor("gbt", train, None, FEATURES))
    return portable.explain_model(test, model, FEATURES, 3)


@query("m18_explain_fallback", "ehourly", f"SELECT timestamp, region, 'consumption_mw_lag_1' AS feature, a AS value, 0.75::DOUBLE AS importance, 'importance' AS method FROM {_LAGS} WHERE c IS NOT NULL", "value importance")
def m18f(spark, d):
    out = portable.explain_model(_rows(spark, d), None, FEATURES, 1, importances={"consumption_mw_lag_1": 3.0, "hour": 1.0})
    return out.select("timestamp", "region", "feature", "value", "importance", "method")


@query("m17_fallback", "predicted", "SELECT timestamp, region, coalesce(CASE WHEN y_pred > 30 THEN y_pred END, consumption_mw) AS y_pred, CASE WHEN y_pred > 30 THEN 'advanced' ELSE 'no_lags' END AS model_name FROM predicted", "y_pred")
def m17(spark, d):
    p = base.predicted(spark, d).select("timestamp", "region", F.when(F.col("y_pred") > 30, F.col("y_pred")).otherwise(F.lit(-1.0)).alias("a"), F.col("consumption_mw").alias("b"))
    return modeling.fallback_prediction(p, [("a", "advanced"), ("b", "no_lags")]).select("timestamp", "region", "y_pred", "model_name")


_EX = (
    "SELECT timestamp, region, CASE WHEN abs(a) >= abs(b) THEN 'temperature' ELSE 'humidity' END AS feature, CASE WHEN abs(a) >= abs(b) THEN a ELSE b END AS contribution, greatest(abs(a), abs(b)) / (abs(a) + abs(b)) AS importance"
    " FROM (SELECT timestamp, region, (temperature - 10.25) * 2 AS a, (humidity - 50.125) * 0.5 AS b FROM sweather)"
)


@query("m18_explain", "sweather", _EX, "contribution importance")
def m18(spark, d):
    out = modeling.explain(base.series_weather(spark, d), {"temperature": 2.0, "humidity": 0.5}, {"temperature": 10.25, "humidity": 50.125}, 1)
    return out.select("timestamp", "region", "feature", "contribution", "importance")


def _variants(spark, d):
    b = metrics.evaluate_baselines(base.event_hourly(spark, d), F.lit(True)).filter("region IS NULL")
    return b.select(F.col("baseline").alias("variant"), "rmse")


_V = "(SELECT 'persistence' AS variant, sqrt(avg(power(consumption_mw - persistence, 2))) AS rmse FROM x UNION ALL SELECT 'moving_average_24', sqrt(avg(power(consumption_mw - moving_average_24, 2))) FROM x)"


def _v_sql(body: str) -> str:
    from gridloom.queries.features import BASELINES_SQL

    return f"WITH x AS ({BASELINES_SQL}) {body}"


@query("m19_compare_variants", "ehourly", _v_sql(f"SELECT variant, rmse, (40.0 - rmse) * 100 / 40.0 AS improvement_pct FROM {_V}"), "rmse improvement_pct", "", 5)
def m19(spark, d):
    return runs.compare_variants(_variants(spark, d).filter("variant IN ('persistence', 'moving_average_24')"), 40.0)


@query("t4_select_best", "ehourly", _v_sql(f"SELECT arg_min(variant, rmse) AS model, min(rmse) AS mean FROM {_V}"), "mean", "", 5)
def t4(spark, d):
    rows = _variants(spark, d).filter("variant IN ('persistence', 'moving_average_24')")
    return runs.select_best(rows.withColumnRenamed("variant", "model"))


def _run_files(spark, d):
    """A record for each region, as an experiment would leave it."""
    path = _scratch(spark, "runs")
    r = base.event_hourly(spark, d).groupBy("region").agg(F.avg("consumption_mw").alias("m"), F.max("timestamp").alias("t"))
    doc = r.select(
        F.concat(F.lit("run-"), "region").alias("run_id"), F.lit("demand").alias("name"), F.when(F.col("region") == "view", "failed").otherwise("completed").alias("status"),
        F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), F.create_map(F.lit("rmse"), "m").alias("metrics"),
    )
    doc.repartition("run_id").write.json(path)
    return spark.read.schema("run_id string, name string, status string, started_at string, metrics map<string,double>").json(path)


_RUNS = "SELECT 'run-' || region AS run_id, avg(consumption_mw) AS value FROM ehourly WHERE region <> 'view' GROUP BY 1"


@query("t3_best_run", "ehourly", f"SELECT * FROM ({_RUNS}) ORDER BY value, run_id LIMIT 1", "value")
def t3(spark, d):
    return runs.best_run(_run_files(spark, d), "rmse").select("run_id", "value")


@query("t3_list_runs", "ehourly", "SELECT 'run-' || region AS run_id FROM ehourly WHERE region <> 'view' GROUP BY 1")
def t3l(spark, d):
    return runs.list_runs(_run_files(spark, d), "demand", "completed").select("run_id")


@query("io6_read_runs", "ehourly", "SELECT 'run-' || region AS run_id, avg(consumption_mw) AS rmse FROM ehourly GROUP BY 1", "rmse")
def io6(spark, d):
    path = _scratch(spark, "runs")
    r = base.event_hourly(spark, d).groupBy("region").agg(F.avg("consumption_mw").alias("m"))
    r.select(F.concat(F.lit("run-"), "region").alias("run_id"), F.create_map(F.lit("rmse"), "m").alias("metrics")).repartition(5, "run_id").write.option("maxRecordsPerFile", 1).json(path)
    return tables.read_runs(spark, path).select("run_id", F.try_element_at("metrics", F.lit("rmse")).alias("rmse"))


@query("io5_feature_stats", "ehourly", "SELECT 'consumption_mw' AS feature, avg(consumption_mw) AS mean, min(consumption_mw) AS min FROM ehourly", "mean min")
def io5(spark, d):
    path = _scratch(spark, "stats")
    one = base.event_hourly(spark, d).agg(F.struct(F.avg("consumption_mw").alias("mean"), F.min("consumption_mw").alias("min")).alias("s"))
    one.select(F.to_json(F.struct(F.create_map(F.lit("consumption_mw"), "s").alias("feature_stats"))).alias("value")).write.text(path)
    return tables.read_feature_stats(spark, path).select("feature", "mean", "min")
