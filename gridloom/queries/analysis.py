"""Queries of descriptive statistics and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import explore, leakage, metrics, series
from gridloom.operators.splits import temporal_split
from gridloom.queries import base
from gridloom.queries.base import query
from gridloom.queries.features import BASELINES_SQL, SPECIAL, W

D = {"mean": "avg(consumption_mw)", "std": "stddev_samp(consumption_mw)", "min": "min(consumption_mw)", "q25": "quantile_cont(consumption_mw, 0.25)", "q50": "quantile_cont(consumption_mw, 0.5)", "q75": "quantile_cont(consumption_mw, 0.75)", "max": "max(consumption_mw)", "skew": "skewness(consumption_mw)", "kurtosis": "kurtosis(consumption_mw)"}


@query("a8_describe", "ehourly", "SELECT region, count(*) AS n, " + ", ".join(f"{e} AS {n}" for n, e in D.items()) + " FROM ehourly GROUP BY 1", " ".join(D), "n", 5)
def a8(spark, d):
    return explore.describe_target(base.event_hourly(spark, d), by=["region"])


_PROF = "SELECT hour(timestamp) AS hour, avg(consumption_mw) AS mean, stddev_samp(consumption_mw) AS std, count(*) AS n FROM ehourly GROUP BY 1"


@query("a9_profile", "ehourly", _PROF, "mean std", "hour n")
def a9(spark, d):
    return explore.profile(base.event_hourly(spark, d), ["hour"])


@query("a9_peak_trough", "ehourly", f"SELECT arg_max(hour, mean) AS peak, arg_min(hour, mean) AS trough FROM ({_PROF})", "", "peak trough")
def a9p(spark, d):
    return explore.peak_trough(explore.profile(base.event_hourly(spark, d), ["hour"]))


@query("a10_heatmap", "ehourly", "SELECT isodow(timestamp) - 1 AS day_of_week, " + ", ".join(f"avg(consumption_mw) FILTER (hour(timestamp) = {h}) AS h{h}" for h in range(24)) + " FROM ehourly GROUP BY 1", " ".join(f"h{h}" for h in range(24)), "day_of_week")
def a10(spark, d):
    return explore.heatmap(base.event_hourly(spark, d))


@query("a11_region_profile", "ehourly", "SELECT region, hour(timestamp) AS hour, avg(consumption_mw) AS mean, stddev_samp(consumption_mw) AS std, count(*) AS n FROM ehourly GROUP BY 1, 2", "mean std", "hour n")
def a11(spark, d):
    return explore.profile(base.event_hourly(spark, d), ["region", "hour"])


COLS = ["temperature", "humidity", "wind_speed", "precipitation", "cloud_cover", "pressure"]


@query("a12_target_correlation", "weather", "SELECT *, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, consumption_mw) AS r FROM weather" for c in COLS) + ")", "r", "rank")
def a12(spark, d):
    return explore.target_correlation(base.weather(spark, d), COLS)


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM weather" for i, a in enumerate(COLS) for b in COLS[i + 1 :])


@query("a13_correlated_pairs", "weather", f"SELECT * FROM ({_PAIRS}) WHERE abs(r) > 0.005", "r")
def a13(spark, d):
    return explore.correlated_pairs(base.weather(spark, d), COLS, 0.005)


@query("a14_mutual_information")
def a14(spark, d):
    return explore.mutual_information(base.weather(spark, d), COLS)


_ACF = (
    "WITH n AS (SELECT region, consumption_mw - avg(consumption_mw) OVER (PARTITION BY region) AS x, row_number() OVER (PARTITION BY region ORDER BY timestamp) AS i FROM ehourly),"
    " v AS (SELECT region, sum(x * x) AS s FROM n GROUP BY 1) SELECT a.region, k AS lag, sum(a.x * b.x) / any_value(v.s) AS r FROM n a, (SELECT unnest(range(0, 73)) AS k)"
    " JOIN n b ON a.region = b.region AND a.i = b.i + k JOIN v ON v.region = a.region GROUP BY 1, 2"
)


@query("a15_acf", "ehourly", _ACF, "r", "lag")
def a15(spark, d):
    return explore.acf(base.event_hourly(spark, d))


_PACF = (
    f"WITH RECURSIVE l AS (SELECT region, list(r ORDER BY lag) AS rho FROM ({_ACF.replace('range(0, 73)', 'range(0, 25)')}) GROUP BY 1),"
    " p AS (SELECT region, rho, 0 AS lag, []::DOUBLE[] AS phi, 1.0::DOUBLE AS err, 1.0::DOUBLE AS r FROM l UNION ALL"
    " SELECT region, rho, lag + 1, list_append(list_transform(phi, lambda x, j: x - last * phi[lag + 1 - j]), last), err * (1 - last * last), last"
    " FROM (SELECT *, (rho[lag + 2] - coalesce(list_sum(list_transform(phi, lambda x, j: x * rho[lag + 2 - j])), 0)) / err AS last FROM p WHERE lag < 24))"
    " SELECT region, lag, r FROM p"
)


@query("a16_pacf", "ehourly", _PACF, "r", "lag")
def a16(spark, d):
    return explore.pacf(explore.acf(base.event_hourly(spark, d), 24))


M = {
    "mae": "avg(abs(y - p))", "rmse": "sqrt(avg((y - p) * (y - p)))", "mape": "avg(abs((y - p) / nullif(y, 0))) * 100",
    "r2": "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))", "nrmse": "sqrt(avg((y - p) * (y - p))) / avg(y)",
}
MS = "count(*) AS n, " + ", ".join(f"{e} AS {n}" for n, e in M.items())
YP = "(SELECT timestamp, region, consumption_mw AS y, y_pred AS p FROM predicted WHERE y_pred IS NOT NULL)"


@query("a19_regression_metrics", "predicted", f"SELECT region, {MS} FROM {YP} GROUP BY 1", " ".join(M), "n", 5)
def a19(spark, d):
    return metrics.regression_metrics(base.predicted(spark, d), "consumption_mw", "y_pred", ["region"])


@query("g3_overall_and_regions", "predicted", f"SELECT region, {MS} FROM {YP} GROUP BY GROUPING SETS ((), (region))", " ".join(M), "n", 5)
def g3(spark, d):
    return metrics.overall_and_regions(base.predicted(spark, d), "consumption_mw", "y_pred")


C = {
    "coverage": "avg((actual BETWEEN lower AND upper)::INT)", "expected": "0.9::DOUBLE", "coverage_error": "avg((actual BETWEEN lower AND upper)::INT) - 0.9", "width_mean": "avg(upper - lower)",
    "width_std": "stddev_pop(upper - lower)", "width_min": "min(upper - lower)", "width_max": "max(upper - lower)",
}
CS = ", ".join(f"{e} AS {n}" for n, e in C.items())


@query("a20_interval_coverage", "judged", f"SELECT region, {CS}, count(*) AS n, count(*) FILTER (actual BETWEEN lower AND upper) AS n_within FROM judged GROUP BY 1", " ".join(C), "n n_within")
def a20(spark, d):
    return metrics.interval_coverage(base.judged(spark, d), "actual", "lower", "upper", by=["region"])


_CUT = "(SELECT *, row_number() OVER (ORDER BY timestamp, region) - 1 AS i, count(*) OVER () AS n FROM predicted)"


@query(
    "a21_mase", "predicted",
    f"SELECT t.region, t.mae, b.naive_mae, t.mae / b.naive_mae AS mase FROM (SELECT region, avg(abs(consumption_mw - y_pred)) AS mae FROM {_CUT} WHERE i >= floor(n * 0.85) GROUP BY 1) t JOIN"
    f" (SELECT region, avg(abs(x)) AS naive_mae FROM (SELECT region, consumption_mw - lag(consumption_mw, 24) OVER (PARTITION BY region ORDER BY timestamp) AS x FROM {_CUT} WHERE i < floor(n * 0.7)) GROUP BY 1) b USING (region)",
    "mae naive_mae mase",
)
def a21(spark, d):
    rows = temporal_split(base.predicted(spark, d))
    return metrics.mase(rows.filter("split = 'test'"), rows.filter("split = 'train'"), "consumption_mw", "y_pred")


@query(
    "a21_mase_interleaved", "predicted",
    f"SELECT t.mae, b.naive_mae, t.mae / b.naive_mae AS mase FROM (SELECT avg(abs(consumption_mw - y_pred)) AS mae FROM {_CUT} WHERE i >= floor(n * 0.85)) t,"
    f" (SELECT avg(abs(x)) AS naive_mae FROM (SELECT consumption_mw - lag(consumption_mw, 24) OVER (ORDER BY i) AS x FROM {_CUT} WHERE i < floor(n * 0.7))) b", "mae naive_mae mase",
)
def a21i(spark, d):
    rows = temporal_split(base.predicted(spark, d))
    return metrics.mase(rows.filter("split = 'test'"), rows.filter("split = 'train'"), "consumption_mw", "y_pred", interleaved=True)


R = {
    "res_mean": "avg(y - p)", "res_std": "stddev_pop(y - p)", "res_min": "min(y - p)", "res_max": "max(y - p)", "res_q25": "quantile_cont(y - p, 0.25)", "res_median": "quantile_cont(y - p, 0.5)",
    "res_q75": "quantile_cont(y - p, 0.75)", "res_skew": "skewness(y - p) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1))", "res_kurtosis": "kurtosis_pop(y - p)",
}
RS = ", ".join(f"{e} AS {n}" for n, e in R.items())


@query("a22_residual_stats", "predicted", f"SELECT region, {RS} FROM {YP} GROUP BY 1", " ".join(R), "", 5)
def a22(spark, d):
    return metrics.residual_stats(base.predicted(spark, d).filter("y_pred IS NOT NULL"), "consumption_mw", "y_pred", ["region"])


@query("a23_metrics_summary", "judged", f"SELECT region, {MS}, {CS}, {RS} FROM (SELECT *, actual AS y, predicted AS p FROM judged) GROUP BY 1", " ".join([*M, *C, *R]), "n", 5)
def a23(spark, d):
    return metrics.metrics_summary(base.judged(spark, d), "actual", "predicted", "lower", "upper", ["region"])


@query("a24_error_breakdown", "predicted", f"SELECT hour(timestamp) AS hour, count(*) AS n, {', '.join(f'{M[k]} AS {k}' for k in ('mae', 'rmse', 'mape'))}, avg(abs(y - p)) AS abs_mean, stddev_samp(abs(y - p)) AS abs_std FROM {YP} GROUP BY 1", "mae rmse mape abs_mean abs_std", "hour n", 5)
def a24(spark, d):
    rows = base.predicted(spark, d).filter("y_pred IS NOT NULL").withColumn("hour", F.hour("timestamp"))
    return metrics.error_breakdown(rows, "consumption_mw", "y_pred", ["hour"])


@query("a25_day_types")
def a25(spark, d):
    rows = base.daily(spark, d).withColumn("y_pred", F.lag("consumption_mw").over(series.over())).filter("y_pred IS NOT NULL")
    return metrics.day_type_report(rows)


_DT = (
    "kinds AS (SELECT date, list(category) AS k FROM special GROUP BY 1), x AS (SELECT timestamp::DATE AS date, consumption_mw AS y, lag(consumption_mw) OVER (PARTITION BY region ORDER BY timestamp) AS p FROM daily),"
    " t AS (SELECT x.*, isodow(x.date) AS w, coalesce(k, []) AS k FROM x LEFT JOIN kinds USING (date) WHERE p IS NOT NULL),"
    " c AS (SELECT 'weekday' AS category, * FROM t WHERE w <= 5 AND len(k) = 0 UNION ALL SELECT 'saturday', * FROM t WHERE w = 6 UNION ALL SELECT 'sunday', * FROM t WHERE w = 7"
    " UNION ALL SELECT 'fixed_holiday', * FROM t WHERE list_contains(k, 'fixed') UNION ALL SELECT 'easter_holiday', * FROM t WHERE list_contains(k, 'easter') UNION ALL SELECT 'bridge', * FROM t WHERE list_contains(k, 'bridge'))"
)
base.ORACLES["a25_day_types"] = (
    base.role_sql("daily") + ", " + SPECIAL + ", " + _DT + ", o AS (SELECT category, count(*) AS n_hours, avg(y) AS mean_actual, avg(p) AS mean_predicted, avg(abs((y - p) / y)) * 100 AS mape,"
    " avg(p) - avg(y) AS bias FROM c GROUP BY 1) SELECT category, n_hours, round(mean_actual, 3) + 0.0::DOUBLE AS mean_actual, round(mean_predicted, 3) + 0.0::DOUBLE AS mean_predicted, round(mape, 3) + 0.0::DOUBLE AS mape,"
    " round(bias, 3) + 0.0::DOUBLE AS bias, CASE WHEN abs(bias) < 1e-6 THEN 'neutral' WHEN bias > 0 THEN 'over-predicts' ELSE 'under-predicts' END AS direction FROM o"
)
base.QUERIES["a25_day_types"] = lambda spark, d: base.tidy(a25(spark, d), 3)


@query("a26_conformal", "predicted", f"SELECT region, quantile_cont(abs(y - p), 0.9) AS q, count(*) AS n FROM {YP} GROUP BY 1", "q", "n")
def a26(spark, d):
    return metrics.conformal_quantile(base.predicted(spark, d).filter("y_pred IS NOT NULL"), "consumption_mw", "y_pred", 0.1, ["region"])


_B = ["persistence", "seasonal_24", "seasonal_168", "moving_average_24", "moving_average_168"]
_BL = " UNION ALL ".join(f"SELECT '{b}' AS baseline, region, consumption_mw AS y, {b} AS p FROM x WHERE {b} IS NOT NULL AND timestamp >= TIMESTAMP '2024-01-24'" for b in _B)
_EV = f"WITH x AS ({BASELINES_SQL}) SELECT baseline, region, {MS} FROM ({_BL}) GROUP BY GROUPING SETS ((baseline), (baseline, region))"


@query("w9_evaluate_baselines", "ehourly", _EV, " ".join(M), "n", 5)
def w9(spark, d):
    return metrics.evaluate_baselines(base.event_hourly(spark, d), F.col("timestamp") >= F.lit("2024-01-24").cast("timestamp_ntz"))


@query("a30_improvement", "ehourly", f"SELECT arg_min(baseline, rmse) AS baseline, min(rmse) AS rmse, (min(rmse) - 20.0) * 100 / min(rmse) AS improvement_pct FROM ({_EV}) WHERE region IS NULL", "rmse improvement_pct", "", 5)
def a30(spark, d):
    return metrics.baseline_improvement(w9(spark, d).filter("region IS NULL"), 20.0)


@query("t2_top_features", "weather", "SELECT feature, r AS score FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, consumption_mw) AS r FROM weather" for c in COLS) + ") ORDER BY abs(r) DESC, feature LIMIT 3", "score")
def t2(spark, d):
    r = explore.target_correlation(base.weather(spark, d), COLS)
    return explore.top_features(r.select("feature", F.col("r").alias("score")), 3)


def _swap(spark, d, scale):
    rows = series.lag_features(base.event_hourly(spark, d), [1]).na.drop()
    late = F.col("timestamp") >= F.lit("2024-01-24").cast("timestamp_ntz")
    return leakage.donor_swap(rows.filter(late), rows.filter(~late), ["consumption_mw_lag_1"], scale)


_SW = (
    "WITH x AS (SELECT *, lag(consumption_mw) OVER w AS l FROM ehourly " + W + "), t AS (SELECT * FROM x WHERE l IS NOT NULL AND timestamp >= TIMESTAMP '2024-01-24'),"
    " m AS (SELECT region, avg(l) AS m FROM x WHERE l IS NOT NULL AND timestamp < TIMESTAMP '2024-01-24' GROUP BY 1),"
    " s AS (SELECT a.region, b.region AS donor, a.consumption_mw AS y, b.l * CASE WHEN a.region = b.region THEN 1 ELSE mo.m / md.m END AS p FROM t a JOIN t b ON a.timestamp = b.timestamp"
    " JOIN m mo ON mo.region = a.region JOIN m md ON md.region = b.region) SELECT region, donor, avg(abs((y - p) / y)) * 100 AS mape, count(*) AS n FROM s WHERE y <> 0 GROUP BY 1, 2"
)


@query("j6_donor_swap", "ehourly", _SW, "mape", "n", 5)
def j6(spark, d):
    return leakage.leakage_matrix(_swap(spark, d, True), lambda df: df.withColumn("prediction", F.col("consumption_mw_lag_1")))


@query(
    "a28_leakage_verdict", "ehourly",
    f"SELECT own, others, others - own AS degradation, others / own AS ratio, others / own < 1.5 AS leak FROM (SELECT avg(mape) FILTER (region = donor) AS own, avg(mape) FILTER (region <> donor) AS others FROM ({_SW}))",
    "own others degradation ratio", "", 5,
)
def a28(spark, d):
    return leakage.leakage_verdict(j6(spark, d))
