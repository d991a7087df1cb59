"""Errors, intervals and reports, each in one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendars import special_days, year_span, years_between
from gridloom.operators.quantiles import with_quantiles
from gridloom.operators.series import KEY, TS, baseline_columns, baseline_forecasts, windowed

#: Fixed names: report categories in order.
DAY_TYPES = ["weekday", "saturday", "sunday", "fixed_holiday", "easter_holiday", "bridge"]


def regression_aggs(y: str, p: str, prefix: str = "") -> list[Column]:
    """Over rows in which both are present: n, mae, rmse, mape, r2, nrmse."""
    a, b = F.col(y), F.col(p)
    both = a.isNotNull() & b.isNotNull()
    on = lambda c: F.when(both, c)
    err = on(a - b)
    rmse = F.sqrt(F.avg(err * err))
    ss = F.var_pop(on(a)) * F.count_if(both)
    out = {
        "n": F.count_if(both), "mae": F.avg(F.abs(err)), "rmse": rmse,
        "mape": F.avg(F.when(both & (a != 0), F.abs((a - b) / F.when(a != 0, a)))) * 100,
        "r2": F.lit(1.0) - F.try_divide(F.sum(err * err), F.when(ss > 0, ss)), "nrmse": F.try_divide(rmse, F.avg(on(a))),
    }
    return [v.alias(prefix + k) for k, v in out.items()]


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, prefix: str = "") -> DataFrame:
    return df.groupBy(*(by or [])).agg(*regression_aggs(y, p, prefix))


def require_rows(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """The input, or an error if a group has no usable row."""
    if not metrics.filter(F.col(f"{prefix}n") == 0).isEmpty():
        raise ValueError("no rows with both values")
    return metrics


def overall_and_regions(df: DataFrame, y: str, p: str) -> DataFrame:
    """Metrics over all rows (region null) and by region, in one scan."""
    return df.groupingSets([[], [F.col(KEY)]], F.col(KEY)).agg(*regression_aggs(y, p))


def coverage_aggs(y: str, lo: str, hi: str, expected: float) -> list[Column]:
    hit = (F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))
    width = F.col(hi) - F.col(lo)
    share = F.avg(hit.cast("double"))
    return [
        share.alias("coverage"), F.lit(expected).alias("expected"), (share - expected).alias("coverage_error"), F.avg(width).alias("width_mean"),
        F.stddev_pop(width).alias("width_std"), F.min(width).alias("width_min"), F.max(width).alias("width_max"),
        F.count(hit).alias("n"), F.count_if(hit).alias("n_within"),
    ]


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, expected: float = 0.90, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*coverage_aggs(y, lo, hi, expected))


def mase(test: DataFrame, train: DataFrame, y: str, p: str, season: int = 24, interleaved: bool = False) -> DataFrame:
    """Error over that of the seasonal naive forecast on the training rows.

    By region; ``interleaved`` takes all regions' rows as one series in order of time and region.
    """
    if interleaved:
        from gridloom.operators.splits import row_index

        rows = row_index(train, "_i", key=None)
        old = rows.select((F.col("_i") + season).alias("_i"), F.col(y).alias("_old"))
        naive = rows.join(old, "_i").agg(F.avg(F.abs(F.col(y) - F.col("_old"))).alias("naive_mae"))
        own = test.agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))
        one = own.withColumn("_k", F.lit(1)).join(naive.withColumn("_k", F.lit(1)), "_k").drop("_k")
        return one.withColumn("mase", F.try_divide("mae", F.when(F.col("naive_mae") > 0, F.col("naive_mae"))))
    back = windowed(train.select(KEY, TS, y), lambda w: {"_old": F.lag(y, season).over(w)}, season)
    naive = back.withColumn("_d", F.abs(F.col(y) - F.col("_old"))).groupBy(KEY).agg(F.avg("_d").alias("naive_mae"))
    own = test.groupBy(KEY).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))
    both = own.join(naive, KEY, "left")
    return both.withColumn("mase", F.try_divide("mae", F.when(F.col("naive_mae") > 0, F.col("naive_mae"))))


#: Quantiles of residuals.
RESIDUAL_QUANTILES = {"res_q25": 0.25, "res_median": 0.5, "res_q75": 0.75}


def residual_aggs(y: str, p: str) -> list[Column]:
    """All of residuals that one pass gives; ``RESIDUAL_QUANTILES`` are added by ranks."""
    r = F.col(y) - F.col(p)
    return [
        F.avg(r).alias("res_mean"), F.stddev_pop(r).alias("res_std"), F.min(r).alias("res_min"), F.max(r).alias("res_max"),
        F.skewness(r).alias("res_skew"), F.kurtosis(r).alias("res_kurtosis"),
    ]


def residual_stats(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return with_quantiles(df.groupBy(*(by or [])).agg(*residual_aggs(y, p)), df, F.col(y) - F.col(p), RESIDUAL_QUANTILES, by)


def metrics_summary(df: DataFrame, y: str, p: str, lo: str, hi: str, by: list[str] | None = None, expected: float = 0.90) -> DataFrame:
    """Errors, coverage and residuals: one pass, and the ranks of residuals."""
    cover = [c for c in coverage_aggs(y, lo, hi, expected)][:7]
    one = df.groupBy(*(by or [])).agg(*regression_aggs(y, p), *cover, *residual_aggs(y, p))
    return with_quantiles(one, df, F.col(y) - F.col(p), RESIDUAL_QUANTILES, by)


def error_breakdown(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    err = F.abs(F.col(y) - F.col(p))
    return df.groupBy(*by).agg(*regression_aggs(y, p)[:4], F.avg(err).alias("abs_mean"), F.stddev_samp(err).alias("abs_std"))


def worst_and_best(breakdown: DataFrame, by: str, metric: str = "mape") -> DataFrame:
    return breakdown.agg(F.max_by(by, metric).alias("worst"), F.min_by(by, metric).alias("best"))


def day_type_report(df: DataFrame, y: str = "consumption_mw", p: str = "y_pred", ts: str = TS, years: tuple[int, int] | None = None) -> DataFrame:
    """Error by overlapping kinds of day; every kind has a row."""
    spark = df.sparkSession
    days = special_days(years_between(spark, *(years or year_span(df, ts))))
    kinds = days.groupBy("date").agg(F.collect_set("category").alias("_kinds"))
    tagged = df.withColumn("date", F.to_date(ts)).join(F.broadcast(kinds), "date", "left")
    dow, own = F.weekday("date"), F.coalesce("_kinds", F.array().cast("array<string>"))
    has = lambda k: F.array_contains(own, k)
    of = {
        "weekday": (dow < 5) & (F.size(own) == 0), "saturday": dow == 5, "sunday": dow == 6, "fixed_holiday": has("fixed"),
        "easter_holiday": has("easter"), "bridge": has("bridge"),
    }
    each = tagged.withColumn("category", F.explode(F.array_compact(F.array(*[F.when(of[k], k) for k in DAY_TYPES]))))
    a, b = F.col(y), F.col(p)
    far = F.abs(a) > 1e-6
    got = each.groupBy("category").agg(
        F.count("*").alias("n_hours"), F.avg(a).alias("mean_actual"), F.avg(b).alias("mean_predicted"),
        (F.avg(F.when(far, F.abs((a - b) / F.when(far, a)))) * 100).alias("mape"), (F.avg(b) - F.avg(a)).alias("bias"),
    )
    every = spark.createDataFrame([(k,) for k in DAY_TYPES], "category string")
    bias = F.col("bias")
    direction = F.when(bias.isNull(), "n/a").when(F.abs(bias) < 1e-6, "neutral").when(bias > 0, "over-predicts").otherwise("under-predicts")
    out = every.join(got, "category", "left").withColumn("direction", direction)
    return out.withColumn("n_hours", F.coalesce("n_hours", F.lit(0)).cast("long"))


def conformal_quantile(df: DataFrame, y: str, p: str, alpha: float = 0.1, by: list[str] | None = None) -> DataFrame:
    return with_quantiles(df.groupBy(*(by or [])).agg(F.count("*").alias("n")), df, F.abs(F.col(y) - F.col(p)), {"q": 1 - alpha}, by)


def evaluate_baselines(df: DataFrame, test: Column, y: str = "consumption_mw") -> DataFrame:
    """baseline, region (null: all) and metrics on test rows; forecasts see the rows before them."""
    cols = list(baseline_columns(y))
    wide = baseline_forecasts(df, y).filter(test)
    long = wide.select(KEY, F.col(y).alias("_y"), F.inline(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("_p")) for n in cols])))
    sets = [[F.col("baseline")], [F.col("baseline"), F.col(KEY)]]
    return long.groupingSets(sets, F.col("baseline"), F.col(KEY)).agg(*regression_aggs("_y", "_p"))


def baseline_improvement(metrics: DataFrame, model_rmse: float) -> DataFrame:
    """The best baseline and by how much per cent the model's RMSE is lower."""
    best = metrics.agg(F.min_by("baseline", "rmse").alias("baseline"), F.min("rmse").alias("rmse"))
    return best.withColumn("improvement_pct", F.try_divide((F.col("rmse") - model_rmse) * 100, F.col("rmse")))
