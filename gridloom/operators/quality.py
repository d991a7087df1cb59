"""Validation, quality reports and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.regions import REGIONS
from gridloom.functions.weather import clip
from gridloom.operators.quantiles import attach, quantiles, with_quantiles

#: Hard bounds of observations (null: none).
HARD = {
    "humidity": (0.0, 100.0), "temperature": (-50.0, 60.0), "wind_speed": (0.0, None), "precipitation": (0.0, None),
    "pressure": (900.0, 1100.0), "cloud_cover": (0.0, 100.0),
}
#: Usual range of observations.
SOFT = {"temperature": (-10.0, 45.0), "wind_speed": (None, 150.0), "precipitation": (None, 200.0)}
#: Bounds of features.
FEATURE_BOUNDS = {
    "hour": (0, 23), "month": (1, 12), "day_of_week": (0, 6), "quarter": (1, 4), "day_of_month": (1, 31), "week_of_year": (1, 53),
    "day_of_year": (1, 366), "cloud_cover": (0, 100), "solar_proxy": (0, 100), "humidity": (0, 100), "is_weekend": (0, 1),
    "is_holiday": (0, 1), "is_business_hour": (0, 1),
}
#: Bounds and defaults of requests.
REQUEST = {
    "temperature": (-20.0, 50.0), "humidity": (0.0, 100.0), "wind_speed": (0.0, 200.0), "precipitation": (0.0, 500.0),
    "cloud_cover": (0.0, 100.0), "pressure": (900.0, 1100.0),
}
REQUEST_DEFAULTS = {"temperature": 15.0, "humidity": 70.0, "wind_speed": 10.0, "precipitation": 0.0, "cloud_cover": 50.0, "pressure": 1013.0}
WEATHER = ["temperature", "humidity", "wind_speed", "precipitation", "cloud_cover", "pressure"]


def outside(col: Column, lo: float | None, hi: float | None) -> Column:
    low = col < lo if lo is not None else F.lit(False)
    high = col > hi if hi is not None else F.lit(False)
    return F.coalesce(low | high, F.lit(False))


def _count_columns(rules: dict, samples: int) -> list[Column]:
    aggs = []
    for c, (lo, hi) in rules.items():
        bad = outside(F.col(c), lo, hi)
        aggs.append(F.count_if(bad).alias(f"{c}_n"))
        if samples:  # extremes stand for samples: a list of all offenders would not be bounded
            aggs += [F.min(F.when(bad, F.col(c))).alias(f"{c}_lo"), F.max(F.when(bad, F.col(c))).alias(f"{c}_hi")]
    return aggs


def _counts(df: DataFrame, rules: dict, samples: int) -> DataFrame:
    """One pass: for each rule its count and, with samples, the least and the greatest offending value."""
    rules = {c: r for c, r in rules.items() if c in df.columns}
    one = df.agg(*_count_columns(rules, samples))
    rows = [
        F.struct(F.lit(c).alias("rule"), F.col(f"{c}_n").alias("n_bad"), *([F.col(f"{c}_lo").alias("least"), F.col(f"{c}_hi").alias("greatest")] if samples else []))
        for c in rules
    ]
    return one.select(F.inline(F.array(*rows)))


def weather_violations(df: DataFrame) -> DataFrame:
    """rule, n_bad, least and greatest offending value, for every hard bound of a column that is there."""
    return _counts(df, HARD, 1)


def weather_samples(df: DataFrame, n: int = 5, rules: dict = HARD) -> DataFrame:
    """rule, n_bad and samples: up to ``n`` different offending values of each rule, the least first. Values are
    ranked where they lie before they meet, so no list is longer than ``n``."""
    rules = {c: r for c, r in rules.items() if c in df.columns}
    parts = [F.struct(F.lit(c).alias("rule"), F.when(outside(F.col(c), *r), F.col(c).cast("double")).alias("value")) for c, r in rules.items()]
    bad = df.select(F.inline(F.array(*parts))).filter("value IS NOT NULL").groupBy("rule", "value").agg(F.count("*").alias("c"))
    first = bad.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("value"))).filter(F.col("_r") <= n)
    lists = first.groupBy("rule").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return attach(_counts(df, rules, 0), lists, ["rule"]).select("rule", "n_bad", F.coalesce("samples", F.array().cast("array<double>")).alias("samples"))


def sample_violations(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """A few offending values of one column."""
    return df.filter(outside(F.col(column), *HARD[column])).select(column).limit(n)


def assert_weather(df: DataFrame) -> DataFrame:
    """The input, or an error that names the broken bounds."""
    checked_weather(df)
    return df


def checked_weather(df: DataFrame, **more: Column) -> dict:
    """An error that names the broken bounds, else the given aggregates' values, all from one pass."""
    rules = {c: r for c, r in HARD.items() if c in df.columns}
    columns = _count_columns(rules, 1) + [c.alias(n) for n, c in more.items()]
    got = df.agg(*columns).first().asDict() if columns else {}
    bad = [c for c in rules if got[f"{c}_n"]]
    if bad:
        raise ValueError("; ".join(f"{c}: {got[f'{c}_n']} value(s) outside {HARD[c]}, from {got[f'{c}_lo']} to {got[f'{c}_hi']}" for c in bad))
    return {n: got[n] for n in more}


def weather_warnings(df: DataFrame) -> DataFrame:
    return _counts(df, SOFT, 0)


def infinite(col: Column) -> Column:
    return F.abs(col) == float("inf")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]


def validate_features(df: DataFrame) -> DataFrame:
    """Infinite numbers to null, known features cut to their bounds."""
    new: dict[str, Column] = {}
    for c, t in df.dtypes:
        col = F.col(c)
        if t in ("double", "float"):
            col = F.when(~infinite(col), col)
        if c in FEATURE_BOUNDS:
            lo, hi = (F.lit(x).cast(t) for x in FEATURE_BOUNDS[c])
            col = clip(col, lo, hi)
        if t in ("double", "float") or c in FEATURE_BOUNDS:
            new[c] = col
    return df.withColumns(new)


def feature_violations(df: DataFrame) -> DataFrame:
    """rule and n_bad: infinite numbers of each column and values outside feature bounds."""
    checks = {f"infinite:{c}": infinite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    checks |= {f"bounds:{c}": outside(F.col(c), *FEATURE_BOUNDS[c]) for c in df.columns if c in FEATURE_BOUNDS}
    one = df.agg(*[F.count_if(F.coalesce(b, F.lit(False))).alias(f"c{i}") for i, b in enumerate(checks.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"c{i}").alias("n_bad")) for i, k in enumerate(checks)])))


def record_reasons(df: DataFrame, ts: str = "timestamp") -> Column:
    """Why a row isn't a valid record; empty for valid ones."""
    when = F.col(ts).try_cast("timestamp") if dict(df.dtypes)[ts] == "string" else F.col(ts)
    year = F.year(when)
    checks = [
        F.when(~F.coalesce(F.col("region").isin(REGIONS), F.lit(False)), "region"),
        F.when(when.isNull() | (year < 1900) | (year > 2200), "timestamp"),
    ]
    checks += [F.when(outside(F.col(c), *b), c) for c, b in REQUEST.items() if c in df.columns]
    if "consumption_mw" in df.columns:
        checks.append(F.when(F.col("consumption_mw") < 0, "consumption_mw"))
    return F.array_compact(F.array(*checks))


def validate_records(df: DataFrame, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with ``reasons``."""
    marked = df.withColumn("reasons", record_reasons(df, ts))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def fill_weather_defaults(df: DataFrame) -> DataFrame:
    have = {c: F.coalesce(c, F.lit(v)) for c, v in REQUEST_DEFAULTS.items() if c in df.columns}
    return df.withColumns(have | {c: F.lit(v) for c, v in REQUEST_DEFAULTS.items() if c not in df.columns})


def truth_reasons(df: DataFrame) -> Column:
    checks = [
        F.when(F.col("actual").isNull() | (F.col("actual") < 0), "actual"),
        F.when(F.col("lower") > F.col("upper"), "interval") if {"lower", "upper"} <= set(df.columns) else F.lit(None).cast("string"),
        F.when(~F.coalesce(F.col("region").isin(REGIONS), F.lit(False)), "region"),
        F.when(F.col("timestamp").isNull(), "timestamp"),
    ]
    return F.array_compact(F.array(*checks))


def validate_ground_truth(df: DataFrame) -> DataFrame:
    """Events that may update a tracker."""
    return df.filter(F.size(truth_reasons(df)) == 0)


def valid_prediction(col: Column) -> Column:
    return F.coalesce(~F.isnan(col) & ~infinite(col) & (col >= 0), F.lit(False))


def region_stats(df: DataFrame, col: str = "consumption_mw") -> DataFrame:
    """Distribution by region."""
    stats = df.groupBy("region").agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    return with_quantiles(stats, df, col, {"p1": 0.01, "p50": 0.5, "p99": 0.99}, ["region"])


def coverage_report(df: DataFrame) -> DataFrame:
    one = df.agg(
        F.count("*").alias("n_rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.count_distinct("timestamp").alias("n_hours"), F.count_distinct("region").alias("n_regions"),
    )
    hours = (F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))) / 3600 + 1
    return one.withColumn("expected_hours", F.floor(hours).cast("long")).withColumn(
        "coverage_pct", F.col("n_hours") * 100.0 / F.col("expected_hours")
    )


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str], log_size: int = 14) -> DataFrame:
    """by, and for each column a mergeable sketch of its distinct values (``n_<column>``): with 2**14 registers estimates
    are within 2 % with 99 % confidence."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), log_size).alias(f"n_{c}") for c in columns])


def distinct_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, and the estimated distinct values of each sketch column over any coarser grouping of sketches."""
    columns = [c for c, t in sketches.dtypes if t == "binary" and c.startswith("n_")]
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def national_report(df: DataFrame, low: float = 1000.0) -> DataFrame:
    """Quantiles of the hourly total and the hours below ``low``: a row."""
    total = df.groupBy("timestamp").agg(F.sum("consumption_mw").alias("total"))
    short = F.col("total") < low
    one = total.agg(F.count("*").alias("n_hours"), F.count_if(short).alias("n_low"), F.min(F.when(short, F.col("timestamp"))).alias("first_low"))
    one = one.withColumn("low_pct", F.try_divide(F.col("n_low") * 100.0, F.col("n_hours")))
    return with_quantiles(one, total, "total", {f"p{round(p * 100)}": p for p in (0.01, 0.05, 0.5, 0.95, 0.99)})


def low_hours(df: DataFrame, low: float = 1000.0, n: int = 10) -> DataFrame:
    """timestamp and total of the ``n`` lowest hours below ``low``, the lowest first."""
    total = df.groupBy("timestamp").agg(F.sum("consumption_mw").alias("total"))
    return total.filter(F.col("total") < low).orderBy("total", "timestamp").limit(n)


def weather_sanity(df: DataFrame, columns: list[str] = WEATHER) -> DataFrame:
    """variable, mean, min, max, n_null in long form, one pass."""
    have = [c for c in columns if c in df.columns]
    aggs = [f(c).alias(f"{c}_{n}") for c in have for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in have]
    rows = [F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}_{n}").cast("double").alias(n) for n in ("mean", "min", "max")], F.col(f"{c}_null").alias("n_null")) for c in have]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _fences(df: DataFrame, columns: list[str], method: str, by: list[str]) -> DataFrame:
    """by, feature, lo and hi: 1.5 interquartile ranges, or 3 population deviations."""
    if method == "iqr":
        q = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75], by)
        a, b = F.col("q")[0], F.col("q")[1]
        return q.select(*by, "feature", (a - (b - a) * 1.5).alias("lo"), (b + (b - a) * 1.5).alias("hi"))
    if method != "z":
        raise ValueError(f"unknown method {method!r}")
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"s{i}") for i, c in enumerate(columns)]
    m = df.groupBy(*by).agg(*parts).select(*by, F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))
    return m.select(*by, "feature", (F.col("m") - F.col("s") * 3).alias("lo"), (F.col("m") + F.col("s") * 3).alias("hi"))


def outlier_bounds(df: DataFrame, col: str, method: str = "iqr") -> DataFrame:
    """One row: lo and hi fence (1.5 interquartile ranges, or 3 population deviations)."""
    return _fences(df, [col], method, []).select("lo", "hi")


def outliers(df: DataFrame, col: str, method: str = "iqr") -> DataFrame:
    """Rows outside the fences, which come as two numbers through the driver."""
    b = outlier_bounds(df, col, method).first()
    if b is None or b["lo"] is None:
        return df.filter(F.lit(False))
    return df.filter((F.col(col) < F.lit(b["lo"])) | (F.col(col) > F.lit(b["hi"])))


def outlier_report(df: DataFrame, columns: list[str], methods: tuple = ("iqr", "z"), by: list[str] | None = None) -> DataFrame:
    """by, feature, method, lo, hi, n (values), n_below, n_above and pct (of values outside) of several columns."""
    by = list(by or [])
    each = [_fences(df, columns, m, by).withColumn("method", F.lit(m)) for m in methods]
    fences = reduce(DataFrame.unionByName, each)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*by, F.inline(parts)).filter("value IS NOT NULL")
    met = attach(rows, fences.groupBy(*by, "feature").agg(F.collect_list(F.struct("method", "lo", "hi")).alias("_f")), [*by, "feature"])
    low = [F.count_if(F.col("value") < F.col("_f")[i]["lo"]).alias(f"b{i}") for i in range(len(methods))]
    high = [F.count_if(F.col("value") > F.col("_f")[i]["hi"]).alias(f"a{i}") for i in range(len(methods))]
    counts = met.groupBy(*by, "feature", "_f").agg(F.count("*").alias("n"), *low, *high)  # few methods for each feature
    long = F.array(*[F.struct(F.col("_f")[i]["method"].alias("method"), F.col("_f")[i]["lo"].alias("lo"), F.col("_f")[i]["hi"].alias("hi"), F.col(f"b{i}").alias("n_below"), F.col(f"a{i}").alias("n_above")) for i in range(len(methods))])
    out = counts.select(*by, "feature", "n", F.inline(long))
    return out.withColumn("pct", (F.col("n_below") + F.col("n_above")) * 100.0 / F.col("n"))


def box_stats(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    stats = df.groupBy(*by).agg(F.min(col).alias("least"), F.max(col).alias("greatest"), F.count(col).alias("n"))
    return with_quantiles(stats, df, col, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin (1 to bins, the greatest value in the last) and n, of equal width from least to greatest."""
    b = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    if b["a"] is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    lo, hi = float(b["a"]), float(b["b"])
    at = F.floor((F.col(col) - lo) * bins / (hi - lo)) + 1 if hi > lo else F.lit(1)
    return df.filter(F.col(col).isNotNull()).groupBy(F.least(at, F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A digest of the rows as a multiset: their order and partitions don't matter, repeats do."""
    row = F.xxhash64(*[F.col(c) for c in columns or sorted(df.columns)])
    parts = df.select(row.alias("h"), F.xxhash64(row).alias("g"))
    one = parts.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("g", F.lit(2**31))).alias("s"))
    return one.select("n", F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("fingerprint"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
