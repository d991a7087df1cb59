"""Queries of calendar, weather, window and feature operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridloom.functions import calendars, intervals
from gridloom.functions import weather as wx
from gridloom.operators import series as s
from gridloom.operators import splits
from gridloom.plans import features
from gridloom.queries import base
from gridloom.queries.base import query

FIELDS = {
    "hour": "hour(timestamp)", "day_of_week": "isodow(timestamp) - 1", "day_of_month": "day(timestamp)", "month": "month(timestamp)", "quarter": "quarter(timestamp)",
    "year": "year(timestamp)", "week_of_year": "week(timestamp)", "day_of_year": "dayofyear(timestamp)", "is_weekend": "(isodow(timestamp) >= 6)::INT",
    "is_business_hour": "(hour(timestamp) BETWEEN 9 AND 17 AND isodow(timestamp) <= 5)::INT",
}


@query("f1_temporal", "ehourly", "SELECT timestamp, region, " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + " FROM ehourly", "", " ".join(FIELDS))
def f1(spark, d):
    return calendars.temporal_features(base.event_hourly(spark, d)).select("timestamp", "region", *FIELDS)


TURNS = {"hour": ("hour(timestamp)", 24), "day": ("(isodow(timestamp) - 1)", 7), "month": ("month(timestamp)", 12), "day_of_year": ("dayofyear(timestamp)", 365)}
CYCLES = [f"{n}_{f}" for n in TURNS for f in ("sin", "cos")]


@query("f2_cyclical", "daily", "SELECT timestamp, region, " + ", ".join(f"{f}(2 * pi() * {e} / {t}) AS {n}_{f}" for n, (e, t) in TURNS.items() for f in ("sin", "cos")) + " FROM daily", " ".join(CYCLES))
def f2(spark, d):
    return calendars.temporal_features(base.daily(spark, d)).select("timestamp", "region", *CYCLES)


@query("f3_aliases", "ehourly", "SELECT timestamp, region, sin(2 * pi() * hour(timestamp) / 24) AS sin_hour, cos(2 * pi() * month(timestamp) / 12) AS cos_month FROM ehourly", "sin_hour cos_month")
def f3(spark, d):
    return calendars.add_aliases(calendars.temporal_features(base.event_hourly(spark, d))).select("timestamp", "region", "sin_hour", "cos_month")


PARTS = {"is_morning": "h BETWEEN 6 AND 11", "is_afternoon": "h BETWEEN 12 AND 17", "is_evening": "h BETWEEN 18 AND 21", "is_night": "h >= 22 OR h < 6"}


@query("f4_day_parts", "ehourly", "SELECT timestamp, region, " + ", ".join(f"({v})::INT AS {k}" for k, v in PARTS.items()) + " FROM (SELECT *, hour(timestamp) AS h FROM ehourly)", "", " ".join(PARTS))
def f4(spark, d):
    return calendars.day_parts(calendars.temporal_features(base.event_hourly(spark, d))).select("timestamp", "region", *PARTS)


@query("f5_hour_of_week", "ehourly", "SELECT timestamp, region, (isodow(timestamp) - 1) * 24 + hour(timestamp) AS hour_of_week FROM ehourly", "", "hour_of_week")
def f5(spark, d):
    return base.event_hourly(spark, d).select("timestamp", "region", calendars.hour_of_week(F.col("timestamp")).alias("hour_of_week"))


@query(
    "f6_season", "daily",
    "SELECT CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' WHEN month(timestamp) <= 5 THEN 'spring' WHEN month(timestamp) <= 8 THEN 'summer' ELSE 'autumn' END AS season, count(*) AS n FROM daily GROUP BY 1", "", "n",
)
def f6(spark, d):
    return base.daily(spark, d).groupBy(calendars.season(F.col("timestamp")).alias("season")).agg(F.count("*").alias("n"))


# the same day by another rule: the first Sunday after the full moon that tables of epacts give
EASTER = (
    "years AS (SELECT DISTINCT year(o_orderdate) + k AS year FROM orders, (SELECT unnest(range(-1, 2)) AS k)),"
    " e1 AS (SELECT year, year % 19 AS g, year // 100 AS c FROM years),"
    " e2 AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM e1),"
    " e3 AS (SELECT *, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM e2),"
    " e4 AS (SELECT *, i - ((year + year // 4 + i + 2 - c + c // 4) % 7) AS l FROM e3),"
    " easter AS (SELECT year, make_date(year, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS easter FROM e4)"
)
FIXED = ", ".join(f"({m}, {x})" for m, x in calendars.FIXED_HOLIDAYS)
HOLIDAYS = (
    EASTER + f", fixed AS (SELECT make_date(year, m, x) AS date, 'fixed' AS kind FROM years, (VALUES {FIXED}) t(m, x)),"
    " moved AS (SELECT (easter + k)::DATE AS date, 'easter' AS kind FROM easter, (SELECT unnest([-2, 0, 60]) AS k)),"
    " holidays AS (SELECT date, max(kind) AS kind FROM (SELECT * FROM fixed UNION ALL SELECT * FROM moved) GROUP BY 1)"
)


def with_sql(roles: str, ctes: str, body: str) -> str:
    """SQL of its own ``WITH`` behind the roles'."""
    head = base.role_sql(*roles.split()) + ", " if roles else "WITH "
    return f"{head}{ctes}, _out AS ({body}) SELECT * FROM _out"


def _years(spark, d):
    o = base.table(spark, d, "orders").select(F.year("o_orderdate").alias("y"))
    return o.select(F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("year")).distinct()


@query("f7_easter")
def f7(spark, d):
    y = _years(spark, d)
    return y.select("year", calendars.easter(F.col("year")).alias("easter"))


base.ORACLES["f7_easter"] = with_sql("", EASTER, "SELECT cast(year AS BIGINT) AS year, easter FROM easter")


@query("f8_holiday_calendar")
def f8(spark, d):
    return calendars.holiday_calendar(_years(spark, d))


base.ORACLES["f8_holiday_calendar"] = with_sql("", HOLIDAYS, "SELECT date, kind FROM holidays")

DIM = (
    HOLIDAYS + ", days AS (SELECT unnest(generate_series(make_date((SELECT min(year) FROM years), 1, 1)::TIMESTAMP, make_date((SELECT max(year) FROM years), 12, 31)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date),"
    " marked AS (SELECT d.date, h.date IS NOT NULL AS h, isodow(d.date) AS w FROM days d LEFT JOIN holidays h USING (date)),"
    " near AS (SELECT *, lead(h) OVER o AS eve, lag(h) OVER o AS aft, min(CASE WHEN h THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt,"
    " max(CASE WHEN h THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst FROM marked WINDOW o AS (ORDER BY date)),"
    " bridged AS (SELECT *, NOT h AND (w = 1 AND eve OR w = 5 AND aft) AS b FROM near),"
    " runs AS (SELECT *, h OR b OR w >= 6 AS off, sum(CASE WHEN h OR b OR w >= 6 THEN 0 ELSE 1 END) OVER (ORDER BY date) AS r FROM bridged),"
    " dim AS (SELECT *, sum(off::INT) OVER (PARTITION BY r) AS len, max(b::INT) OVER (PARTITION BY r) AS hb FROM runs)"
)
DAYS = "SELECT DISTINCT o_orderdate::DATE AS date FROM orders"


def _daily_dates(spark, d):
    return base.table(spark, d, "orders").select(F.col("o_orderdate").alias("timestamp")).distinct()


@query("f9_holiday_flags")
def f9(spark, d):
    rows = calendars.holiday_features(_daily_dates(spark, d))
    return rows.select(F.to_date("timestamp").alias("date"), "is_holiday", "is_holiday_eve", "is_holiday_after")


base.ORACLES["f9_holiday_flags"] = with_sql("", DIM, f"SELECT date, h::BIGINT AS is_holiday, eve::BIGINT AS is_holiday_eve, aft::BIGINT AS is_holiday_after FROM dim JOIN ({DAYS}) USING (date)")


@query("f10_holiday_distance")
def f10(spark, d):
    rows = calendars.holiday_features(_daily_dates(spark, d))
    return rows.select(F.to_date("timestamp").alias("date"), "days_to_nearest_holiday", "days_to_holiday", "days_from_holiday")


base.ORACLES["f10_holiday_distance"] = with_sql(
    "", DIM,
    "SELECT date, least(nxt - date, date - lst, 30)::BIGINT AS days_to_nearest_holiday, least(nxt - date, 30)::BIGINT AS days_to_holiday,"
    f" least(date - lst, 30)::BIGINT AS days_from_holiday FROM dim JOIN ({DAYS}) USING (date)",
)


@query("f11_bridge_days")
def f11(spark, d):
    rows = calendars.holiday_features(_daily_dates(spark, d))
    return rows.select(F.to_date("timestamp").alias("date"), "is_bridge_day", "is_extended_weekend", "days_in_holiday_window")


base.ORACLES["f11_bridge_days"] = with_sql(
    "", DIM,
    "SELECT date, b::BIGINT AS is_bridge_day, (off AND len >= 4 AND hb = 1)::BIGINT AS is_extended_weekend,"
    f" (CASE WHEN off THEN len ELSE 0 END)::BIGINT AS days_in_holiday_window FROM dim JOIN ({DAYS}) USING (date)",
)



def _by_key(rows, cols):
    return rows.groupBy("region", F.hour("timestamp").alias("h")).agg(*[F.avg(c).alias(c) for c in cols])


def _wx_sql(exprs: dict[str, str]) -> str:
    return "SELECT region, hour(timestamp) AS h, " + ", ".join(f"avg({e}) AS {n}" for n, e in exprs.items()) + " FROM weather GROUP BY 1, 2"


_GAMMA = "(ln(greatest(1.0, least(100.0, humidity)) / 100.0) + 17.62 * temperature / (243.12 + temperature))"


@query("f12_dew_point", "weather", _wx_sql({"dew_point": f"least(temperature, greatest(-80.0, 243.12 * {_GAMMA} / (17.62 - {_GAMMA})))"}), "dew_point", "h")
def f12(spark, d):
    return _by_key(base.weather(spark, d).withColumn("dew_point", wx.dew_point(F.col("temperature"), F.col("humidity"))), ["dew_point"])


_TF, _RH = "(temperature * 9.0 / 5.0 + 32.0)", "humidity"
_POWERS = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2)]  # of temperature and humidity, in the order of the coefficients
_HEAT = " + ".join(f"({k}::DOUBLE) * power({_TF}, {a}) * power({_RH}, {b})" for (a, b), k in zip(_POWERS, wx.HEAT_INDEX, strict=True))


@query("f13_heat_index", "weather", _wx_sql({"heat_index": f"(({_HEAT}) - 32.0) * 5.0 / 9.0"}), "heat_index", "h", 4)
def f13(spark, d):
    return _by_key(base.weather(spark, d).withColumn("heat_index", wx.heat_index(F.col("temperature"), F.col("humidity"))), ["heat_index"])


@query(
    "f14_comfort", "weather",
    _wx_sql({
        "comfort_index": "temperature - (0.55 - 0.0055 * humidity) * (temperature - 14.5)",
        "effective_temperature": "temperature - 0.4 * (temperature - 10) * (1 - humidity / 100)", "temp_humidity_ratio": "temperature / (humidity + 1)",
    }),
    "comfort_index effective_temperature temp_humidity_ratio", "h",
)
def f14(spark, d):
    cols = wx.comfort_columns(F.col("temperature"), F.col("humidity"))
    return _by_key(base.weather(spark, d).withColumns(cols), list(cols))


@query("f15_wind_chill", "weather", _wx_sql({"wind_chill": "13.12 + 0.6215 * temperature - 11.37 * power(wind_speed, 0.16) + 0.3965 * temperature * power(wind_speed, 0.16)"}), "wind_chill", "h")
def f15(spark, d):
    return _by_key(base.weather(spark, d).withColumn("wind_chill", wx.wind_chill(F.col("temperature"), F.col("wind_speed"))), ["wind_chill"])


@query("f16_weather_indices", "weather", _wx_sql({"pressure_relative": "pressure - 1013.25", "solar_proxy": "100 - cloud_cover", "precip_temp_index": "precipitation * (1 + temperature / 100)"}), "pressure_relative solar_proxy precip_temp_index", "h")
def f16(spark, d):
    return _by_key(wx.weather_derived(base.weather(spark, d)), ["pressure_relative", "solar_proxy", "precip_temp_index"])


@query(
    "f17_interactions", "weather",
    "SELECT region, hour(timestamp) AS h, sum(temperature * (isodow(timestamp) >= 6)::INT) AS temp_x_weekend, sum(hour(timestamp) * (isodow(timestamp) - 1)) AS hour_x_dow,"
    " sum(temperature * hour(timestamp)) AS temp_x_hour, sum(wind_speed * hour(timestamp)) AS wind_x_hour FROM weather GROUP BY 1, 2", "temp_x_weekend temp_x_hour wind_x_hour", "h hour_x_dow", 4,
)
def f17(spark, d):
    rows = features.interaction_features(calendars.temporal_features(base.weather(spark, d)))
    return rows.groupBy("region", F.hour("timestamp").alias("h")).agg(*[F.sum(c).alias(c) for c in ("temp_x_weekend", "hour_x_dow", "temp_x_hour", "wind_x_hour")])


_HS = "CASE WHEN hour(timestamp) BETWEEN 8 AND 19 THEN 1.15::DOUBLE WHEN hour(timestamp) IN (6, 7, 20, 21) THEN 1.0 ELSE 0.85 END"


@query("f18_hour_scale", "ehourly", f"SELECT timestamp, region, {_HS} AS scale FROM ehourly", "scale")
def f18(spark, d):
    return base.event_hourly(spark, d).select("timestamp", "region", intervals.hour_scale(F.hour("timestamp")).alias("scale"))


_RS = "CASE region " + " ".join(f"WHEN '{r}' THEN {v}::DOUBLE" for r, v in intervals.REGION_SCALES.items()) + " ELSE 1.0 END"


@query("f19_half_width", "weather", f"SELECT region, hour(timestamp) AS h, avg(CASE WHEN humidity > 50 THEN 30.0::DOUBLE ELSE 1.645 * 20.0 END * {_RS} * {_HS}) AS w FROM weather GROUP BY 1, 2", "w", "h")
def f19(spark, d):
    rows = base.weather(spark, d).withColumn("q", F.when(F.col("humidity") > 50, F.lit(30.0)))
    return _by_key(rows.withColumn("w", intervals.half_width(F.col("q"), F.lit(20.0), F.col("region"), F.hour("timestamp"))), ["w"])


@query("f20_intervals", "predicted", f"SELECT timestamp, region, greatest(0.0, y_pred - w) AS ci_lower, y_pred + w AS ci_upper, y_pred - w < 0 AS ci_lower_clipped FROM (SELECT *, 30.0 * {_RS} * {_HS} AS w FROM predicted WHERE y_pred IS NOT NULL)", "ci_lower ci_upper")
def f20(spark, d):
    rows = base.predicted(spark, d).filter("y_pred IS NOT NULL").withColumns({"q90": F.lit(30.0), "rmse": F.lit(20.0)})
    return intervals.prediction_intervals(rows).select("timestamp", "region", "ci_lower", "ci_upper", "ci_lower_clipped")


@query("f21_special_days")
def f21(spark, d):
    return calendars.special_days(_years(spark, d))


SPECIAL = (
    HOLIDAYS + ", bridges AS (SELECT DISTINCT CASE WHEN isodow(date) = 5 THEN date + 3 ELSE date - 3 END AS date FROM holidays WHERE isodow(date) IN (1, 5)),"
    " special AS (SELECT DISTINCT date, kind AS category FROM (SELECT * FROM fixed UNION ALL SELECT * FROM moved)"
    " UNION ALL SELECT date, 'bridge' FROM bridges WHERE date NOT IN (SELECT date FROM holidays))"
)
base.ORACLES["f21_special_days"] = with_sql("", SPECIAL, "SELECT date, category FROM special")

W = "WINDOW w AS (PARTITION BY region ORDER BY timestamp)"


@query("w1_lags", "series", "SELECT *, " + ", ".join(f"lag(consumption_mw, {k}) OVER w AS consumption_mw_lag_{k}" for k in s.LAGS) + f" FROM series {W}")
def w1(spark, d):
    return s.lag_features(base.series(spark, d))


_ROLL = {
    f"consumption_mw_rolling_{n}_{k}": f"{f}(consumption_mw) OVER (PARTITION BY region ORDER BY timestamp ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    for k in s.WINDOWS for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
}


@query("w2_rolling", "series", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _ROLL.items()) + " FROM series", " ".join(_ROLL))
def w2(spark, d):
    return s.rolling_features(base.series(spark, d))


@query("w2_rolling_chunked", "series", "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _ROLL.items()) + " FROM series", " ".join(_ROLL), digits=7)
def w2c(spark, d):
    return s.chunked(base.series(spark, d), lambda w: s.rolling_columns(w=w), max(s.WINDOWS), 256)


def _ewma_sql(k: int) -> str:
    # sums of powers over all earlier rows
    q = 1 - 2 / (k + 1)
    return f"sum(b.consumption_mw * power({q}::DOUBLE, a.i - b.i)) / sum(power({q}::DOUBLE, a.i - b.i)) AS consumption_mw_ewma_{k}"


@query(
    "w3_ewma", "ehourly",
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY timestamp) AS i FROM ehourly) SELECT a.timestamp, a.region, a.consumption_mw, "
    + ", ".join(_ewma_sql(k) for k in s.SPANS) + " FROM n a LEFT JOIN n b ON a.region = b.region AND b.i < a.i GROUP BY 1, 2, 3",
    "consumption_mw " + " ".join(f"consumption_mw_ewma_{k}" for k in s.SPANS), digits=7,  # means of two values may end in a 5 behind six digits
)
def w3(spark, d):
    return s.ewma_features(base.event_hourly(spark, d)).select("timestamp", "region", "consumption_mw", *[f"consumption_mw_ewma_{k}" for k in s.SPANS])


@query(
    "w4_diffs", "series",
    "SELECT *, lag(consumption_mw, 1) OVER w - lag(consumption_mw, 2) OVER w AS consumption_mw_diff_1, lag(consumption_mw, 1) OVER w - lag(consumption_mw, 25) OVER w AS consumption_mw_diff_24,"
    " max(consumption_mw) OVER f - min(consumption_mw) OVER f AS consumption_mw_range_24 FROM series WINDOW w AS (PARTITION BY region ORDER BY timestamp),"
    " f AS (PARTITION BY region ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)", "consumption_mw_diff_1 consumption_mw_diff_24 consumption_mw_range_24",
)
def w4(spark, d):
    return s.diff_features(base.series(spark, d))


@query(
    "w5_trends", "sweather",
    "SELECT timestamp, region, temperature - lag(temperature) OVER w AS temp_diff_1h, temperature - 2 * lag(temperature) OVER w + lag(temperature, 2) OVER w AS temp_diff2_1h,"
    " (temperature / nullif(lag(temperature, 3) OVER w, 0) - 1) * 100 AS temp_momentum, temperature - avg(temperature) OVER d AS temp_deviation_24h, stddev_samp(temperature) OVER h AS temp_volatility_12h,"
    " humidity - lag(humidity) OVER w AS humidity_diff_1h, wind_speed - lag(wind_speed) OVER w AS wind_diff_1h, (wind_speed / nullif(lag(wind_speed, 3) OVER w, 0) - 1) * 100 AS wind_momentum,"
    " stddev_samp(wind_speed) OVER h AS wind_volatility_12h, pressure - lag(pressure) OVER w AS pressure_diff_1h FROM sweather"
    " WINDOW w AS (PARTITION BY region ORDER BY timestamp), d AS (PARTITION BY region ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),"
    " h AS (PARTITION BY region ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
    "temp_diff_1h temp_diff2_1h temp_momentum temp_deviation_24h temp_volatility_12h humidity_diff_1h wind_diff_1h wind_momentum wind_volatility_12h pressure_diff_1h", "", 4,
)
def w5(spark, d):
    rows = base.series_weather(spark, d)
    return rows.select("timestamp", "region", *[c.alias(n) for n, c in s.trend_columns(rows.columns).items()])


@query("w6_horizons", "series", "SELECT * FROM (SELECT *, " + ", ".join(f"lead(consumption_mw, {h}) OVER w AS target_{h}h" for h in s.HORIZONS) + f" FROM series {W}) WHERE target_24h IS NOT NULL")
def w6(spark, d):
    return s.horizon_targets(base.series(spark, d))


BASELINES_SQL = (
    "SELECT *, lag(consumption_mw) OVER w AS persistence, lag(consumption_mw, 24) OVER w AS seasonal_24, lag(consumption_mw, 168) OVER w AS seasonal_168,"
    " avg(consumption_mw) OVER (PARTITION BY region ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS moving_average_24,"
    f" avg(consumption_mw) OVER (PARTITION BY region ORDER BY timestamp ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS moving_average_168 FROM ehourly {W}"
)


@query("w7_baselines", "ehourly", BASELINES_SQL, "consumption_mw persistence seasonal_24 seasonal_168 moving_average_24 moving_average_168")
def w7(spark, d):
    return s.baseline_forecasts(base.event_hourly(spark, d))


@query(
    "w8_baseline_multistep", "ehourly",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY timestamp DESC) AS r FROM ehourly), st AS (SELECT unnest(range(1, 49)) AS step),"
    " m AS (SELECT region, max(consumption_mw) FILTER (r = 1) AS persistence, avg(consumption_mw) FILTER (r <= 24) AS moving_average_24, avg(consumption_mw) FILTER (r <= 168) AS moving_average_168 FROM r GROUP BY 1)"
    " SELECT m.region, step, persistence, a.consumption_mw AS seasonal_24, b.consumption_mw AS seasonal_168, moving_average_24, moving_average_168 FROM m, st"
    " JOIN r a ON a.region = m.region AND a.r = 24 - (step - 1) % 24 JOIN r b ON b.region = m.region AND b.r = 168 - (step - 1) % 168",
    "persistence seasonal_24 seasonal_168 moving_average_24 moving_average_168", "step",
)
def w8(spark, d):
    return s.baseline_multistep(base.event_hourly(spark, d), 48)


_DEC = (
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY timestamp) - 1 AS i FROM ehourly),"
    " t AS (SELECT *, CASE WHEN lag(consumption_mw, 12) OVER w IS NOT NULL AND lead(consumption_mw, 12) OVER w IS NOT NULL THEN (sum(consumption_mw) OVER f"
    " + (lag(consumption_mw, 12) OVER w + lead(consumption_mw, 12) OVER w) / 2) / 24 END AS trend FROM n WINDOW w AS (PARTITION BY region ORDER BY timestamp),"
    " f AS (PARTITION BY region ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)),"
    " p AS (SELECT region, i % 24 AS ph, avg(consumption_mw - trend) AS m FROM t GROUP BY 1, 2), c AS (SELECT region, ph, m - avg(m) OVER (PARTITION BY region) AS seasonal FROM p)"
    " SELECT t.timestamp, t.region, t.consumption_mw, t.trend, c.seasonal, t.consumption_mw - t.trend - c.seasonal AS residual FROM t JOIN c ON t.region = c.region AND t.i % 24 = c.ph"
)


@query("w13_decompose", "ehourly", _DEC, "consumption_mw trend seasonal residual")
def w13(spark, d):
    return s.seasonal_decompose(base.event_hourly(spark, d)).select("timestamp", "region", "consumption_mw", "trend", "seasonal", "residual")


@query("w13_explained", "ehourly", f"SELECT region, 1 - var_pop(residual) / var_pop(consumption_mw) AS explained FROM ({_DEC}) WHERE residual IS NOT NULL GROUP BY 1", "explained")
def w13e(spark, d):
    return s.explained_variance(s.seasonal_decompose(base.event_hourly(spark, d)))


_IDX = "SELECT *, row_number() OVER (ORDER BY timestamp, region) - 1 AS i, count(*) OVER () AS n FROM ehourly"


@query("w14_split", "ehourly", f"SELECT timestamp, region, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM ({_IDX})")
def w14(spark, d):
    return splits.temporal_split(base.event_hourly(spark, d)).select("timestamp", "region", "split")


@query(
    "w15_folds_expanding", "ehourly",
    f"SELECT fold, CASE WHEN i < n - (5 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS role, count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last"
    f" FROM ({_IDX}), (SELECT unnest(range(0, 5)) AS fold) WHERE i < n - (4 - fold) * (n // 6) GROUP BY 1, 2", "", "fold rows",
)
def w15(spark, d):
    return splits.cv_folds(base.event_hourly(spark, d), 5).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query(
    "w15_folds_walk_forward", "ehourly",
    f"SELECT fold, CASE WHEN i < fold * st + wd THEN 'train' ELSE 'test' END AS role, count(*) AS rows FROM (SELECT *, floor(n * 0.6)::BIGINT AS wd, (n - floor(n * 0.6)::BIGINT) // 5 AS st FROM ({_IDX})),"
    " (SELECT unnest(range(0, 5)) AS fold) WHERE i >= fold * st AND i < least(fold * st + wd + st, n) GROUP BY 1, 2", "", "fold rows",
)
def w15w(spark, d):
    return splits.cv_folds(base.event_hourly(spark, d), 5, "walk-forward").groupBy("fold", "role").agg(F.count("*").alias("rows"))


@query("m20_features_no_lags")
def m20n(spark, d):
    return features.features_no_lags(base.weather(spark, d))


@query("m20_features_full")
def m20f(spark, d):
    return features.features_full(base.series_weather(spark, d), advanced=True)


_P14 = "SELECT count(*) AS n, count(consumption_mw_lag_48) AS n_lag FROM (SELECT *, lag(consumption_mw, 48) OVER w AS consumption_mw_lag_48 FROM ehourly WINDOW w AS (PARTITION BY region ORDER BY timestamp)) WHERE consumption_mw_lag_48 IS NOT NULL"


@query("p15_drop_warmup", "ehourly", _P14, "", "n n_lag")
def p15(spark, d):
    rows = features.drop_warmup(s.lag_features(base.event_hourly(spark, d)))
    return rows.agg(F.count("*").alias("n"), F.count("consumption_mw_lag_48").alias("n_lag"))


@query("p14_feature_columns", "ehourly", "SELECT unnest(['consumption_mw_lag_1', 'consumption_mw_lag_24', 'day_of_month', 'day_of_week', 'hour', 'is_business_hour', 'is_weekend', 'month', 'quarter', 'week_of_year', 'day_of_year', 'day_cos', 'day_sin', 'day_of_year_cos', 'day_of_year_sin', 'hour_cos', 'hour_sin', 'month_cos', 'month_sin']) AS feature, (SELECT count(*) FROM ehourly) AS n", "", "n")
def p14(spark, d):
    rows = calendars.add_aliases(calendars.temporal_features(s.lag_features(base.event_hourly(spark, d), [1, 24])))
    names = features.feature_columns(rows)
    return rows.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n")


