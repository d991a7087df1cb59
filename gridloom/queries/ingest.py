"""Queries of sources, ingest, validation and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.regions import REGIONS, add_region_coords, map_region, one_hot_region, postal_code, region_lookup
from gridloom.functions.weather import inject_weather_defaults, winsorize
from gridloom.operators import ingest, quality
from gridloom.queries import base
from gridloom.queries.base import query
from gridloom.queries.base import scratch as _scratch
from gridloom.sources import tables


@query("io1_readings", "readings", "SELECT count(*) AS n, sum(consumo) AS total, min(datahora) AS first FROM readings", "total", "n", 3)
def io1(spark, d):
    path = _scratch(spark, "readings")
    base.readings(spark, d).withColumn("datahora", F.col("datahora").cast("string")).write.parquet(path)
    return tables.read_readings(spark, path).agg(F.count("*").alias("n"), F.sum("consumo").alias("total"), F.min("datahora").alias("first"))


@query("io2_weather", "weather", "SELECT region, count(*) AS n, min(timestamp) AS first, max(temperature) AS hottest FROM weather GROUP BY 1", "hottest", "n")
def io2(spark, d):
    path = _scratch(spark, "weather")
    base.weather(spark, d).write.parquet(path)
    return tables.read_weather(spark, path).groupBy("region").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("temperature").alias("hottest"))


@query("io3_flatten_payload", "ehourly", "SELECT region, timestamp, consumption_mw AS temperature FROM ehourly", "temperature")
def io3(spark, d):
    rows = base.event_hourly(spark, d)
    day = rows.groupBy("region", F.to_date("timestamp").alias("_day")).agg(  # a day of hours for each payload
        F.array_sort(F.collect_list(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("t"), "consumption_mw"))).alias("_h")
    )
    payload = F.to_json(F.struct(F.struct(F.col("_h.t").alias("time"), F.col("_h.consumption_mw").alias("temperature_2m")).alias("hourly")))
    return tables.flatten_hourly_payload(day.select("region", payload.alias("payload"))).select("region", "timestamp", "temperature")


@query("io4_stack_regions", "ehourly", "SELECT region, count(*) AS n, sum(consumption_mw) AS total FROM ehourly GROUP BY 1", "total", "n", 4)
def io4(spark, d):
    rows = base.event_hourly(spark, d)
    parts = [rows.filter(F.col("region") == r) for r in ("click", "error", "purchase", "signup", "view")]
    return tables.stack_regions(parts).groupBy("region").agg(F.count("*").alias("n"), F.sum("consumption_mw").alias("total"))


@query("io7_write_table", "ehourly", "SELECT region, count(*) AS n FROM ehourly GROUP BY 1", "", "n")
def io7(spark, d):
    path = _scratch(spark, "table")
    tables.write_table(base.event_hourly(spark, d), path, ["region"], ["timestamp"])
    return spark.read.parquet(path).groupBy("region").agg(F.count("*").alias("n"))


@query("io8_write_report", "ehourly", "SELECT region, count(*) AS n, avg(consumption_mw) AS mean FROM ehourly GROUP BY 1", "mean", "n")
def io8(spark, d):
    path = _scratch(spark, "report")
    rows = base.event_hourly(spark, d).groupBy("region").agg(F.avg("consumption_mw").alias("mean"), F.count("*").alias("n"))
    tables.write_report(rows, path, ["region", "n"])
    return spark.read.schema("region string, n long, mean double").option("header", True).csv(path)


@query("io9_write_json", "ehourly", "SELECT region, max(consumption_mw) AS greatest FROM ehourly GROUP BY 1", "greatest")
def io9(spark, d):
    path = _scratch(spark, "json")
    tables.write_json_report(base.event_hourly(spark, d).groupBy("region").agg(F.max("consumption_mw").alias("greatest")), path)
    return spark.read.schema("region string, greatest double").json(path)


@query("p1_postal_code", "readings", "SELECT codigo_postal, CASE WHEN cast(codigo_postal AS INT) BETWEEN 1000 AND 8999 THEN cast(codigo_postal AS INT) END AS code, count(*) AS n FROM readings GROUP BY 1, 2", "", "code n")
def p1(spark, d):
    return base.readings(spark, d).groupBy("codigo_postal", postal_code(F.col("codigo_postal")).alias("code")).agg(F.count("*").alias("n"))


@query("p2_clean_readings", "mapped", "SELECT datahora, codigo_postal, region, consumo FROM mapped WHERE region IS NOT NULL AND consumo >= 0 AND consumo < 100000", "consumo")
def p2(spark, d):
    return ingest.clean_readings(map_region(base.readings(spark, d))).select("datahora", "codigo_postal", "region", "consumo")


@query(
    "p3_ingest_quality", "mapped",
    "SELECT count(*) AS n_rows, count(*) FILTER (region IS NULL) AS n_unmapped, count(DISTINCT codigo_postal) FILTER (region IS NULL) AS n_unmapped_codes,"
    " count(*) FILTER (region IS NOT NULL AND NOT (consumo >= 0 AND consumo < 100000)) AS n_anomalous FROM mapped", "", "n_rows n_unmapped n_unmapped_codes n_anomalous",
)
def p3(spark, d):
    return ingest.ingest_quality(map_region(base.readings(spark, d)))


@query("p4_kwh_to_mw", "readings", "SELECT datahora, consumo / 1000 AS mw FROM readings", "mw")
def p4(spark, d):
    return base.readings(spark, d).select("datahora", ingest.kwh_to_mw(F.col("consumo")).alias("mw"))


_SHIFT = "SELECT humidity + 5 AS humidity, temperature + 20 AS temperature, wind_speed, precipitation, pressure - 62 AS pressure, cloud_cover FROM weather"


def _shifted(spark, d):
    w = base.weather(spark, d)
    return w.withColumns({"humidity": F.col("humidity") + 5, "temperature": F.col("temperature") + 20, "pressure": F.col("pressure") - 62})


def _rule_sql(rules):
    parts = []
    for c, (lo, hi) in rules.items():
        cond = " OR ".join(x for x in (f"{c} < {lo}" if lo is not None else "", f"{c} > {hi}" if hi is not None else "") if x)
        parts.append((c, cond))
    return parts


@query(
    "p5_weather_violations", "weather",
    " UNION ALL ".join(f"SELECT '{c}' AS rule, count(*) FILTER ({b}) AS n_bad, min({c}) FILTER ({b}) AS least, max({c}) FILTER ({b}) AS greatest FROM ({_SHIFT})" for c, b in _rule_sql(quality.HARD)),
    "least greatest", "n_bad",
)
def p5(spark, d):
    return quality.weather_violations(_shifted(spark, d))


@query("p6_weather_warnings", "weather", " UNION ALL ".join(f"SELECT '{c}' AS rule, count(*) FILTER ({b}) AS n_bad FROM ({_SHIFT})" for c, b in _rule_sql(quality.SOFT)), "", "n_bad")
def p6(spark, d):
    return quality.weather_warnings(_shifted(spark, d))


_WINSOR = (
    "SELECT region, avg(greatest(-10, least(45, temperature))) AS temperature, avg(greatest(5, least(100, humidity))) AS humidity,"
    " avg(greatest(0, least(120, wind_speed))) AS wind_speed, avg(greatest(960, least(1050, pressure))) AS pressure FROM ({}) GROUP BY 1"
)


@query("p7_winsorize", "weather", _WINSOR.format("SELECT region, temperature + 20 AS temperature, humidity + 5 AS humidity, wind_speed, pressure - 62 AS pressure FROM weather"), "temperature humidity wind_speed pressure")
def p7(spark, d):
    return winsorize(_shifted(spark, d)).groupBy("region").agg(*[F.avg(c).alias(c) for c in ("temperature", "humidity", "wind_speed", "pressure")])


@query(
    "p8_validate_features", "weather",
    "SELECT region, sum(least(100, greatest(0, humidity + 5))) AS humidity, count(*) FILTER (temperature <> 0) AS n_ratio FROM weather GROUP BY 1", "humidity", "n_ratio", 3,
)
def p8(spark, d):
    rows = _shifted(spark, d).select("region", "humidity", (F.col("temperature") - 20).alias("t"))
    rows = rows.withColumn("ratio", F.when(F.col("t") == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), F.col("t"))))
    return quality.validate_features(rows).groupBy("region").agg(F.sum("humidity").alias("humidity"), F.count("ratio").alias("n_ratio"))


@query("p8_feature_violations", "weather", "SELECT 'bounds:' || c AS rule, n AS n_bad FROM (SELECT 'humidity' AS c, count(*) FILTER (humidity + 5 > 100) AS n FROM weather UNION ALL SELECT 'cloud_cover', 0)", "", "n_bad")
def p8b(spark, d):
    return quality.feature_violations(_shifted(spark, d)).filter("rule LIKE 'bounds:%'")


_REGION_OK = "region IN (" + ", ".join(f"'{r}'" for r in REGIONS) + ")"


@query(
    "p9_validate_records", "mapped",
    f"SELECT CASE WHEN region IS NULL OR NOT ({_REGION_OK}) THEN 'region' ELSE '' END || CASE WHEN consumo < 0 THEN ',consumption_mw' ELSE '' END AS reasons, count(*) AS n FROM mapped GROUP BY 1", "", "n",
)
def p9(spark, d):
    rows = map_region(base.readings(spark, d)).select(F.col("datahora").alias("timestamp"), "region", F.col("consumo").alias("consumption_mw"))
    good, bad = quality.validate_records(rows)
    reasons = F.concat(F.when(F.array_contains("reasons", "region"), "region").otherwise(""), F.when(F.array_contains("reasons", "consumption_mw"), ",consumption_mw").otherwise(""))
    both = bad.select(reasons.alias("reasons")).unionAll(good.select(F.lit("").alias("reasons")))
    return both.groupBy("reasons").agg(F.count("*").alias("n"))


@query("p10_fill_defaults", "weather", "SELECT count(*) AS n, sum(CASE WHEN humidity > 50 THEN humidity ELSE 70 END) AS humidity, sum(1013.0::DOUBLE) AS pressure FROM weather", "humidity pressure", "n", 3)
def p10(spark, d):
    rows = base.weather(spark, d).withColumn("humidity", F.when(F.col("humidity") > 50, F.col("humidity"))).drop("pressure")
    return quality.fill_weather_defaults(rows).agg(F.count("*").alias("n"), F.sum("humidity").alias("humidity"), F.sum("pressure").alias("pressure"))


DEW = (
    "(WITH g AS (SELECT *, ln(greatest(1.0, least(100.0, humidity)) / 100.0) + 17.62 * temperature / (243.12 + temperature) AS gamma FROM {0})"
    " SELECT *, least(temperature, greatest(-80.0, 243.12 * gamma / (17.62 - gamma))) AS dew_point FROM g)"
)


@query(
    "p11_inject_defaults", "weather",
    "SELECT region, avg(dew_point) AS dew_point, min(180.0::DOUBLE) AS wind_direction,"
    " avg(greatest(0, 900 * sin(pi() * greatest(0, least(12, hour(timestamp) - 6)) / 12) * (1 - cloud_cover / 100))) AS solar_radiation FROM "
    + DEW.format("weather") + " GROUP BY 1", "dew_point wind_direction solar_radiation",
)
def p11(spark, d):
    rows = inject_weather_defaults(base.weather(spark, d))
    return rows.groupBy("region").agg(*[F.avg(c).alias(c) for c in ("dew_point", "wind_direction", "solar_radiation")])


@query("p12_region_coords", "hourly", "SELECT region, count(*) AS n, CASE region WHEN 'Alentejo' THEN 38.5::DOUBLE WHEN 'Algarve' THEN 37.1 WHEN 'Centro' THEN 40.2 WHEN 'Lisboa' THEN 38.7 ELSE 41.5 END AS latitude, CASE region WHEN 'Alentejo' THEN -7.9::DOUBLE WHEN 'Algarve' THEN -8.0 WHEN 'Centro' THEN -8.4 WHEN 'Lisboa' THEN -9.1 ELSE -8.4 END AS longitude FROM hourly GROUP BY 1", "latitude longitude", "n")
def p12(spark, d):
    rows = ingest.regional_hourly(base.readings(spark, d)).withColumn("temperature", F.lit(None).cast("double"))
    return add_region_coords(rows).groupBy("region", "latitude", "longitude").agg(F.count("*").alias("n"))


@query("p13_one_hot", "hourly", "SELECT " + ", ".join(f"count(*) FILTER (region = '{r}') AS region_{r}" for r in REGIONS) + " FROM hourly", "", " ".join(f"region_{r}" for r in REGIONS))
def p13(spark, d):
    rows = one_hot_region(ingest.regional_hourly(base.readings(spark, d)))
    return rows.agg(*[F.sum(f"region_{r}").alias(f"region_{r}") for r in REGIONS])


@query("p16_ground_truth", "mapped", "SELECT count(*) AS n FROM mapped WHERE region IS NOT NULL AND consumo >= 0", "", "n")
def p16(spark, d):
    rows = map_region(base.readings(spark, d)).select(F.col("datahora").alias("timestamp"), "region", F.col("consumo").alias("actual"))
    return quality.validate_ground_truth(rows).agg(F.count("*").alias("n"))


@query("p17_valid_predictions", "readings", "SELECT consumo >= 0 AS valid, count(*) AS n FROM readings GROUP BY 1", "", "n")
def p17(spark, d):
    return base.readings(spark, d).groupBy(quality.valid_prediction(F.col("consumo")).alias("valid")).agg(F.count("*").alias("n"))


@query("j1_map_region", "mapped", "SELECT region, count(*) AS n, count(DISTINCT codigo_postal) AS n_codes FROM mapped GROUP BY 1", "", "n n_codes")
def j1(spark, d):
    return map_region(base.readings(spark, d)).groupBy("region").agg(F.count("*").alias("n"), F.count_distinct("codigo_postal").alias("n_codes"))


@query("j2_region_lookup", "ranges readings", "SELECT c.code, r.region, count(x.codigo_postal) AS n FROM (SELECT unnest(range(1000, 9000)) AS code) c JOIN ranges r ON c.code BETWEEN r.a AND r.b LEFT JOIN readings x ON cast(x.codigo_postal AS INT) = c.code GROUP BY 1, 2", "", "code n")
def j2(spark, d):
    seen = base.readings(spark, d).groupBy(postal_code(F.col("codigo_postal")).alias("code")).agg(F.count("*").alias("n"))
    return region_lookup(spark).join(seen, "code", "left").select("code", "region", F.coalesce("n", F.lit(0)).alias("n"))


@query("j3_build_dataset", "hourly sweather", "SELECT h.timestamp, h.region, h.consumption_mw, w.temperature, year(h.timestamp) AS year FROM hourly h JOIN (SELECT timestamp, temperature FROM sweather WHERE region = 'view') w USING (timestamp)", "consumption_mw temperature", "year")
def j3(spark, d):
    w = base.series_weather(spark, d).filter("region = 'view'").select("timestamp", "temperature")
    w = w.withColumn("region", F.explode(F.array(*[F.lit(r) for r in REGIONS])))
    return ingest.build_dataset(ingest.regional_hourly(base.readings(spark, d)), w).select("timestamp", "region", "consumption_mw", "temperature", "year")


_SHARES = (
    "SELECT (isodow(timestamp) - 1) * 24 + hour(timestamp) AS hour_of_week, region, avg(consumption_mw / total) AS share FROM"
    " (SELECT *, sum(consumption_mw) OVER (PARTITION BY timestamp) AS total FROM ehourly) GROUP BY 1, 2"
)


@query("a3_regional_shares", "ehourly", _SHARES, "share", "hour_of_week")
def a3(spark, d):
    return ingest.regional_shares(base.event_hourly(spark, d))


@query("j4_disaggregate", "ehourly", f"SELECT n.timestamp, s.region, n.total_mw * s.share AS consumption_mw FROM (SELECT timestamp, sum(consumption_mw) AS total_mw FROM ehourly GROUP BY 1) n LEFT JOIN ({_SHARES}) s ON (isodow(n.timestamp) - 1) * 24 + hour(n.timestamp) = s.hour_of_week", "consumption_mw")
def j4(spark, d):
    rows = base.event_hourly(spark, d)
    national = rows.groupBy("timestamp").agg(F.sum("consumption_mw").alias("total_mw"))
    return ingest.disaggregate(national, ingest.regional_shares(rows)).select("timestamp", "region", "consumption_mw")


@query("j5_missing_hours", "hourly", "SELECT region, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp FROM (SELECT region, min(timestamp) AS a, max(timestamp) AS b FROM hourly GROUP BY 1) EXCEPT SELECT region, timestamp FROM hourly")
def j5(spark, d):
    return ingest.missing_hours(ingest.regional_hourly(base.readings(spark, d)), by_region=True).select("region", "timestamp")


@query("a1_regional_hourly", "hourly", "SELECT * FROM hourly", "consumption_mw")
def a1(spark, d):
    return ingest.regional_hourly(base.readings(spark, d))


_QUARTER = "SELECT date_trunc('hour', ts) + INTERVAL 15 MINUTE * (event_id % 4) AS datahora, value AS bt, value * 2 AS total FROM events"


@query("a2_hourly_from_quarters", "", f"SELECT date_trunc('hour', datahora) AS timestamp, sum(bt) / 1000 AS bt_mw, sum(total) / 1000 AS total_mw FROM ({_QUARTER}) GROUP BY 1 HAVING count(bt) = 4", "bt_mw total_mw")
def a2(spark, d):
    e = base.table(spark, d, "events")
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(15 * (event_id % 4) AS int))")
    q = e.select(at.cast("timestamp_ntz").alias("datahora"), F.col("value").alias("bt"), (F.col("value") * 2).alias("total"))
    return ingest.hourly_from_quarters(q, columns=("bt", "total"))


@query(
    "a4_region_stats", "hourly",
    "SELECT region, count(*) AS n, avg(consumption_mw) AS mean, stddev_samp(consumption_mw) AS std, min(consumption_mw) AS min, quantile_cont(consumption_mw, 0.01) AS p1,"
    " quantile_cont(consumption_mw, 0.5) AS p50, quantile_cont(consumption_mw, 0.99) AS p99, max(consumption_mw) AS max FROM hourly GROUP BY 1", "mean std min p1 p50 p99 max", "n",
)
def a4(spark, d):
    return quality.region_stats(ingest.regional_hourly(base.readings(spark, d)))


@query(
    "a5_coverage_report", "hourly",
    "SELECT *, n_hours * 100.0 / expected_hours AS coverage_pct FROM (SELECT count(*) AS n_rows, min(timestamp) AS first, max(timestamp) AS last, count(DISTINCT timestamp) AS n_hours,"
    " count(DISTINCT region) AS n_regions, floor(epoch(max(timestamp) - min(timestamp)) / 3600 + 1) AS expected_hours FROM hourly)", "coverage_pct", "n_rows n_hours n_regions expected_hours",
)
def a5(spark, d):
    return quality.coverage_report(ingest.regional_hourly(base.readings(spark, d)))


@query(
    "a6_national_report", "ehourly",
    "SELECT count(*) AS n_hours, quantile_cont(t, 0.01) AS p1, quantile_cont(t, 0.05) AS p5, quantile_cont(t, 0.5) AS p50, quantile_cont(t, 0.95) AS p95, quantile_cont(t, 0.99) AS p99,"
    " count(*) FILTER (t < 200) AS n_low, min(timestamp) FILTER (t < 200) AS first_low, count(*) FILTER (t < 200) * 100.0 / count(*) AS low_pct"
    " FROM (SELECT timestamp, sum(consumption_mw) AS t FROM ehourly GROUP BY 1)", "p1 p5 p50 p95 p99 low_pct", "n_hours n_low",
)
def a6(spark, d):
    return quality.national_report(base.event_hourly(spark, d), 200.0)


@query("a7_weather_sanity", "weather", " UNION ALL ".join(f"SELECT '{c}' AS variable, avg({c}) AS mean, min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} IS NULL) AS n_null FROM weather" for c in quality.WEATHER), "mean min max", "n_null")
def a7(spark, d):
    return quality.weather_sanity(base.weather(spark, d))


@query(
    "a17_outliers_iqr", "series",
    "SELECT timestamp, region, consumption_mw FROM series, (SELECT quantile_cont(consumption_mw, 0.25) AS a, quantile_cont(consumption_mw, 0.75) AS b FROM series)"
    " WHERE consumption_mw < a - 1.5 * (b - a) OR consumption_mw > b + 1.5 * (b - a)", "consumption_mw",
)
def a17(spark, d):
    return quality.outliers(base.series(spark, d), "consumption_mw")


@query("a17_outliers_z", "series", "SELECT timestamp, region, consumption_mw FROM series, (SELECT avg(consumption_mw) AS m, stddev_pop(consumption_mw) AS s FROM series) WHERE abs(consumption_mw - m) > 3 * s", "consumption_mw")
def a17z(spark, d):
    return quality.outliers(base.series(spark, d), "consumption_mw", "z")


@query(
    "a18_box_stats", "series",
    "SELECT region, min(consumption_mw) AS least, quantile_cont(consumption_mw, 0.25) AS q25, quantile_cont(consumption_mw, 0.5) AS median, quantile_cont(consumption_mw, 0.75) AS q75,"
    " max(consumption_mw) AS greatest, count(*) AS n FROM series GROUP BY 1", "least q25 median q75 greatest", "n",
)
def a18(spark, d):
    return quality.box_stats(base.series(spark, d), "consumption_mw", ["region"])


_FEATURES = ["temperature", "humidity", "wind_speed", "consumption_mw"]
_OUT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{m}' AS method, lo, hi, count(*) AS n, count(*) FILTER (v < lo) AS n_below, count(*) FILTER (v > hi) AS n_above, count(*) FILTER (v < lo OR v > hi) * 100.0 / count(*) AS pct"
    f" FROM (SELECT {c} AS v FROM weather), (SELECT {lo.format(c=c)} AS lo, {hi.format(c=c)} AS hi FROM weather) GROUP BY lo, hi"
    for c in _FEATURES
    for m, lo, hi in (
        ("iqr", "2.5 * quantile_cont({c}, 0.25) - 1.5 * quantile_cont({c}, 0.75)", "2.5 * quantile_cont({c}, 0.75) - 1.5 * quantile_cont({c}, 0.25)"),
        ("z", "avg({c}) - 3 * stddev_pop({c})", "avg({c}) + 3 * stddev_pop({c})"),
    )
)


_CODES = "SELECT date_trunc('day', datahora) AS day, codigo_postal, consumo FROM readings"


@query("g2_distinct_sketches", "readings", f"SELECT day, count(DISTINCT codigo_postal) AS codes, true AS near FROM ({_CODES}) GROUP BY GROUPING SETS ((), (day))", "", "codes")
def g2s(spark, d):
    rows = base.readings(spark, d).select("codigo_postal", F.date_trunc("hour", "datahora").alias("hour"), F.date_trunc("day", "datahora").cast("timestamp_ntz").alias("day"))
    hours = quality.distinct_sketches(rows, ["codigo_postal"], ["hour", "day"])
    merged = quality.distinct_counts(hours, ["day"]).unionByName(quality.distinct_counts(hours, []).withColumn("day", F.lit(None).cast("timestamp_ntz")))
    exact = rows.groupingSets([[], [F.col("day")]], F.col("day")).agg(F.count_distinct("codigo_postal").alias("codes"))
    met = merged.select(F.col("day").alias("_d"), "n_codigo_postal").join(exact, F.col("_d").eqNullSafe(F.col("day")))
    return met.select("day", "codes", (F.abs(F.col("n_codigo_postal") - F.col("codes")) <= 0.02 * F.col("codes")).alias("near"))


@query("a17_outlier_report", "weather", _OUT, "lo hi pct", "n n_below n_above", 5)
def a17r(spark, d):
    return quality.outlier_report(base.weather(spark, d), _FEATURES)


@query("a6_low_hours", "ehourly", "SELECT timestamp, sum(consumption_mw) AS total FROM ehourly GROUP BY 1 HAVING sum(consumption_mw) < 200 ORDER BY total, timestamp LIMIT 10", "total")
def a6l(spark, d):
    return quality.low_hours(base.event_hourly(spark, d), 200.0)


@query(
    "p5_weather_samples", "weather",
    " UNION ALL ".join(
        f"SELECT '{c}' AS rule, count(*) FILTER ({b}) AS n_bad, array_to_string(list_transform(list_sort(list_distinct(coalesce(list({c}::DOUBLE) FILTER ({b}), [])))[1:5], lambda x: printf('%.3f', x)), ' ') AS samples FROM ({_SHIFT})"
        for c, b in _rule_sql(quality.HARD)
    ), "", "n_bad",
)
def p5s(spark, d):
    found = quality.weather_samples(_shifted(spark, d))
    return found.select("rule", "n_bad", F.array_join(F.transform("samples", lambda x: F.format_string("%.3f", x)), " ").alias("samples"))


@query("a18_histogram", "series", "SELECT least(floor((consumption_mw - a) * 50 / (b - a)) + 1, 50) AS bin, count(*) AS n FROM series, (SELECT min(consumption_mw) AS a, max(consumption_mw) AS b FROM series) GROUP BY 1", "", "bin n")
def a18h(spark, d):
    return quality.histogram(base.series(spark, d), "consumption_mw", 50)


@query("a29_fingerprint")
def a29(spark, d):
    return quality.fingerprint(base.series(spark, d))


@query("g1_set_operations", "hourly", "SELECT timestamp FROM hourly WHERE region = 'Norte' EXCEPT SELECT timestamp FROM hourly WHERE region = 'Lisboa'")
def g1(spark, d):
    h = ingest.regional_hourly(base.readings(spark, d))
    return h.filter("region = 'Norte'").select("timestamp").exceptAll(h.filter("region = 'Lisboa'").select("timestamp")).distinct()


@query("g2_distinct_counts", "mapped", "SELECT count(DISTINCT codigo_postal) AS n_codes, count(DISTINCT date_trunc('hour', datahora)) AS n_hours, count(DISTINCT region) AS n_regions FROM mapped", "", "n_codes n_hours n_regions")
def g2(spark, d):
    m = map_region(base.readings(spark, d))
    return m.agg(F.count_distinct("codigo_postal").alias("n_codes"), F.count_distinct(F.date_trunc("hour", "datahora")).alias("n_hours"), F.count_distinct("region").alias("n_regions"))
