"""Registration, and the given tables in the roles that the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.regions import CODE_RANGES
from gridloom.shared import scratch

__all__ = ["ORACLES", "QUERIES", "query", "role_sql", "scratch", "tidy"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same roles in SQL.
ROLES = {
    "ranges": "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, '{r}')" for a, b, r in CODE_RANGES) + ") t(a, b, region)",
    "readings": "SELECT ts AS datahora, cast(1000 + (user_id * 577) % 9000 AS VARCHAR) AS codigo_postal, (value - 1.0::DOUBLE) * 300.0::DOUBLE AS consumo FROM events",
    "mapped": "SELECT r.*, g.region FROM readings r LEFT JOIN ranges g ON cast(codigo_postal AS INT) BETWEEN g.a AND g.b",
    "hourly": "SELECT date_trunc('hour', datahora) AS timestamp, region, sum(consumo) / 1000 AS consumption_mw FROM mapped"
    " WHERE region IS NOT NULL AND consumo >= 0 AND consumo < 100000 GROUP BY 1, 2",
    "series": "SELECT ts AS timestamp, event_type AS region, value AS consumption_mw FROM events",
    "ehourly": "SELECT date_trunc('hour', ts) AS timestamp, event_type AS region, sum(value) AS consumption_mw FROM events GROUP BY 1, 2",
    "weather": "SELECT l_shipdate + INTERVAL 1 HOUR * (l_orderkey % 24) AS timestamp, r_name AS region, l_quantity - 5 AS temperature,"
    " l_discount * 1000 AS humidity, l_tax * 1000 AS wind_speed, cast(l_linenumber - 1 AS DOUBLE) AS precipitation,"
    " cast(l_partkey % 101 AS DOUBLE) AS cloud_cover, cast(960 + l_suppkey % 91 AS DOUBLE) AS pressure, l_extendedprice / 100 AS consumption_mw"
    " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "daily": "SELECT o_orderdate AS timestamp, r_name AS region, sum(o_totalprice) AS consumption_mw FROM orders JOIN customer ON o_custkey = c_custkey"
    " JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "predicted": "SELECT *, lag(consumption_mw) OVER (PARTITION BY region ORDER BY timestamp) AS y_pred FROM ehourly",
    "judged": "SELECT timestamp, region, consumption_mw AS actual, y_pred AS predicted, y_pred - 20 AS lower, y_pred + 20 AS upper FROM predicted WHERE y_pred IS NOT NULL",
    "serving": "SELECT ts AS timestamp, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS duration FROM events",
}
NEEDS = {"mapped": ["ranges", "readings"], "hourly": ["mapped"], "predicted": ["ehourly"], "judged": ["predicted"]}


def role_sql(*names: str) -> str:
    """``WITH`` of roles and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({ROLES[n]})" for n in order)


def query(name: str, roles: str = "", sql: str = "", doubles: str = "", ints: str = "", digits: int = 6):
    """Register a query and its SQL; doubles are rounded and counts are 64-bit on both sides."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir), digits)
        if sql:
            changed = [f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split()] + [f"cast({c} AS BIGINT) AS {c}" for c in ints.split()]
            star = f"* REPLACE ({', '.join(changed)})" if changed else "*"
            start = role_sql(*roles.split()) + (", " if roles else "") if roles else "WITH "
            ORACLES[name] = f"{start}_out AS ({sql}) SELECT {star} FROM _out"
        return f

    return put


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as 64-bit, timestamps without zone."""
    new = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if t in ("double", "float"):
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            col = col.cast("long")
        elif t == "timestamp":
            col = col.cast("timestamp_ntz")
        new.append(col.alias(c))
    return df.select(*new)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("ts").alias("datahora"), (F.lit(1000) + (F.col("user_id") * 577) % 9000).cast("string").alias("codigo_postal"),
        ((F.col("value") - 1.0) * 300.0).alias("consumo"),
    )


def series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("region"), F.col("value").alias("consumption_mw"))


def event_hourly(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp")
    return table(spark, d, "events").groupBy(hour, F.col("event_type").alias("region")).agg(F.sum("value").alias("consumption_mw"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name")


def weather(spark: SparkSession, d: str) -> DataFrame:
    line, sup = table(spark, d, "lineitem"), table(spark, d, "supplier")
    places = sup.join(F.broadcast(_places(spark, d)), sup["s_nationkey"] == F.col("n_nationkey")).select("s_suppkey", "r_name")
    both = line.join(places, line["l_suppkey"] == F.col("s_suppkey"))
    return both.select(
        (F.col("l_shipdate") + F.expr("make_dt_interval(0, cast(l_orderkey % 24 AS int))")).cast("timestamp_ntz").alias("timestamp"),
        F.col("r_name").alias("region"), (F.col("l_quantity") - 5).alias("temperature"), (F.col("l_discount") * 1000).alias("humidity"),
        (F.col("l_tax") * 1000).alias("wind_speed"), (F.col("l_linenumber") - 1).cast("double").alias("precipitation"),
        (F.col("l_partkey") % 101).cast("double").alias("cloud_cover"), (F.lit(960) + F.col("l_suppkey") % 91).cast("double").alias("pressure"),
        (F.col("l_extendedprice") / 100).alias("consumption_mw"),
    )


def daily(spark: SparkSession, d: str) -> DataFrame:
    orders, cust = table(spark, d, "orders"), table(spark, d, "customer")
    places = cust.join(F.broadcast(_places(spark, d)), cust["c_nationkey"] == F.col("n_nationkey")).select("c_custkey", "r_name")
    both = orders.join(places, orders["o_custkey"] == F.col("c_custkey"))
    return both.groupBy(F.col("o_orderdate").alias("timestamp"), F.col("r_name").alias("region")).agg(F.sum("o_totalprice").alias("consumption_mw"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    from gridloom.operators.series import over

    return event_hourly(spark, d).withColumn("y_pred", F.lag("consumption_mw").over(over()))


def judged(spark: SparkSession, d: str) -> DataFrame:
    p = predicted(spark, d).filter("y_pred IS NOT NULL")
    return p.select(
        "timestamp", "region", F.col("consumption_mw").alias("actual"), F.col("y_pred").alias("predicted"),
        (F.col("y_pred") - 20).alias("lower"), (F.col("y_pred") + 20).alias("upper"),
    )


def serving(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("endpoint"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 100).alias("duration"),
    )


def series_weather(spark: SparkSession, d: str) -> DataFrame:
    """The hourly event series with weather columns that follow from time and value."""
    h = F.unix_timestamp(F.col("timestamp").cast("timestamp")) / 3600
    return event_hourly(spark, d).withColumns({
        "temperature": F.pmod(h, F.lit(31)).cast("double") - 3, "humidity": F.pmod(h * 7, F.lit(101)).cast("double"), "wind_speed": F.pmod(h * 3, F.lit(37)).cast("double"),
        "precipitation": F.pmod(h, F.lit(5)).cast("double"), "cloud_cover": F.pmod(h * 11, F.lit(101)).cast("double"), "pressure": F.pmod(h, F.lit(60)).cast("double") + 980,
    })


ROLES["sweather"] = (
    "SELECT *, (epoch(timestamp) / 3600)::DOUBLE % 31 - 3 AS temperature, ((epoch(timestamp) / 3600) * 7)::DOUBLE % 101 AS humidity,"
    " ((epoch(timestamp) / 3600) * 3)::DOUBLE % 37 AS wind_speed, (epoch(timestamp) / 3600)::DOUBLE % 5 AS precipitation,"
    " ((epoch(timestamp) / 3600) * 11)::DOUBLE % 101 AS cloud_cover, (epoch(timestamp) / 3600)::DOUBLE % 60 + 980 AS pressure FROM ehourly"
)
NEEDS["sweather"] = ["ehourly"]
