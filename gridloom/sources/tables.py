"""Readers and writers with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS = "datahora string, codigo_postal string, consumo double"
#: Fixed names: variables of the hourly payload and the feature columns they become.
HOURLY_VARIABLES = {
    "temperature_2m": "temperature", "relative_humidity_2m": "humidity", "dew_point_2m": "dew_point",
    "apparent_temperature": "temperature_feels_like", "surface_pressure": "pressure", "cloud_cover": "cloud_cover",
    "wind_speed_10m": "wind_speed", "wind_direction_10m": "wind_direction", "precipitation": "precipitation",
    "shortwave_radiation": "solar_radiation",
}
STATS = "struct<mean:double,std:double,min:double,max:double,q25:double,q50:double,q75:double,p1:double,p99:double>"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as null: Spark would order NaN above every number."""
    kinds = {"double", "float"}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in kinds})


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Postal-code readings; ``datahora`` becomes a UTC timestamp whatever its stored type."""
    df = spark.read.parquet(path).select("datahora", "codigo_postal", "consumo")
    return nan_to_null(df.withColumns({
        "datahora": F.col("datahora").try_cast("timestamp"), "codigo_postal": F.col("codigo_postal").cast("string"),
        "consumo": F.col("consumo").try_cast("double"),
    }))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.withColumn("timestamp", F.col("timestamp").try_cast("timestamp")))


def flatten_hourly_payload(df: DataFrame, payload: str = "payload", names: dict[str, str] = HOURLY_VARIABLES) -> DataFrame:
    """Rows (region, timestamp, variables) from JSON whose ``hourly`` object holds parallel arrays."""
    arrays = ",".join(["time:array<string>"] + [f"{v}:array<double>" for v in names])
    parsed = df.select("region", F.from_json(payload, f"hourly struct<{arrays}>")["hourly"].alias("_h"))
    empty = lambda c: F.array().cast("array<string>" if c == "time" else "array<double>")
    filled = lambda c: F.coalesce(F.col(f"_h.{c}"), empty(c))  # noqa: E731  a variable may be missing
    flat = parsed.select("region", F.inline(F.arrays_zip(*[filled(c).alias(c) for c in ("time", *names)])))
    return flat.withColumn("timestamp", F.col("time").try_cast("timestamp")).drop("time").withColumnsRenamed(names)


def stack_regions(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_feature_stats(spark: SparkSession, path: str) -> DataFrame:
    """feature and its reference statistics, from JSON with ``feature_stats``; an error if there are none."""
    text = spark.read.text(path, wholetext=True)
    stats = F.from_json("value", f"feature_stats map<string,{STATS}>")["feature_stats"]
    out = text.select(F.explode(stats).alias("feature", "_s")).select("feature", "_s.*")
    if out.isEmpty():
        raise ValueError(f"no feature_stats in {path}")
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON document for each file."""
    schema = (
        "run_id string, name string, status string, started_at string, finished_at string, metrics map<string,double>,"
        " params map<string,string>, tags map<string,string>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Parquet with one run of sorted rows for each partition value; no global sort."""
    out = df.repartition(*partition_by) if partition_by else df
    out = out.sortWithinPartitions(*(partition_by or []), *(sort_by or [])) if sort_by else out
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, first_cols: list[str]) -> None:
    """CSV with leading columns in a fixed order."""
    lead = [c for c in first_cols if c in df.columns]
    df.select(*lead, *[c for c in df.columns if c not in lead]).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
