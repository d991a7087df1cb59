"""Regions: postal codes, coordinates, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First and last postal code of each range and its region.
CODE_RANGES = [
    (1000, 1999, "Lisboa"), (2000, 2099, "Centro"), (2100, 2199, "Lisboa"), (2200, 2399, "Centro"), (2400, 2499, "Centro"),
    (2500, 2599, "Centro"), (2600, 2699, "Lisboa"), (2700, 2799, "Lisboa"), (2800, 2899, "Lisboa"), (2900, 2999, "Lisboa"),
    (3000, 3999, "Centro"), (4000, 4999, "Norte"), (5000, 5999, "Norte"), (6000, 6999, "Centro"), (7000, 7999, "Alentejo"),
    (8000, 8999, "Algarve"),
]
#: Latitude and longitude.
COORDS = {"Alentejo": (38.5, -7.9), "Algarve": (37.1, -8.0), "Centro": (40.2, -8.4), "Lisboa": (38.7, -9.1), "Norte": (41.5, -8.4)}
REGIONS = sorted(COORDS)


def postal_code(col: Column) -> Column:
    """The first four characters as a number from 1000 to 8999, else null."""
    code = F.substring(F.trim(col.cast("string")), 1, 4).try_cast("int")
    return F.when(code.between(1000, 8999), code)


def ranges_table(spark: SparkSession, ranges: list = CODE_RANGES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "rank int, start int, end int, region string")


def region_lookup(spark: SparkSession, ranges: list = CODE_RANGES) -> DataFrame:
    """code (four digits) and region for every code of the ranges; the first range wins."""
    codes = ranges_table(spark, ranges).select("rank", "region", F.explode(F.sequence("start", "end")).alias("code"))
    return codes.groupBy("code").agg(F.min_by("region", "rank").alias("region"))


def map_region(df: DataFrame, code: str = "codigo_postal", ranges: list = CODE_RANGES) -> DataFrame:
    """Add ``region`` by an equality join with the expanded ranges: a few thousand rows, broadcast."""
    lookup = region_lookup(df.sparkSession, ranges).withColumnRenamed("code", "_code")
    return df.withColumn("_code", postal_code(F.col(code))).join(F.broadcast(lookup), "_code", "left").drop("_code")


def add_region_coords(df: DataFrame) -> DataFrame:
    """latitude and longitude (0 for other regions) and the plain feels-like temperature."""
    def of(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for r in REGIONS for x in (r, COORDS[r][i])])
        return F.coalesce(F.try_element_at(table, F.col("region")), F.lit(0.0))

    return df.withColumns({"latitude": of(0), "longitude": of(1), "temperature_feels_like": F.col("temperature")})


def one_hot_region(df: DataFrame, regions: list[str] = REGIONS) -> DataFrame:
    return df.withColumns({f"region_{r}": F.coalesce(F.col("region") == r, F.lit(False)).cast("int") for r in regions})
