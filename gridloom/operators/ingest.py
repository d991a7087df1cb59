"""From readings to the region-by-hour table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendars import hour_of_week
from gridloom.functions.regions import map_region

MOST_KWH = 100_000.0


def plausible(col: Column) -> Column:
    return (col >= 0) & (col < MOST_KWH)


def clean_readings(df: DataFrame) -> DataFrame:
    """Mapped, plausible readings."""
    return df.filter(F.col("region").isNotNull() & plausible(F.col("consumo")))


def ingest_quality(df: DataFrame) -> DataFrame:
    """Counts of what ``clean_readings`` drops, in one pass over mapped readings."""
    lost = F.col("region").isNull()
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(lost).alias("n_unmapped"),
        F.count_distinct(F.when(lost, F.col("codigo_postal"))).alias("n_unmapped_codes"),
        F.count_if(~lost & ~F.coalesce(plausible(F.col("consumo")), F.lit(False))).alias("n_anomalous"),
    )


def kwh_to_mw(col: Column) -> Column:
    return col / 1000.0


def regional_hourly(readings: DataFrame) -> DataFrame:
    """timestamp (hour), region, consumption_mw. Codes are mapped by broadcast before the only
    shuffle, which partial sums reduce to hours times regions."""
    kept = clean_readings(map_region(readings))
    hour = F.date_trunc("hour", "datahora").cast(readings.schema["datahora"].dataType).alias("timestamp")
    return kept.groupBy(hour, "region").agg(kwh_to_mw(F.sum("consumo")).alias("consumption_mw"))


def hourly_from_quarters(df: DataFrame, ts: str = "datahora", columns: tuple = ("bt", "mt", "at", "mat", "total")) -> DataFrame:
    """Hourly MW of every column; hours without exactly four values of the first one are left out."""
    hour = F.date_trunc("hour", ts).cast(df.schema[ts].dataType).alias("timestamp")
    sums = df.groupBy(hour).agg(F.count(columns[0]).alias("_n"), *[kwh_to_mw(F.sum(c)).alias(f"{c}_mw") for c in columns])
    return sums.filter("_n = 4").drop("_n")


def build_dataset(consumption: DataFrame, weather: DataFrame) -> DataFrame:
    """Inner join on (timestamp, region) without rows that lack target or temperature, and the year."""
    both = consumption.filter("consumption_mw IS NOT NULL").join(weather.filter("temperature IS NOT NULL"), ["timestamp", "region"])
    return both.withColumn("year", F.year("timestamp"))


def regional_shares(df: DataFrame) -> DataFrame:
    """Mean share of each region by hour of week. The total of an hour is joined back as an aggregate."""
    total = df.groupBy("timestamp").agg(F.sum("consumption_mw").alias("_total"))
    share = F.try_divide(F.col("consumption_mw"), F.col("_total"))
    each = df.join(total, "timestamp").select("region", hour_of_week(F.col("timestamp")).alias("hour_of_week"), share.alias("share"))
    return each.groupBy("hour_of_week", "region").agg(F.avg("share").alias("share"))


def disaggregate(national: DataFrame, shares: DataFrame) -> DataFrame:
    """A national series split by share. Regions then follow the same total, so models with lags must
    not be trained on the result."""
    keyed = national.withColumn("hour_of_week", hour_of_week(F.col("timestamp")))
    split = keyed.join(shares, "hour_of_week", "left")
    return split.withColumn("consumption_mw", F.col("total_mw") * F.col("share"))


def missing_hours(df: DataFrame, by_region: bool = False) -> DataFrame:
    """Hours between first and last that have no row; with ``by_region`` for each region."""
    keys = ["region"] if by_region else []
    kind = df.schema["timestamp"].dataType
    span = df.groupBy(*keys).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("timestamp"))
    grid = grid.withColumn("timestamp", F.col("timestamp").cast(kind))
    return grid.join(df.select(*keys, "timestamp"), [*keys, "timestamp"], "left_anti")


def regularize(df: DataFrame) -> DataFrame:
    """Every hour between first and last for each region; what wasn't there is null."""
    return df.unionByName(missing_hours(df, by_region=True), allowMissingColumns=True)
