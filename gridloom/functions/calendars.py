"""Calendar columns and the holiday dimension.

Everything is column arithmetic over a timestamp or a small date dimension; no UDFs. The dimension
covers the years asked for, so it stays a few hundred rows for each year.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Month and day of the ten fixed public holidays.
FIXED_HOLIDAYS = [(1, 1), (4, 25), (5, 1), (6, 10), (8, 15), (10, 5), (11, 1), (12, 1), (12, 8), (12, 25)]
#: Days from Easter Sunday of the movable holidays.
EASTER_OFFSETS = [-2, 0, 60]
PROXIMITY_CAP = 30
LONG_WEEKEND = 4

#: Fixed names: other names of the cyclical columns.
ALIASES = {
    "sin_hour": "hour_sin", "cos_hour": "hour_cos", "sin_day_of_week": "day_sin", "cos_day_of_week": "day_cos",
    "day_of_week_sin": "day_sin", "day_of_week_cos": "day_cos", "sin_month": "month_sin", "cos_month": "month_cos",
    "sin_day_of_year": "day_of_year_sin", "cos_day_of_year": "day_of_year_cos",
}
#: Fixed names: other names of interaction columns in the set without lags.
NO_LAG_ALIASES = {"temp_hour": "temp_x_hour", "temp_weekend": "temp_x_weekend", "wind_hour": "wind_x_hour"}


def temporal_columns(ts: Column) -> dict[str, Column]:
    """Calendar fields of a timestamp and their positions on a circle."""
    hour, dow = F.hour(ts), F.weekday(ts)
    out = {
        "hour": hour, "day_of_week": dow, "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "quarter": F.quarter(ts),
        "year": F.year(ts), "week_of_year": F.weekofyear(ts), "day_of_year": F.dayofyear(ts), "is_weekend": (dow >= 5).cast("int"),
        "is_business_hour": (hour.between(9, 17) & (dow < 5)).cast("int"),
    }
    for name, col, turn in (("hour", hour, 24), ("day", dow, 7), ("month", F.month(ts), 12), ("day_of_year", F.dayofyear(ts), 365)):
        angle = col * F.lit(2 * math.pi) / F.lit(float(turn))
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out


def temporal_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(temporal_columns(F.col(ts)))


def add_aliases(df: DataFrame, no_lags: bool = False) -> DataFrame:
    """Copies under other names of the columns that are there."""
    names = ALIASES | (NO_LAG_ALIASES if no_lags else {})
    return df.withColumns({new: F.col(old) for new, old in names.items() if old in df.columns})


def day_parts(df: DataFrame, hour: str = "hour") -> DataFrame:
    h = F.col(hour)
    flags = {"is_morning": h.between(6, 11), "is_afternoon": h.between(12, 17), "is_evening": h.between(18, 21), "is_night": (h >= 22) | (h < 6)}
    return df.withColumns({k: v.cast("int") for k, v in flags.items()})


def hour_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 24 + F.hour(ts)


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("autumn")


def easter(year: Column) -> Column:
    """Date of Easter Sunday in the Gregorian calendar: the anonymous algorithm as published (Nature, 1876;
    Meeus), with its letters."""
    div = lambda x, y: F.floor(x / F.lit(y)).cast("int")
    a = year % 19
    b, c = div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    f = div(b + 8, 25)
    g = div(b - f + 1, 3)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    l = (32 + 2 * e + 2 * i - h - k) % 7  # noqa: E741
    m = div(a + 11 * h + 22 * l, 451)
    n = h + l - 7 * m + 114
    return F.make_date(year, div(n, 31), n % 31 + 1)


def years_between(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def holiday_calendar(years: DataFrame) -> DataFrame:
    """Distinct ``date`` and ``kind`` (fixed, easter; fixed where both) of public holidays."""
    fixed = F.array(*[F.struct(F.make_date("year", F.lit(m), F.lit(d)).alias("date"), F.lit("fixed").alias("kind")) for m, d in FIXED_HOLIDAYS])
    moved = F.array(*[F.struct(F.date_add(easter(F.col("year")), d).alias("date"), F.lit("easter").alias("kind")) for d in EASTER_OFFSETS])
    return years.select(F.inline(F.concat(fixed, moved))).groupBy("date").agg(F.max("kind").alias("kind"))


def date_dimension(spark: SparkSession, first: int, last: int) -> DataFrame:
    """One row for each date of the years first-1 to last+1 with all holiday columns.

    Distances look at the holidays of these years; runs of free days at a month beyond them.
    """
    holidays = holiday_calendar(years_between(spark, first - 1, last + 1))
    span = f"sequence(make_date({first - 2}, 12, 1), make_date({last + 2}, 1, 31))"
    days = spark.range(1).select(F.explode(F.expr(span)).alias("date"))
    days = days.join(F.broadcast(holidays.select("date", F.lit(True).alias("_h"))), "date", "left")
    order = Window.orderBy("date")  # a few hundred rows for each year
    day, free = F.weekday("date"), F.coalesce("_h", F.lit(False))
    day_after, day_before = F.lead(free, 1, False).over(order), F.lag(free, 1, False).over(order)
    bridge = ~free & ((day == 0) & day_after | (day == 4) & day_before)
    days = days.select(
        "date", free.alias("_h"), day_after.alias("_eve"), day_before.alias("_after"), bridge.alias("_bridge"),
        F.min(F.when(free, F.col("date"))).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_next"),
        F.max(F.when(free, F.col("date"))).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_last"),
        (free | bridge | (day >= 5)).alias("_off"),
    )
    days = days.withColumn("_run", F.sum(F.when(F.col("_off"), 0).otherwise(1)).over(order))
    run = Window.partitionBy("_run")
    length = F.sum(F.col("_off").cast("int")).over(run)
    has_bridge = F.max(F.col("_bridge").cast("int")).over(run)
    cap = lambda c: F.least(F.coalesce(c, F.lit(PROXIMITY_CAP)), F.lit(PROXIMITY_CAP))
    ahead, behind = F.datediff("_next", "date"), F.datediff("date", "_last")
    flag = lambda c: c.cast("int")
    return days.select(
        "date", flag(F.col("_h")).alias("is_holiday"), flag(F.col("_eve")).alias("is_holiday_eve"),
        flag(F.col("_after")).alias("is_holiday_after"), cap(F.least(ahead, behind)).alias("days_to_nearest_holiday"),
        cap(ahead).alias("days_to_holiday"), cap(behind).alias("days_from_holiday"), flag(F.col("_bridge")).alias("is_bridge_day"),
        flag(F.col("_off") & (length >= LONG_WEEKEND) & (has_bridge == 1)).alias("is_extended_weekend"),
        F.when(F.col("_off"), length).otherwise(0).cast("int").alias("days_in_holiday_window"),
    ).filter(F.year("date").between(first - 1, last + 1))


def year_span(df: DataFrame, ts: str = "timestamp") -> tuple[int, int]:
    """First and last year of the data; two numbers on the driver."""
    row = df.agg(F.min(F.year(ts)).alias("a"), F.max(F.year(ts)).alias("b")).first()
    return (row["a"], row["b"]) if row["a"] is not None else (2000, 2000)


def holiday_features(df: DataFrame, ts: str = "timestamp", years: tuple[int, int] | None = None) -> DataFrame:
    """Holiday columns by a broadcast join with the date dimension (its rows follow the years)."""
    dim = date_dimension(df.sparkSession, *(years or year_span(df, ts))).withColumnRenamed("date", "_date")
    return df.withColumn("_date", F.to_date(ts)).join(F.broadcast(dim), "_date", "left").drop("_date")


def special_days(years: DataFrame) -> DataFrame:
    """date and category of reporting days: fixed, easter, bridge. A Friday holiday makes the next
    Monday a bridge, a Monday holiday the Friday before, unless they are holidays themselves."""
    holidays = holiday_calendar(years)
    kinds = years.select(F.explode(F.array(*[F.make_date("year", F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS])).alias("date"), F.lit("fixed").alias("category"))
    moved = years.select(F.explode(F.array(*[F.date_add(easter(F.col("year")), d) for d in EASTER_OFFSETS])).alias("date"), F.lit("easter").alias("category"))
    day = F.weekday("date")
    step = F.when(day == 4, F.date_add("date", 3)).when(day == 0, F.date_add("date", -3))
    bridges = holidays.select(step.alias("date")).filter("date IS NOT NULL").distinct().join(holidays, "date", "left_anti")
    return kinds.unionByName(moved).unionByName(bridges.withColumn("category", F.lit("bridge"))).distinct()
