import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendars, intervals, regions, weather


def rows(spark, values, name="timestamp"):
    return spark.createDataFrame([(dt.datetime.fromisoformat(v),) for v in values], f"{name} timestamp")


def test_easter(spark):
    want = {2020: (4, 12), 2021: (4, 4), 2022: (4, 17), 2023: (4, 9), 2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2030: (4, 21)}
    got = calendars.years_between(spark, 2020, 2030).select("year", calendars.easter(F.col("year")).alias("e")).collect()
    assert {r["year"]: (r["e"].month, r["e"].day) for r in got if r["year"] in want} == want


def test_thirteen_holidays_a_year(spark):
    cal = calendars.holiday_calendar(calendars.years_between(spark, 2023, 2025))
    assert [r["count"] for r in cal.groupBy(F.year("date")).count().collect()] == [13, 13, 13]


def test_holiday_columns(spark):
    got = calendars.holiday_features(rows(spark, ["2018-04-30", "2025-05-02", "2024-12-25T13:00", "2024-12-24", "2024-12-26", "2024-07-11"]))
    by = {str(r["timestamp"].date()): r for r in got.collect()}
    for bridge in ("2018-04-30", "2025-05-02"):
        assert (by[bridge]["is_bridge_day"], by[bridge]["is_extended_weekend"], by[bridge]["days_in_holiday_window"]) == (1, 1, 4)
    day = by["2024-12-25"]
    assert (day["is_holiday"], day["days_to_holiday"], day["days_from_holiday"], day["days_to_nearest_holiday"]) == (1, 0, 17, 0)
    assert by["2024-12-24"]["is_holiday_eve"] == 1 and by["2024-12-26"]["is_holiday_after"] == 1
    assert by["2024-07-11"]["days_to_holiday"] == 30 and by["2024-07-11"]["days_in_holiday_window"] == 0


def test_special_days_bridge_rule(spark):
    # Friday 2025-04-25 is a holiday: the Monday after is a reporting bridge, unlike a feature bridge
    got = calendars.special_days(calendars.years_between(spark, 2025, 2025))
    assert dt.date(2025, 4, 28) in {r["date"] for r in got.filter("category = 'bridge'").collect()}


def test_temporal(spark):
    r = calendars.day_parts(calendars.temporal_features(rows(spark, ["2024-02-29T17:00"]))).first()
    assert (r["hour"], r["day_of_week"], r["is_business_hour"], r["is_weekend"], r["day_of_year"], r["is_afternoon"]) == (17, 3, 1, 0, 60, 1)
    assert r["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 17 / 24))


@pytest.mark.parametrize(("code", "region"), [
    ("1000", "Lisboa"), ("2000", "Centro"), ("2100", "Lisboa"), ("4000", "Norte"), ("7000", "Alentejo"), ("8000", "Algarve"), ("9000", None),
    ("1100-001", "Lisboa"), ("", None), (None, None), ("ABCD", None),
])
def test_map_region(spark, code, region):
    assert regions.map_region(spark.createDataFrame([(code,)], "codigo_postal string")).first()["region"] == region


def test_lookup_covers_all_codes(spark):
    assert regions.region_lookup(spark).count() == 8000


def test_weather_functions(spark):
    df = spark.createDataFrame([(20.0, 50.0, 10.0), (None, 50.0, -1.0)], "t double, h double, v double")
    r = df.select(weather.dew_point(F.col("t"), F.col("h")).alias("d"), weather.wind_chill(F.col("t"), F.col("v")).alias("w")).collect()
    g = math.log(0.5) + 17.62 * 20 / 263.12
    assert r[0]["d"] == pytest.approx(243.12 * g / (17.62 - g)) and r[1]["d"] is None and r[1]["w"] is None
    assert r[0]["w"] == pytest.approx(13.12 + 0.6215 * 20 - 11.37 * 10**0.16 + 0.3965 * 20 * 10**0.16)


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(200.0, 99.0), (None, -40.0)], "wind_speed double, temperature double")
    assert [tuple(r) for r in weather.winsorize(df).collect()] == [(120.0, 45.0), (None, -10.0)]


def test_half_width(spark):
    df = spark.createDataFrame([(30.0, 20.0, "Norte", 12), (None, 20.0, "Nowhere", 3)], "q double, r double, region string, h int")
    got = [x[0] for x in df.select(intervals.half_width(F.col("q"), F.col("r"), F.col("region"), F.col("h"))).collect()]
    assert got == pytest.approx([30 * 1.15 * 1.15, 1.645 * 20 * 0.85], abs=1e-9)
