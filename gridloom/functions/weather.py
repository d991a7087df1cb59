"""Weather indices and input repair, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds outside which observations are cut to the bound.
WINSOR_BOUNDS = {
    "temperature": (-10.0, 45.0), "humidity": (5.0, 100.0), "wind_speed": (0.0, 120.0), "precipitation": (0.0, 100.0), "pressure": (960.0, 1050.0),
}
#: Magnus formula, least dew point, standard pressure.
MAGNUS_B, MAGNUS_C, DEW_POINT_LEAST, STANDARD_PRESSURE = 17.62, 243.12, -80.0, 1013.25
#: The regression of the heat index in degrees Fahrenheit and per cent, as the US National Weather
#: Service publishes it (Rothfusz).
HEAT_INDEX = [-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783, -0.05481717, 0.00122874, 0.00085282, -0.00000199]
#: The wind chill formula of 2001 of the US and Canadian weather services, in degrees Celsius and km/h.
WIND_CHILL = [13.12, 0.6215, -11.37, 0.3965]


def clip(col: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """Cut to bounds; null stays null, which ``least`` and ``greatest`` wouldn't keep."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = col
    if hi is not None:
        out = F.when(col > lit(hi), lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(col < lit(lo), lit(lo)).otherwise(out)
    return out


def winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]] = WINSOR_BOUNDS) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def dew_point(temp: Column, humidity: Column) -> Column:
    """The Magnus formula: c g / (b - g) with g = ln(RH / 100) + b T / (c + T)."""
    gamma = F.ln(clip(humidity, 1.0, 100.0) / 100.0) + (F.lit(MAGNUS_B) * temp) / (F.lit(MAGNUS_C) + temp)
    dew = (F.lit(MAGNUS_C) * gamma) / (F.lit(MAGNUS_B) - gamma)
    return clip(clip(dew, DEW_POINT_LEAST, None), None, temp)


def heat_index(temp: Column, humidity: Column) -> Column:
    """HI = c1 + c2 T + c3 R + c4 T R + c5 T^2 + c6 R^2 + c7 T^2 R + c8 T R^2 + c9 T^2 R^2, T in Fahrenheit."""
    c1, c2, c3, c4, c5, c6, c7, c8, c9 = map(F.lit, HEAT_INDEX)
    t, r = temp * 9.0 / 5.0 + 32.0, humidity
    hi = c1 + c2 * t + c3 * r + c4 * t * r + c5 * t * t + c6 * r * r + c7 * t * t * r + c8 * t * r * r + c9 * t * t * r * r
    return (hi - 32.0) * 5.0 / 9.0


def comfort_columns(temp: Column, humidity: Column) -> dict[str, Column]:
    """Thom's discomfort index, T - (0.55 - 0.0055 RH) (T - 14.5); Missenard's effective temperature,
    T - 0.4 (T - 10) (1 - RH / 100); and their ratio."""
    return {
        "comfort_index": temp - (0.55 - 0.0055 * humidity) * (temp - 14.5),
        "effective_temperature": temp - 0.4 * (temp - 10) * (1 - humidity / 100),
        "temp_humidity_ratio": F.try_divide(temp, humidity + 1.0),
    }


def wind_chill(temp: Column, wind: Column, to_kmh: float = 1.0) -> Column:
    """13.12 + 0.6215 T - 11.37 V^0.16 + 0.3965 T V^0.16. Wind in km/h; ``to_kmh`` = 3.6 for metres per second.
    Negative wind has no value."""
    a, b, c, d = map(F.lit, WIND_CHILL)
    v = F.when(wind >= 0, F.pow(wind * to_kmh, F.lit(0.16)))
    return a + b * temp + c * v + d * temp * v


def weather_columns(columns: list[str]) -> dict[str, Column]:
    """Derived columns that the columns at hand allow."""
    have = set(columns)
    t, h, w = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    out: dict[str, Column] = {}
    if {"temperature", "humidity"} <= have:
        out |= {"dew_point": dew_point(t, h), "heat_index": heat_index(t, h)} | comfort_columns(t, h)
    if {"temperature", "wind_speed"} <= have:
        out["wind_chill"] = wind_chill(t, w)
    if "pressure" in have:
        out["pressure_relative"] = F.col("pressure") - STANDARD_PRESSURE
    if "cloud_cover" in have:
        out["solar_proxy"] = F.lit(100.0) - F.col("cloud_cover")
    if {"temperature", "precipitation"} <= have:
        out["precip_temp_index"] = F.col("precipitation") * (1 + t / 100)
    return out


def weather_derived(df: DataFrame) -> DataFrame:
    return df.withColumns(weather_columns(df.columns))


def inject_weather_defaults(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Dew point, wind direction and solar radiation where the column isn't there."""
    new: dict[str, Column] = {}
    if "dew_point" not in df.columns:
        new["dew_point"] = dew_point(F.col("temperature"), F.col("humidity"))
    if "wind_direction" not in df.columns:
        new["wind_direction"] = F.lit(180.0)
    if "solar_radiation" not in df.columns:
        cloud = F.col("cloud_cover") if "cloud_cover" in df.columns else F.lit(50.0)
        hour = F.coalesce(F.hour(ts), F.lit(12)).cast("double")
        sun = F.sin(clip(hour - 6.0, 0.0, 12.0) * math.pi / 12.0)
        new["solar_radiation"] = clip(sun * 900.0 * (F.lit(1.0) - cloud / 100.0), 0.0, None)
    return df.withColumns(new)
