"""Feature sets: one row-wise select, one broadcast join, one window partitioning."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.calendars import add_aliases, day_parts, holiday_features, temporal_features
from gridloom.functions.regions import add_region_coords, one_hot_region
from gridloom.functions.weather import inject_weather_defaults, weather_derived, winsorize
from gridloom.operators.quality import checked_weather, numeric_columns, validate_features
from gridloom.operators.series import (
    LAGS, TARGET, WINDOWS, chunked, diff_columns, ewma_features, fill_forward, filled_forward, lag_columns, over, rolling_columns, trend_columns, undefined_momentum,
)
from gridloom.operators.splits import row_index

#: Fixed names: columns that are no features, besides the target.
NOT_FEATURES = ["timestamp", "region", "year", "split", "fold", "role"]


def interaction_columns(columns: list[str]) -> dict[str, Column]:
    pairs = {
        "temp_x_weekend": ("temperature", "is_weekend"), "temp_x_holiday": ("temperature", "is_holiday"), "hour_x_dow": ("hour", "day_of_week"),
        "temp_x_hour": ("temperature", "hour"), "wind_x_hour": ("wind_speed", "hour"),
    }
    return {n: F.col(a) * F.col(b) for n, (a, b) in pairs.items() if a in columns and b in columns}


def interaction_features(df: DataFrame) -> DataFrame:
    return df.withColumns(interaction_columns(df.columns))


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = (), target: str = TARGET) -> list[str]:
    """Numeric columns without target, keys and aliases."""
    from gridloom.functions.calendars import ALIASES, NO_LAG_ALIASES

    skip = {target, *NOT_FEATURES, *ALIASES, *NO_LAG_ALIASES, *exclude}
    return [c for c in numeric_columns(df) if c not in skip]


def drop_warmup(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=numeric_columns(df))


def _base(df: DataFrame, winsor: bool, check: bool, years: tuple[int, int] | None) -> DataFrame:
    """Checked and completed weather with calendar and holidays. Bounds and years come from one pass, which
    a caller who knows both leaves out."""
    if check:
        year = F.year("timestamp")
        span = checked_weather(df, **({} if years else {"first": F.min(year), "last": F.max(year)}))
        if not years and span["first"] is not None:
            years = (span["first"], span["last"])
    df = winsorize(df) if winsor else df
    return holiday_features(temporal_features(inject_weather_defaults(add_region_coords(df))), years=years)


def features_no_lags(df: DataFrame, winsor: bool = False, check: bool = True, years: tuple[int, int] | None = None) -> DataFrame:
    """Features of a single row: calendar, holidays, weather, interactions, region flags."""
    out = interaction_features(day_parts(_base(df, winsor, check, years)))
    return validate_features(one_hot_region(add_aliases(out, no_lags=True)))


def features_full(
    df: DataFrame, advanced: bool = False, winsor: bool = False, check: bool = True, years: tuple[int, int] | None = None, chunk: int | None = 100_000
) -> DataFrame:
    """All features with history. Rows that lack one are dropped before infinities become null: 0/0
    drops a row, x/0 keeps it.

    Rows are numbered once, and windows run in chunks of ``chunk`` rows of a region; with None they run
    over whole regions, which gives the same.
    """
    out = _base(df, winsor, check, years)
    out = add_aliases(weather_derived(out) if advanced else out)
    momenta = {c: name for c, name in (("temperature", "temp_momentum"), ("wind_speed", "wind_momentum")) if advanced and c in df.columns}
    filled = None
    if chunk:
        out = row_index(out, "_i")
        if momenta:
            filled = {c: f"_f_{c}" for c in momenta}
            out = fill_forward(out, filled, indexed=True)

    def history(w: WindowSpec) -> dict[str, Column]:
        new = lag_columns(w=w) | rolling_columns(w=w) | diff_columns(w=w)
        if advanced:
            new |= trend_columns(df.columns, w, filled) | {"_undefined": undefined_momentum(df.columns, w, filled)}
        for c, name in momenta.items():  # an old value there but no quotient: a change from 0
            new[f"_has_{name}"] = filled_forward(c, 3, w, filled).isNotNull()
        return new

    out = chunked(out, history, max(*LAGS, *WINDOWS), chunk, indexed=True) if chunk else out.withColumns(history(over()))
    out = ewma_features(out, indexed=bool(chunk)).drop("_i", *(filled or {}).values())
    out = interaction_features(out)
    if "temperature" in out.columns:
        out = out.withColumn("temperature_squared", F.col("temperature") * F.col("temperature"))
    out = out.na.drop(subset=[c for c in numeric_columns(out) if c not in momenta.values()])
    if advanced:
        flags = [f"_has_{name}" for name in momenta.values()]
        out = out.filter(reduce(and_, map(F.col, flags), ~F.col("_undefined"))).drop("_undefined", *flags)
    return validate_features(out)
