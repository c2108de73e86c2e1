"""The full feature frame and helpers for feature matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..functions.dates import fourier_terms
from .holidays import HOLIDAYS, holiday_effects
from .keys import add, every, named, row_index, series_window
from .places import demographic_columns, weather_columns
from .windows import LAGS, ROLLING, SPANS, STATS, ewm_columns, fill_forward_back, rolling_stat

# Columns never used as model inputs.
NOT_FEATURES = ("ds", "y", "location", "created_at", "date")

# Name fragments of the (overlapping) feature groups.
CATEGORY_FRAGMENTS = {
    "holiday_features": ("holiday", "tet"),
    "weather_features": ("season", "monsoon", "temp", "humidity", "climate"),
    "demographic_features": ("population", "city", "economic", "healthcare"),
    "temporal_features": ("month", "quarter", "week", "day"),
    "lagged_features": ("lag", "rolling", "ema"),
    "fourier_features": ("sin", "cos"),
}

# Products of two columns, by name.
PRODUCTS = {
    "weekend_dry_season": ("is_weekend", "is_dry_season"),
    "weekend_rainy_season": ("is_weekend", "is_rainy_season"),
    "holiday_dry_season": ("is_major_holiday", "is_dry_season"),
    "holiday_rainy_season": ("is_major_holiday", "is_rainy_season"),
    "large_city_rainy": ("is_major_city", "is_rainy_season"),
    "coastal_monsoon": ("is_coastal_city", "is_southwest_monsoon"),
    "economic_hub_holiday": ("is_economic_hub", "is_major_holiday"),
    "tourism_season": ("is_tourism_city", "is_dry_season"),
    "capacity_holiday_stress": ("healthcare_capacity_factor", "is_major_holiday"),
    "capacity_weather_stress": ("healthcare_capacity_factor", "extreme_heat_risk"),
    "quarter_economic": ("quarter", "is_economic_hub"),
}


def interaction_features(df: DataFrame) -> DataFrame:
    products = {name: F.col(a) * F.col(b) for name, (a, b) in PRODUCTS.items()}
    return add(df, {**products, "month_population": F.col("month") * F.col("population") / 1000})


def lagged_features(df: DataFrame, key: str = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Lags, rolling statistics, trends, volatility and exponential means.

    Everything on the plain row order goes into one window pass; the volatility
    columns are the rolling deviations under a second name.
    """
    w = series_window(key, ds)
    lags = {f"y_lag_{k}": F.lag(y, k).over(w) for k in LAGS}
    rolled = {f"y_rolling_{s}_{n}": rolling_stat(s, n, y, key, ds, full=True) for n in ROLLING for s in STATS}
    trends = {f"y_trend_{k}d": F.col(y) - F.lag(y, k).over(w) for k in SPANS}
    smooth = ewm_columns(add(df, {**lags, **rolled, **trends}), key=key, ds=ds, y=y)
    return add(smooth, {f"y_volatility_{n}d": F.col(f"y_rolling_std_{n}") for n in SPANS})


def fourier_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    return add(df, fourier_columns(F.col(ds)))


def fourier_columns(day: Column) -> dict[str, Column]:
    return {"day_of_week": F.weekday(day), **fourier_terms(day)}


def all_features(df: DataFrame, holidays: Mapping[str, Sequence[str]] | DataFrame = HOLIDAYS, key: str = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """The 99-column feature frame, with window gaps filled inside each series.

    The windows run first, on narrow rows; the calendar and place columns are
    added after the sort so they are never part of it.
    """
    base = df.columns
    lagged = lagged_features(df, key, ds, y)
    copies = {f"y_volatility_{n}d": F.col(f"y_rolling_std_{n}") for n in SPANS}
    gaps = [c for c in lagged.columns if c not in base and c not in copies]
    out = add(fill_forward_back(lagged, gaps, key, ds), copies)
    out = holiday_effects(out, holidays, ds=ds)
    day, place = F.col(ds), F.col(key)
    out = add(out, {**weather_columns(place, day), **demographic_columns(place), **fourier_columns(day)})
    return interaction_features(out)


def numeric_features(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def feature_matrix(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> DataFrame:
    """Numeric feature columns with nulls as zero; other columns stay as they are."""
    return df.fillna(0, subset=numeric_features(df, exclude))


def fill_with_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the column mean, all means in one aggregate."""
    means = df.agg(F.struct(*[F.avg(named(c)).alias(c) for c in columns])).scalar()
    filled = df.withColumn("_means", means)
    return filled.withColumns({c: F.coalesce(named(c).cast("double"), F.col("_means").getField(c)) for c in columns}).drop("_means")


def encode_labels(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Alphabetical position of each label, starting at 0.

    The distinct labels are ranked as a table of their own and joined back, so
    neither the driver nor a single task has to hold a large code list.
    """
    name = name or f"{column}_code"
    labels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = row_index(labels, column, name)
    return df.join(codes, column, "left").select(*every(df), name)


def categorise(names: Sequence[str], fragments: Mapping[str, Sequence[str]] = CATEGORY_FRAGMENTS) -> list[tuple[str, str]]:
    """(group, column) pairs by name fragment; a column may be in several groups."""
    return [(g, n) for g, parts in fragments.items() for n in names if any(p in n for p in parts)]


