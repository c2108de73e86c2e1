"""Climate, population and infrastructure columns looked up per place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import calendar_parts, season_flags, temperature_cycle
from .clean import bin_right_closed
from .keys import add, lookup

# Inhabitants in thousands, and the number taken for other places.
POPULATION_THOUSANDS = {
    "Ho Chi Minh City": 9000,
    "Ha Noi": 8000,
    "Hai Phong": 2000,
    "Da Nang": 1200,
    "Can Tho": 1200,
}
DEFAULT_THOUSANDS = 1000
POPULATION_EDGES = (0, 1500, 3000, 10000)
POPULATION_LABELS = ("small", "medium", "large")
MAJOR_CITY = 3000

# Climate zone per place; temperature spread and base humidity per zone.
CLIMATE_ZONE = {
    "Ho Chi Minh City": "tropical",
    "Ha Noi": "subtropical",
    "Hai Phong": "subtropical",
    "Da Nang": "tropical_monsoon",
    "Can Tho": "tropical",
}
ZONE_TEMPERATURE = {"tropical": 0.8, "subtropical": 1.5, "tropical_monsoon": 1.2}
ZONE_HUMIDITY = {"tropical": 1.2, "subtropical": 1.0, "tropical_monsoon": 1.4}

# Places and months with heat and flood risk.
HEAT_MONTHS, HEAT_PLACES = (4, 5, 6), ("Ho Chi Minh City", "Da Nang")
FLOOD_MONTHS, FLOOD_PLACES = (7, 8, 9, 10), ("Ho Chi Minh City", "Can Tho")

# Groups of places, and health-care capacity relative to 1.
GROUPS = {
    "is_coastal_city": ("Ho Chi Minh City", "Hai Phong", "Da Nang"),
    "is_delta_region": ("Ho Chi Minh City", "Can Tho"),
    "is_economic_hub": ("Ho Chi Minh City", "Ha Noi"),
    "is_industrial_city": ("Hai Phong", "Da Nang"),
    "is_tourism_city": ("Da Nang", "Ho Chi Minh City"),
}
CAPACITY_FACTOR = {
    "Ho Chi Minh City": 1.5,
    "Ha Noi": 1.4,
    "Da Nang": 1.1,
    "Hai Phong": 1.0,
    "Can Tho": 0.9,
}


def climate_columns(place: Column) -> dict[str, Column]:
    zone = lookup(place, CLIMATE_ZONE, "tropical")
    return {
        "climate_temp_variation": lookup(zone, ZONE_TEMPERATURE),
        "climate_humidity_base": lookup(zone, ZONE_HUMIDITY),
    }


def risk_columns(place: Column, ds: Column) -> dict[str, Column]:
    month = F.month(ds)
    return {
        "extreme_heat_risk": (month.isin(*HEAT_MONTHS) & place.isin(*HEAT_PLACES)).cast("int"),
        "flood_risk_season": (month.isin(*FLOOD_MONTHS) & place.isin(*FLOOD_PLACES)).cast("int"),
    }


def weather_columns(place: Column, day: Column) -> dict[str, Column]:
    parts = {k: v for k, v in calendar_parts(day).items() if k in {"month", "quarter", "day_of_year", "week_of_year"}}
    columns = {**parts, **season_flags(day), **temperature_cycle(day), **climate_columns(place)}
    return {**columns, **risk_columns(place, day)}


def weather_features(df: DataFrame, key: str = "location", ds: str = "ds") -> DataFrame:
    return add(df, weather_columns(F.col(key), F.col(ds)))


def group_columns(place: Column) -> dict[str, Column]:
    return {name: place.isin(*members).cast("int") for name, members in GROUPS.items()}


def population_columns(place: Column, population: Mapping[str, int] = POPULATION_THOUSANDS) -> dict[str, Column]:
    size = lookup(place, population, DEFAULT_THOUSANDS)
    return {
        "population": size,
        "population_category": bin_right_closed(size, POPULATION_EDGES, POPULATION_LABELS),
        "is_major_city": (size >= MAJOR_CITY).cast("int"),
    }


def infrastructure_columns(place: Column) -> dict[str, Column]:
    major = lookup(place, POPULATION_THOUSANDS, DEFAULT_THOUSANDS) >= MAJOR_CITY
    return {
        "healthcare_capacity_factor": lookup(place, CAPACITY_FACTOR, 1.0),
        "elderly_population_factor": F.when(major, 1.2).otherwise(1.0),
        "working_age_factor": F.when(place.isin(*GROUPS["is_economic_hub"]), 1.3).otherwise(1.0),
    }


def demographic_columns(place: Column) -> dict[str, Column]:
    return {**population_columns(place), **group_columns(place), **infrastructure_columns(place)}


def demographic_features(df: DataFrame, key: str = "location") -> DataFrame:
    return add(df, demographic_columns(F.col(key)))


def dimension_join(df: DataFrame, dimension: DataFrame, key: str = "location", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join to a dimension given as data, with defaults for unknown keys.

    No broadcast hint: Spark broadcasts a side whose size it has checked
    against its threshold, and shuffles both sides beyond that.
    """
    joined = df.join(dimension, key, "left")
    if not defaults:
        return joined
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
