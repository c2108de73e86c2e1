"""Calendar expressions over a date column. Weekdays count from Monday = 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Harmonics and period lengths (in days) of the seasonal terms.
ANNUAL = (5, 365.25)
WEEKLY = (3, 7.0)
MONTHLY = (2, 30.44)
QUARTER_PERIOD = 91.25


def is_weekend(ds: Column) -> Column:
    return (F.weekday(ds) >= 5).cast("int")


def calendar_parts(ds: Column) -> dict[str, Column]:
    return {
        "year": F.year(ds),
        "month": F.month(ds),
        "day": F.dayofmonth(ds),
        "day_of_week": F.weekday(ds),
        "day_of_year": F.dayofyear(ds),
        "week_of_year": F.weekofyear(ds),
        "quarter": F.quarter(ds),
    }


def _months(ds: Column, *months: int) -> Column:
    return F.month(ds).isin(*months).cast("int")


def season_flags(ds: Column) -> dict[str, Column]:
    """Dry/rainy halves of the year, the two monsoons and a humidity factor."""
    rainy = _months(ds, 5, 6, 7, 8, 9, 10)
    return {
        "is_dry_season": 1 - rainy,
        "is_rainy_season": rainy,
        "is_southwest_monsoon": _months(ds, 5, 6, 7, 8, 9),
        "is_northeast_monsoon": _months(ds, 10, 11, 12, 1, 2, 3),
        "humidity_factor": F.when(rainy == 1, 1.3).otherwise(0.7),
    }


def _phase(position: Column, harmonic: int, period: float) -> Column:
    return F.lit(2 * math.pi * harmonic) * position / F.lit(period)


def temperature_cycle(ds: Column) -> dict[str, Column]:
    angle = _phase(F.dayofyear(ds), 1, ANNUAL[1])
    return {"temp_sin": F.sin(angle), "temp_cos": F.cos(angle)}


def _waves(prefix: str, position: Column, harmonics: int, period: float) -> dict[str, Column]:
    waves = {}
    for k in range(1, harmonics + 1):
        angle = _phase(position, k, period)
        waves[f"{prefix}_sin_{k}"] = F.sin(angle)
        waves[f"{prefix}_cos_{k}"] = F.cos(angle)
    return waves


def fourier_terms(ds: Column) -> dict[str, Column]:
    """The 22 sine/cosine columns: annual, weekly, monthly and quarterly."""
    day_in_quarter = ((F.month(ds) - 1) % 3) * 30 + F.dayofmonth(ds)
    angle = _phase(day_in_quarter, 1, QUARTER_PERIOD)
    return {
        **_waves("annual", F.dayofyear(ds), *ANNUAL),
        **_waves("weekly", F.weekday(ds), *WEEKLY),
        **_waves("monthly", F.dayofmonth(ds), *MONTHLY),
        "quarterly_sin": F.sin(angle),
        "quarterly_cos": F.cos(angle),
    }


def iso_text(ds: Column) -> Column:
    return F.date_format(ds, "yyyy-MM-dd")
