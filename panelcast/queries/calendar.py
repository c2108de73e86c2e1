"""Calendar, holiday, weather and demographic queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import features, holidays, places
from ..operators.features import PRODUCTS
from ..operators.keys import add
from ..sources import tables
from .joins import NEARBY_SQL, SEASON_SQL
from .registry import q6, query, rounded
from .views import with_views
from .windows import STATS, ewm_sql, full_frame, lag_sql

PARTS_SQL = """year(ds) AS year, month(ds) AS month, day(ds) AS day, isodow(ds) - 1 AS day_of_week, dayofyear(ds) AS day_of_year,
  weekofyear(ds) AS week_of_year, quarter(ds) AS quarter"""
SEASONS_SQL = """CASE WHEN month(ds) >= 11 OR month(ds) <= 4 THEN 1 ELSE 0 END AS is_dry_season,
  CASE WHEN month(ds) BETWEEN 5 AND 10 THEN 1 ELSE 0 END AS is_rainy_season,
  CASE WHEN month(ds) BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS is_southwest_monsoon,
  CASE WHEN month(ds) >= 10 OR month(ds) <= 3 THEN 1 ELSE 0 END AS is_northeast_monsoon"""
TEMPERATURE_SQL = f"{q6('sin(2 * pi() * dayofyear(ds) / 365.25::DOUBLE)', 'temp_sin')}, {q6('cos(2 * pi() * dayofyear(ds) / 365.25::DOUBLE)', 'temp_cos')}"
HUMIDITY_SQL = f"{q6('CASE WHEN month(ds) BETWEEN 5 AND 10 THEN 1.3 ELSE 0.7 END', 'humidity_factor')}"
CLIMATE_SQL = f"""{q6("CASE WHEN location = 'Ha Noi' THEN 1.5 WHEN location = 'Da Nang' THEN 1.2 ELSE 0.8 END", 'climate_temp_variation')},
  {q6("CASE WHEN location = 'Ha Noi' THEN 1.0 WHEN location = 'Da Nang' THEN 1.4 ELSE 1.2 END", 'climate_humidity_base')}"""
RISK_SQL = """CASE WHEN month(ds) IN (4, 5, 6) AND location IN ('Ho Chi Minh City', 'Da Nang') THEN 1 ELSE 0 END AS extreme_heat_risk,
  CASE WHEN month(ds) IN (7, 8, 9, 10) AND location IN ('Ho Chi Minh City', 'Can Tho') THEN 1 ELSE 0 END AS flood_risk_season"""
POPULATION_SQL = """CASE location WHEN 'Ho Chi Minh City' THEN 9000 WHEN 'Ha Noi' THEN 8000 WHEN 'Da Nang' THEN 1200 WHEN 'Can Tho' THEN 1200 ELSE 1000 END AS population,
  CASE WHEN location IN ('Ho Chi Minh City', 'Ha Noi') THEN 'large' ELSE 'small' END AS population_category,
  CASE WHEN location IN ('Ho Chi Minh City', 'Ha Noi') THEN 1 ELSE 0 END AS is_major_city,
  CASE WHEN location IN ('Ho Chi Minh City', 'Da Nang') THEN 1 ELSE 0 END AS is_coastal_city,
  CASE WHEN location IN ('Ho Chi Minh City', 'Can Tho') THEN 1 ELSE 0 END AS is_delta_region,
  CASE WHEN location IN ('Ho Chi Minh City', 'Ha Noi') THEN 1 ELSE 0 END AS is_economic_hub,
  CASE WHEN location IN ('Da Nang') THEN 1 ELSE 0 END AS is_industrial_city,
  CASE WHEN location IN ('Ho Chi Minh City', 'Da Nang') THEN 1 ELSE 0 END AS is_tourism_city"""
FACTORS_SQL = f"""{q6("CASE location WHEN 'Ho Chi Minh City' THEN 1.5 WHEN 'Ha Noi' THEN 1.4 WHEN 'Da Nang' THEN 1.1 WHEN 'Can Tho' THEN 0.9 ELSE 1.0 END", 'healthcare_capacity_factor')},
  {q6("CASE WHEN location IN ('Ho Chi Minh City', 'Ha Noi') THEN 1.2 ELSE 1.0 END", 'elderly_population_factor')},
  {q6("CASE WHEN location IN ('Ho Chi Minh City', 'Ha Noi') THEN 1.3 ELSE 1.0 END", 'working_age_factor')}"""
HOLIDAY_NAMES = {
    "tet": "is_tet_period", "kings": "is_hung_kings_day", "liberation": "is_liberation_day",
    "labor": "is_labor_day", "national": "is_national_day", "autumn": "is_mid_autumn",
}
HOLIDAY_SQL = (
    ", ".join(f"CAST(EXISTS (SELECT 1 FROM holidays WHERE h = c.ds AND holiday = '{k}') AS BIGINT) AS {v}" for k, v in HOLIDAY_NAMES.items())
    + ", CAST(EXISTS (SELECT 1 FROM holidays WHERE h = c.ds) AS BIGINT) AS is_major_holiday"
)


def wave_sql(prefix: str, position: str, harmonics: int, period: float) -> list[str]:
    out = []
    for k in range(1, harmonics + 1):
        for f in ("sin", "cos"):
            name = f"{prefix}_{f}" if prefix == "quarterly" else f"{prefix}_{f}_{k}"
            out.append(q6(f"{f}(2 * pi() * {k} * ({position}) / {period}::DOUBLE)", name))
    return out


FOURIER_SQL = ", ".join(
    wave_sql("annual", "dayofyear(ds)", 5, 365.25)
    + wave_sql("weekly", "isodow(ds) - 1", 3, 7.0)
    + wave_sql("monthly", "day(ds)", 2, 30.44)
    + wave_sql("quarterly", "((month(ds) - 1) % 3) * 30 + day(ds)", 1, 91.25)
)


def days(spark, sf):
    return tables.city_series(spark, sf).select("location", "ds")


@query("c01_calendar_parts", with_views(f"SELECT location, ds, {PARTS_SQL} FROM cities", "cities"))
def c01(spark, sf):
    return rounded(add(days(spark, sf), dates.calendar_parts(F.col("ds"))))


@query("c02_weekend", with_views("SELECT location, ds, is_weekend, 0 AS is_holiday FROM cities", "cities"))
def c02(spark, sf):
    return rounded(days(spark, sf).withColumns({"is_weekend": dates.is_weekend(F.col("ds")), "is_holiday": F.lit(0)}))


@query("c03_holiday_flags", with_views(f"SELECT location, ds, {HOLIDAY_SQL} FROM cities c", "cities", "holidays"))
def c03(spark, sf):
    flags = holidays.flags_by_day(holidays.holiday_table(spark))
    return rounded(holidays.attach_by_day(days(spark, sf), flags))


@query("c04_near_holidays", with_views(f"SELECT location, ds, {NEARBY_SQL} FROM cities c", "cities", "holidays"))
def c04(spark, sf):
    effects = holidays.holiday_effects(days(spark, sf))
    return rounded(effects.select("location", "ds", "pre_holiday", "post_holiday", "on_holiday"))


@query("c05_festival_season", with_views(f"SELECT location, ds, {SEASON_SQL} FROM cities c", "cities", "holidays"))
def c05(spark, sf):
    return rounded(holidays.holiday_effects(days(spark, sf)).select("location", "ds", "is_tet_season"))


@query("c06_seasons", with_views(f"SELECT location, ds, {SEASONS_SQL} FROM cities", "cities"))
def c06(spark, sf):
    return rounded(add(days(spark, sf), dates.season_flags(F.col("ds"))).drop("humidity_factor"))


@query("c07_temperature_cycle", with_views(f"SELECT location, ds, {TEMPERATURE_SQL} FROM cities", "cities"))
def c07(spark, sf):
    return rounded(add(days(spark, sf), dates.temperature_cycle(F.col("ds"))))


@query("c08_humidity", with_views(f"SELECT location, ds, {HUMIDITY_SQL} FROM cities", "cities"))
def c08(spark, sf):
    return rounded(days(spark, sf).withColumn("humidity_factor", dates.season_flags(F.col("ds"))["humidity_factor"]))


@query("c09_climate_zone", with_views(f"SELECT location, ds, {CLIMATE_SQL} FROM cities", "cities"))
def c09(spark, sf):
    return rounded(add(days(spark, sf), places.climate_columns(F.col("location"))))


@query("c10_weather_risk", with_views(f"SELECT location, ds, {RISK_SQL} FROM cities", "cities"))
def c10(spark, sf):
    return rounded(add(days(spark, sf), places.risk_columns(F.col("location"), F.col("ds"))))


@query("c11_population", with_views(f"SELECT location, ds, {POPULATION_SQL} FROM cities", "cities"))
def c11(spark, sf):
    place = F.col("location")
    return rounded(add(days(spark, sf), {**places.population_columns(place), **places.group_columns(place)}))


@query("c12_capacity_factors", with_views(f"SELECT location, ds, {FACTORS_SQL} FROM cities", "cities"))
def c12(spark, sf):
    return rounded(add(days(spark, sf), places.infrastructure_columns(F.col("location"))))


WIDE_SQL = f"""wide AS (SELECT location, ds, y, disease_severity, is_weekend, {PARTS_SQL.replace('year(ds) AS year, ', '').replace('day(ds) AS day, ', '')},
  {HOLIDAY_SQL}, {NEARBY_SQL}, {SEASON_SQL}, {SEASONS_SQL}, {TEMPERATURE_SQL}, {HUMIDITY_SQL}, {CLIMATE_SQL}, {RISK_SQL}, {POPULATION_SQL}, {FACTORS_SQL}
  FROM cities c)"""
WHOLE_PRODUCTS = [n for n in PRODUCTS if not n.startswith("capacity")]
PRODUCTS_SQL = ", ".join(
    [f"CAST({PRODUCTS[n][0]} * {PRODUCTS[n][1]} AS BIGINT) AS {n}" for n in WHOLE_PRODUCTS]
    + [q6(f"{PRODUCTS[n][0]} * {PRODUCTS[n][1]}", n) for n in PRODUCTS if n not in WHOLE_PRODUCTS]
    + [q6("month * population / 1000", "month_population")]
)


def after_views(body: str, clause: str, *views: str) -> str:
    """Views, one more WITH clause, then the body."""
    return with_views("@@", *views).replace("\n@@", f",\n{clause}\n{body}")


@query("c13_interactions", after_views(f"SELECT location, ds, {PRODUCTS_SQL} FROM wide", WIDE_SQL, "cities", "holidays"))
def c13(spark, sf):
    series = tables.city_series(spark, sf)
    wide = places.demographic_features(places.weather_features(holidays.holiday_effects(series)))
    columns = [*WHOLE_PRODUCTS, *[n for n in PRODUCTS if n not in WHOLE_PRODUCTS], "month_population"]
    return rounded(features.interaction_features(wide).select("location", "ds", *columns))


@query("c14_fourier", with_views(f"SELECT location, ds, {FOURIER_SQL} FROM cities", "cities"))
def c14(spark, sf):
    return rounded(add(days(spark, sf), dates.fourier_terms(F.col("ds"))))


@query("c15_severity", with_views(f"SELECT location, ds, {q6('disease_severity')} FROM daily", "daily"))
def c15(spark, sf):
    return rounded(tables.daily(spark, sf).select("location", "ds", "disease_severity"))


LAGGED_SQL = ", ".join(
    [lag_sql((1, 7, 14, 30), "y_lag_")]
    + [f"{full_frame(s, n)} AS y_rolling_{s}_{n}" for n in (7, 14, 30) for s in STATS]
    + [f"y - lag(y, {k}) OVER (PARTITION BY location ORDER BY ds) AS y_trend_{k}d" for k in (7, 30)]
    + [f"{full_frame('std', n)} AS y_volatility_{n}d" for n in (7, 30)]
)
WHOLE_LAGGED = [f"y_lag_{k}" for k in (1, 7, 14, 30)] + [f"y_rolling_{s}_{n}" for n in (7, 14, 30) for s in ("min", "max")] + ["y_trend_7d", "y_trend_30d"]
REAL_LAGGED = [f"y_rolling_{s}_{n}" for n in (7, 14, 30) for s in ("mean", "std")] + ["y_volatility_7d", "y_volatility_30d"]


def filled_sql(name: str) -> str:
    order = "PARTITION BY location ORDER BY ds"
    first = f"first_value({name} IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce(last_value({name} IGNORE NULLS) OVER ({order}), {first})"


FULL_SQL = after_views(
    f"""SELECT w.* EXCLUDE (disease_severity), {q6('w.disease_severity', 'disease_severity')}, {PRODUCTS_SQL}, {FOURIER_SQL.replace('(ds)', '(w.ds)')}, l.* EXCLUDE (location, ds), {', '.join(f'e."y_ema_{a}"' for a in (0.1, 0.3, 0.5))}
        FROM wide w JOIN (SELECT location, ds, {', '.join(f'{filled_sql(n)} AS {n}' for n in WHOLE_LAGGED)}, {', '.join(q6(filled_sql(n), n) for n in REAL_LAGGED)} FROM lagged) l
          ON w.location = l.location AND w.ds = l.ds JOIN ewm e ON w.location = e.location AND w.ds = e.ds""",
    f"""{WIDE_SQL},
lagged AS (SELECT location, ds, {LAGGED_SQL} FROM cities),
ewm AS (SELECT location, ds, {', '.join(ewm_sql(a) for a in (0.1, 0.3, 0.5))} FROM
  (SELECT location, ds, list(CAST(y AS DOUBLE)) OVER (PARTITION BY location ORDER BY ds ROWS BETWEEN 400 PRECEDING AND CURRENT ROW) AS h FROM cities))""",
    "cities",
    "holidays",
)


@query("c16_all_features", FULL_SQL)
def c16(spark, sf):
    return rounded(features.all_features(tables.city_series(spark, sf)))

