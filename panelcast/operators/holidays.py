"""Holiday flags, neighbourhood effects and the festival season.

The interval conditions are never evaluated as range joins: each holiday is
unrolled into the days it touches, the flags are combined per day, and the
panel picks them up with one equi-join on the date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .keys import every

# Calendar of holidays.
HOLIDAYS = {
    "tet_lunar_new_year": [
        "2023-01-22", "2023-01-23", "2023-01-24", "2023-01-25", "2023-01-26",
        "2024-02-10", "2024-02-11", "2024-02-12", "2024-02-13", "2024-02-14",
    ],
    "hung_kings_day": ["2023-04-29", "2024-04-18"],
    "liberation_day": ["2023-04-30", "2024-04-30"],
    "labor_day": ["2023-05-01", "2024-05-01"],
    "national_day": ["2023-09-02", "2024-09-02"],
    "mid_autumn_festival": ["2023-09-29", "2024-09-17"],
}

# Flag column per holiday, the festival with a season, and reach in days.
FLAGS = {
    "tet_lunar_new_year": "is_tet_period",
    "hung_kings_day": "is_hung_kings_day",
    "liberation_day": "is_liberation_day",
    "labor_day": "is_labor_day",
    "national_day": "is_national_day",
    "mid_autumn_festival": "is_mid_autumn",
}
FESTIVAL = "tet_lunar_new_year"
SEASON_BEFORE, SEASON_AFTER = 14, 7
NEARBY = 3


def holiday_table(spark: SparkSession, holidays: Mapping[str, Sequence[str]] = HOLIDAYS) -> DataFrame:
    rows = [(name, dt.date.fromisoformat(day)) for name, days in holidays.items() for day in days]
    names, days = (list(column) for column in zip(*rows))
    return spark.createDataFrame(pa.table({"holiday": pa.array(names), "ds": pa.array(days, pa.date32())}))


def flags_by_day(holidays: DataFrame, flags: Mapping[str, str] = FLAGS) -> DataFrame:
    marks = [F.max((F.col("holiday") == name).cast("int")).alias(flag) for name, flag in flags.items()]
    return holidays.groupBy("ds").agg(*marks).withColumn("is_major_holiday", F.greatest(*flags.values()))


def nearby_by_day(holidays: DataFrame, reach: int = NEARBY) -> DataFrame:
    """Per day: a holiday follows, a holiday went before, or it is one itself."""
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    touched = holidays.select(F.col("ds").alias("_h"), offsets.alias("_k"))
    return touched.groupBy(F.date_add("_h", F.col("_k")).alias("ds")).agg(
        F.max((F.col("_k") < 0).cast("int")).alias("pre_holiday"),
        F.max((F.col("_k") > 0).cast("int")).alias("post_holiday"),
        F.max((F.col("_k") == 0).cast("int")).alias("on_holiday"),
    )


def season_by_day(
    holidays: DataFrame, festival: str = FESTIVAL, before: int = SEASON_BEFORE, after: int = SEASON_AFTER, name: str = "is_tet_season"
) -> DataFrame:
    span = F.sequence(F.date_sub("ds", before), F.date_add("ds", after))
    days = holidays.filter(F.col("holiday") == festival).select(F.explode(span).alias("ds"))
    return days.distinct().withColumn(name, F.lit(1))


def effects_by_day(holidays: DataFrame, flags: Mapping[str, str] = FLAGS, festival: str = FESTIVAL) -> DataFrame:
    """All holiday columns per day from one unroll and one aggregate."""
    first, last = -max(SEASON_BEFORE, NEARBY), max(SEASON_AFTER, NEARBY)
    offsets = F.explode(F.sequence(F.lit(first), F.lit(last)))
    touched = holidays.select("holiday", F.col("ds").alias("_h"), offsets.alias("_k"))
    k = F.col("_k")
    marks = {
        "pre_holiday": k.between(-NEARBY, -1),
        "post_holiday": k.between(1, NEARBY),
        "on_holiday": k == 0,
        **{flag: (k == 0) & (F.col("holiday") == name) for name, flag in flags.items()},
        "is_major_holiday": k == 0,
        "is_tet_season": (F.col("holiday") == festival) & k.between(-SEASON_BEFORE, SEASON_AFTER),
    }
    return touched.groupBy(F.date_add("_h", k).alias("ds")).agg(*[F.max(m.cast("int")).alias(n) for n, m in marks.items()])


def attach_by_day(panel: DataFrame, by_day: DataFrame, ds: str = "ds") -> DataFrame:
    """Left join on the day, zero where the day has no entry. Spark's size estimate picks the join."""
    flags = [c for c in by_day.columns if c != "ds"]
    side = by_day.withColumnRenamed("ds", ds)
    joined = panel.join(side, ds, "left")
    return joined.select(*every(panel), *[F.coalesce(c, F.lit(0)).alias(c) for c in flags])


def holiday_effects(
    panel: DataFrame,
    holidays: Mapping[str, Sequence[str]] | DataFrame = HOLIDAYS,
    flags: Mapping[str, str] = FLAGS,
    festival: str = FESTIVAL,
    ds: str = "ds",
) -> DataFrame:
    """All holiday columns with a single join, from a calendar in code or in a table."""
    table = holidays if isinstance(holidays, DataFrame) else holiday_table(panel.sparkSession, holidays)
    return attach_by_day(panel, effects_by_day(table, flags, festival), ds)


def is_member(panel: DataFrame, days: DataFrame, name: str, ds: str = "ds") -> DataFrame:
    """1 where the row's day is listed, else 0."""
    listed = days.select(F.col("ds").alias(ds)).distinct().withColumn(name, F.lit(1))
    return panel.join(listed, ds, "left").select(*every(panel), F.coalesce(name, F.lit(0)).alias(name))


def recurring(name: str, month_day: str, years: Sequence[int]) -> dict[str, list[str]]:
    """Calendar entry repeating on the same month and day."""
    return {name: [f"{year}-{month_day}" for year in years]}

