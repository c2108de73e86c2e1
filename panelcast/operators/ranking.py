"""Top rows, first and last rows per series, and cuts relative to the latest day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .keys import as_list, series_window

Key = str | Sequence[str]


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First rows of a total order; each task keeps only its own n best."""
    return df.orderBy(*order).limit(n)


def top_per_key(df: DataFrame, n: int, key: Key, *order: Column) -> DataFrame:
    """First n rows per key. Spark cuts each task to n per key before the shuffle."""
    w = Window.partitionBy(*as_list(key)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_days(df: DataFrame, n: int, key: Key = "location", ds: str = "ds") -> DataFrame:
    return top_per_key(df, n, key, F.asc(ds))


def last_rows(df: DataFrame, n: int, key: Key = "location", ds: str = "ds") -> DataFrame:
    return top_per_key(df, n, key, F.desc(ds))


def recent_days(df: DataFrame, days: int = 60, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Rows from so many days before the series' latest day onwards."""
    latest = F.max(ds).over(Window.partitionBy(*as_list(key)))
    return df.withColumn("_latest", latest).filter(F.col(ds) >= F.date_sub("_latest", days)).drop("_latest")


def importance_rank(df: DataFrame, key: Key, score: str = "importance", name: str = "feature") -> DataFrame:
    w = Window.partitionBy(*as_list(key)).orderBy(F.desc(score), F.asc(name))
    return df.withColumn("rank", F.row_number().over(w))


def row_positions(df: DataFrame, key: Key = "location", ds: str = "ds") -> DataFrame:
    """0-based position and length of each series."""
    return df.withColumn("r", F.row_number().over(series_window(key, ds)) - 1).withColumn(
        "n", F.count("*").over(Window.partitionBy(*as_list(key)))
    )
