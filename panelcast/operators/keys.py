"""Shared helpers for series keys, ordered windows and fixed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..sources.files import checkpointed

def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def named(column: str) -> Column:
    """Column by its literal name, dots included (``y_ema_0.5``)."""
    return F.col(f"`{column}`")


def every(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def series_window(key: str | Sequence[str], ds: str = "ds") -> WindowSpec:
    """One ordered partition per series.

    Panels hold one row per series and day, so a partition is never longer
    than the calendar however skewed the raw records were.
    """
    return Window.partitionBy(*as_list(key)).orderBy(ds)


def add(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


def lookup(key: Column, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup as a map literal, with a default for unknown keys."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def row_index(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """0-based global row number along an orderable column; ties in no set order.

    Range partitioning puts the rows into ordered partitions, written once so
    that all later reads see the same bounds, and each is numbered by itself. One
    row per partition carries the running offset, so no task sees more than its
    range.
    """
    ranged = checkpointed(df.repartitionByRange(order).withColumn("_slice", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(order)) - 1
    counts = ranged.groupBy("_slice").agg(F.count("*").alias("n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return (
        ranged.withColumn("_inside", inside)
        .join(starts, "_slice")
        .withColumn(name, F.col("_inside") + F.col("_start"))
        .drop("_slice", "_inside", "_start")
    )
