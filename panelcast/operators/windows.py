"""Lag, rolling, exponential and fill operators along each series.

All of them use the same ordered window per series, so Spark plans one
exchange and one sort and evaluates every frame on the sorted rows. Frames
count rows, which equal days on gap-filled panels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .keys import add, as_list, series_window

Key = str | Sequence[str]

# Lags, rolling lengths and smoothing factors of the feature set.
LAGS = (1, 7, 14, 30)
ROLLING = (7, 14, 30)
ALPHAS = (0.1, 0.3, 0.5)
SPANS = (7, 30)

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_columns(df: DataFrame, lags: Sequence[int] = LAGS, prefix: str = "lag_", key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    w = series_window(key, ds)
    return add(df, {f"{prefix}{k}": F.lag(y, k).over(w) for k in lags})


def rolling_stat(stat: str, rows: int, y: str, key: Key, ds: str, full: bool = False, shift: int = 0) -> Column:
    """Statistic over the last ``rows`` rows.

    ``full`` gives null until that many non-null values are in the frame;
    ``shift=1`` leaves the current row out, which keeps a feature free of its
    own target.
    """
    frame = series_window(key, ds).rowsBetween(-(rows - 1) - shift, -shift)
    value = STATS[stat](y).over(frame)
    return F.when(F.count(y).over(frame) >= rows, value) if full else value


def rolling_columns(
    df: DataFrame,
    lengths: Sequence[int] = ROLLING,
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    prefix: str = "y_rolling_",
    full: bool = True,
    shift: int = 0,
    key: Key = "location",
    ds: str = "ds",
    y: str = "y",
) -> DataFrame:
    return add(df, {f"{prefix}{s}_{n}": rolling_stat(s, n, y, key, ds, full, shift) for n in lengths for s in stats})


def moving_averages(df: DataFrame, lengths: Sequence[int] = (7, 30), key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    return add(df, {f"ma_{n}_days": rolling_stat("mean", n, y, key, ds) for n in lengths})


def leak_free_rolling(df: DataFrame, lengths: Sequence[int] = ROLLING, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    return rolling_columns(df, lengths, ("mean", "std"), "rolling_", full=False, shift=1, key=key, ds=ds, y=y)


def trend_columns(df: DataFrame, spans: Sequence[int] = SPANS, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    w = series_window(key, ds)
    return add(df, {f"y_trend_{k}d": F.col(y) - F.lag(y, k).over(w) for k in spans})


def volatility_columns(df: DataFrame, spans: Sequence[int] = SPANS, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    return add(df, {f"y_volatility_{n}d": rolling_stat("std", n, y, key, ds, full=True) for n in spans})


def ewm_columns(df: DataFrame, alphas: Sequence[float] = ALPHAS, prefix: str = "y_ema_", key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Exponentially weighted means with adjusted weights.

    A row's weighted sum is split into the part from its own block of rows and
    the part from the block before. Inside a block the weights are taken
    relative to the block start, which turns the sum into a plain running sum;
    the earlier block enters through its total. Blocks are long enough that
    anything older weighs less than 1e-17 beside the row's own value, and short
    enough that the rescaling stays far from overflow. A row without a value
    keeps the mean of the last row with one, however far back, since all weights
    shrink alike. A factor of 1 is the last value. Work per row is constant.
    """
    keys = as_list(key)
    fading = [a for a in alphas if a < 1]
    block = math.ceil(max((-17 * math.log(10) / math.log1p(-a) for a in fading), default=1))
    if any(block * -math.log10(1 - a) > 300 for a in fading):
        raise ValueError("smoothing factors too far apart for one pass; split them over two calls")
    rows = df.withColumn("_r", F.row_number().over(series_window(keys, ds)) - 1)
    rows = rows.withColumns({"_b": F.floor(F.col("_r") / block), "_o": F.col("_r") % block})
    running = Window.partitionBy(*keys, "_b").orderBy(ds).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
    terms = {"_v": F.coalesce(F.col(y).cast("double"), F.lit(0.0)), "_w": F.col(y).isNotNull().cast("double")}
    sums = {}
    for number, alpha in enumerate(fading):
        keep = F.lit(1 - alpha)
        for name, term in terms.items():
            near = F.sum(term * F.pow(keep, -F.col("_o"))).over(running) * F.pow(keep, F.col("_o"))
            far = F.sum(term * F.pow(keep, (block - 1) - F.col("_o"))).over(before) * F.pow(keep, F.col("_o") + 1)
            sums[f"{name}{number}"] = near + F.coalesce(far, F.lit(0.0))
    so_far = series_window(keys, ds).rowsBetween(Window.unboundedPreceding, 0)
    means = {a: F.try_divide(f"_v{i}", f"_w{i}") for i, a in enumerate(fading)}
    at_values = {f"{prefix}{a}": F.when(F.col(y).isNotNull(), means.get(a, F.col(y).cast("double"))) for a in alphas}
    held = {name: F.last(value, ignorenulls=True).over(so_far) for name, value in at_values.items()}
    return add(add(rows, sums), held).drop("_r", "_b", "_o", *sums)


def row_trend(df: DataFrame, name: str = "trend", key: Key = "location", ds: str = "ds") -> DataFrame:
    return df.withColumn(name, F.row_number().over(series_window(key, ds)) - 1)


def first_difference(df: DataFrame, name: str = "y_diff", key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Change from the row before; each series loses its first row."""
    changed = df.withColumn(name, F.col(y) - F.lag(y).over(series_window(key, ds)))
    return changed.filter(F.col(name).isNotNull())


def daily_increase(df: DataFrame, y: str, name: str, key: Key, ds: str = "ds") -> DataFrame:
    """Change from the row before; the first value passes through."""
    previous = F.lag(y).over(series_window(key, ds))
    return df.withColumn(name, F.coalesce(F.col(y) - previous, F.col(y)))


def forward_average(df: DataFrame, y: str, name: str, rows: int, key: Key, ds: str = "ds") -> DataFrame:
    """Mean of the current and following rows, over fewer rows near the end."""
    return df.withColumn(name, F.avg(y).over(series_window(key, ds).rowsBetween(0, rows - 1)))


def fill_forward_back(df: DataFrame, columns: Sequence[str], key: Key = "location", ds: str = "ds") -> DataFrame:
    """Last value before, else the first value of the series.

    After a forward fill only leading nulls are left, and those all take the
    first known value, so the whole-series frame replaces a backward scan.
    """
    order = f"PARTITION BY {', '.join(f'`{k}`' for k in as_list(key))} ORDER BY `{ds}`"
    back = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    fill = "coalesce(last(`{0}`) IGNORE NULLS {1}, first(`{0}`) IGNORE NULLS {2})"
    return add(df, {c: F.expr(fill.format(c, back, whole)) for c in columns})


def interpolate(df: DataFrame, y: str = "y", key: Key = "location", ds: str = "ds") -> DataFrame:
    """Linear interpolation of null values on a daily panel, rounded half to even.

    Nulls after the last value hold it, nulls before the first one take it.
    The look-ahead runs on a descending sort so both frames grow by one row at
    a time.
    """
    keys = as_list(key)
    point = F.when(F.col(y).isNotNull(), F.struct(F.col(ds).alias("d"), F.col(y).cast("double").alias("v")))
    so_far = Window.unboundedPreceding
    left = F.last(point, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(ds).rowsBetween(so_far, 0))
    right = F.last(point, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(ds)).rowsBetween(so_far, 0))
    sides = df.withColumn("_l", left).withColumn("_r", right)
    lv, rv, ld, rd = F.col("_l.v"), F.col("_r.v"), F.col("_l.d"), F.col("_r.d")
    between = lv + (rv - lv) * F.datediff(F.col(ds), ld) / F.datediff(rd, ld)
    filled = F.when(F.col(y).isNotNull(), F.col(y).cast("double")).when(
        F.col("_l").isNotNull() & F.col("_r").isNotNull(), between
    ).otherwise(F.coalesce(lv, rv))
    return sides.withColumn(y, F.bround(filled).cast("long")).drop("_l", "_r")


def split_last_rows(df: DataFrame, rows: int = 30, name: str = "is_test", key: Key = "location", ds: str = "ds") -> DataFrame:
    """Mark the last rows of each series as the hold-out part.

    Counted as position against series length, both on the ascending sort.
    """
    w = series_window(key, ds)
    length = F.count("*").over(Window.partitionBy(*as_list(key)))
    return df.withColumn(name, F.row_number().over(w) > length - rows)
