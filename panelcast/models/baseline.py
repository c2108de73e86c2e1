"""Historical-average forecaster, future calendars and served forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import is_weekend
from ..operators.keys import as_list
from ..operators.windows import split_last_rows

Key = str | Sequence[str]

# Weekend factor, value without any history, share of the default
# band around a forecast, and the normal quantile of a 95 % band.
WEEKEND_FACTOR = 0.85
NO_HISTORY = 5.0
BAND_SHARE = 0.2
Z95 = 1.96
HORIZON = 14
MAX_HORIZON = 90
LAST_ROWS = 30


def future_days(series: DataFrame, periods: int = HORIZON, key: Key = "location", ds: str = "ds", shared_origin: bool = False) -> DataFrame:
    """The next days of every series with their calendar regressors.

    Days follow the series' own last day, or the latest day of all series with
    ``shared_origin``.
    """
    ends = series.groupBy(*as_list(key)).agg(F.max(ds).alias("_end"))
    if shared_origin:
        ends = ends.withColumn("_end", series.agg(F.max(ds)).scalar())
    return extend(ends, periods, "_end", ds).withColumns({"is_weekend": is_weekend(F.col(ds)), "month": F.month(ds)})


def extend(ends: DataFrame, periods: int, end: str, ds: str = "ds") -> DataFrame:
    """Unroll each row into the days after its end day, with the step number."""
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return steps.withColumn(ds, F.date_add(end, F.col("step"))).drop(end)


def weekday_factor(ds: Column) -> Column:
    return F.when(is_weekend(ds) == 1, WEEKEND_FACTOR).otherwise(1.0)


def mean_forecast(series: DataFrame, periods: int = HORIZON, key: Key = "location", ds: str = "ds", y: str = "y", shared_origin: bool = False) -> DataFrame:
    """Series mean, lowered on weekends."""
    levels = series.groupBy(*as_list(key)).agg(F.avg(y).alias("_level"), F.max(ds).alias("_end"))
    if shared_origin:
        levels = levels.withColumn("_end", series.agg(F.max(ds)).scalar())
    days = extend(levels, periods, "_end", ds)
    yhat = F.col("_level") * weekday_factor(F.col(ds))
    return days.select(*as_list(key), ds, "step", yhat.alias("yhat"), F.lit("historical_average").alias("model"))


def requested_forecast(series: DataFrame, requests: DataFrame, periods: int = HORIZON, key: str = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Forecast for requested keys, known or not.

    An unknown key gets the mean of all series; without any history at all the
    fixed level is used from today on. Days follow the latest day overall.
    """
    levels = series.groupBy(key).agg(F.avg(y).alias("_level"))
    overall = series.agg(F.struct(F.avg(y).alias("level"), F.max(ds).alias("end"))).scalar()
    joined = requests.join(levels, key, "left").withColumn("_all", overall)
    joined = joined.withColumn("_end", F.coalesce("_all.end", F.current_date()))
    days = extend(joined, periods, "_end", ds)
    known = F.round(F.coalesce("_level", "_all.level") * weekday_factor(F.col(ds)), 2)
    no_history = F.col("_all.level").isNull()
    return days.select(
        key,
        ds,
        F.coalesce(known, F.lit(NO_HISTORY)).alias("yhat"),
        F.when(no_history, "fallback").otherwise("historical_average").alias("model"),
    )


def holdout_forecast(series: DataFrame, test_rows: int = LAST_ROWS, min_train: int = 30, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predict the last rows of every series from the rows before them.

    The training mean is a conditional aggregate over the series, so actuals
    and predictions come out aligned from one window pass.
    """
    whole = Window.partitionBy(*as_list(key))
    marked = split_last_rows(series, test_rows, "_test", key, ds)
    level = F.avg(F.when(~F.col("_test"), F.col(y))).over(whole)
    scored = marked.withColumns({"_level": level, "_n": F.count("*").over(whole)})
    scored = scored.filter(F.col("_test") & (F.col("_n") >= test_rows + min_train))
    yhat = F.col("_level") * weekday_factor(F.col(ds))
    return scored.select(*as_list(key), ds, F.col(y).alias("actual"), yhat.alias("yhat"))


def served(forecasts: DataFrame, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Forecast rows as handed out: not negative, two decimals, band defaulted."""
    yhat = F.col("yhat")

    def shown(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.round(value, 2))

    low = yhat * (1 - BAND_SHARE) if lower is None else F.coalesce(F.col(lower), yhat * (1 - BAND_SHARE))
    high = yhat * (1 + BAND_SHARE) if upper is None else F.coalesce(F.col(upper), yhat * (1 + BAND_SHARE))
    return forecasts.withColumns(
        {"predicted_admissions": shown(yhat), "lower_bound": shown(low), "upper_bound": shown(high)}
    )
