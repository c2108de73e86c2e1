"""Forecast error measures as aggregate columns.

Three percentage errors are kept apart on purpose because they treat zero
actuals differently: ``mape_positive`` skips them, ``mape_raw`` lets them turn
into infinity and ``mape_epsilon`` divides by a tiny floor instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# float64 machine epsilon, the ceiling of a reported percentage
# error and the point from which accuracy falls back to the symmetric error.
EPSILON = 2.220446049250313e-16
MAPE_CEILING = 999.0
MAPE_UNUSABLE = 200.0


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mse(actual: Column, predicted: Column) -> Column:
    return F.avg((actual - predicted) * (actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(mse(actual, predicted))


def absolute_percentage(actual: Column, predicted: Column) -> Column:
    """Row-level error share, null where the actual is not positive."""
    return F.when(actual > 0, F.abs((actual - predicted) / actual))


def mape_positive(actual: Column, predicted: Column) -> Column:
    return F.coalesce(F.avg(absolute_percentage(actual, predicted)) * 100, F.lit(0.0))


def mape_raw(actual: Column, predicted: Column) -> Column:
    at_zero = F.when(predicted == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    share = F.when(actual == 0, at_zero).otherwise(F.abs((actual - predicted) / actual))
    return F.avg(share) * 100


def mape_epsilon(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted) / F.greatest(F.abs(actual.cast("double")), F.lit(EPSILON))) * 100


def smape(actual: Column, predicted: Column) -> Column:
    scale = (F.abs(actual) + F.abs(predicted)) / 2
    return F.avg(F.abs(actual - predicted) / F.when(scale == 0, 1.0).otherwise(scale)) * 100


def accuracy(mape: Column, smape_: Column) -> Column:
    usable = F.when(mape < MAPE_UNUSABLE, mape).otherwise(smape_)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - usable))


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    return F.avg(actual.between(lower, upper).cast("double"))
