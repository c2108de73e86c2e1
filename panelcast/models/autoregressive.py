"""Autoregressive forecasts and a stationarity test from regression aggregates.

Each series is reduced to a handful of sums by one window (for the lags) and
one aggregate; no series is ever gathered for a solver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import mape_raw
from ..operators.keys import as_list, series_window
from ..operators.ranking import row_positions
from .baseline import HORIZON, LAST_ROWS, extend

Key = str | Sequence[str]

# 5 % critical value of the unit-root test with a constant, and
# the candidate orders (autoregressive terms, differences).
CRITICAL = -2.86
ORDERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def stationarity(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Unit-root t-statistic per series: slope of the change on the level before."""
    return fit_autoregressions(series, key, ds, y).select(*as_list(key), "n_pairs", "slope", "t_stat", "is_stationary")


def with_lags(series: DataFrame, key: Key, ds: str, y: str) -> DataFrame:
    w = series_window(key, ds)
    value = F.col(y).cast("double")
    return series.withColumns({"_y": value, "_y1": F.lag(value, 1).over(w), "_y2": F.lag(value, 2).over(w)})


def fit_autoregressions(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Per series: level, AR(1) constant and slope, slope of the differences, unit-root test, last values.

    All of it comes from one aggregate. A constant lag leaves the slope
    undefined; the slope is then taken as one with no constant, which repeats
    the last value.
    """
    d, d1 = F.col("_y") - F.col("_y1"), F.col("_y1") - F.col("_y2")
    before = F.col("_y1")
    squares = F.sum(d1 * d1)
    fitted = with_lags(series, key, ds, y).groupBy(*as_list(key)).agg(
        F.count("*").alias("n"),
        F.avg("_y").alias("level"),
        F.coalesce(F.regr_slope("_y", "_y1"), F.lit(1.0)).alias("phi"),
        F.coalesce(F.regr_intercept("_y", "_y1"), F.lit(0.0)).alias("constant"),
        F.when(squares > 0, F.sum(d * d1) / F.when(squares > 0, squares)).otherwise(0.0).alias("phi_diff"),
        F.max(ds).alias("last_ds"),
        F.max_by("_y", ds).alias("last_y"),
        F.max_by("_y1", ds).alias("last_y1"),
        F.count(d).alias("n_pairs"),
        F.regr_slope(d, before).alias("slope"),
        F.regr_sxx(d, before).alias("_sxx"),
        F.regr_syy(d, before).alias("_syy"),
    )
    sse = F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")
    usable = (F.col("n_pairs") > 2) & (F.col("_sxx") > 0) & (sse > 0)
    error = F.when(usable, F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("n_pairs") - 2) / F.col("_sxx")))
    tested = fitted.withColumn("t_stat", F.col("slope") / error)
    return tested.withColumn("is_stationary", F.coalesce(F.col("t_stat") < CRITICAL, F.lit(False))).drop("_sxx", "_syy")


def one_step(order: tuple[int, int]) -> Column:
    """In-sample prediction of a row from the rows before it."""
    return {
        (0, 0): F.col("level"),
        (0, 1): F.col("_y1"),
        (1, 0): F.col("constant") + F.col("phi") * F.col("_y1"),
        (1, 1): F.col("_y1") + F.col("phi_diff") * (F.col("_y1") - F.col("_y2")),
    }[order]


def geometric(ratio: Column, terms: Column) -> Column:
    """1 + r + … + r^(terms-1)."""
    gap = 1 - ratio
    return F.when(F.abs(gap) < 1e-12, terms.cast("double")).otherwise(
        (1 - F.pow(ratio, terms)) / F.when(F.abs(gap) < 1e-12, 1.0).otherwise(gap)
    )


def many_steps(order: tuple[int, int], step: Column) -> Column:
    """Closed form of the recursive forecast; differenced models return to levels."""
    phi, last = F.col("phi"), F.col("last_y")
    trend = F.col("phi_diff") * geometric(F.col("phi_diff"), step)
    return {
        (0, 0): F.col("level"),
        (0, 1): last,
        (1, 0): F.col("constant") * geometric(phi, step) + F.pow(phi, step) * last,
        (1, 1): last + (last - F.coalesce("last_y1", last)) * trend,
    }[order]


def _name(order: tuple[int, int]) -> str:
    return f"ar{order[0]}_diff{order[1]}"


def in_sample_errors(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y", fits: DataFrame | None = None) -> DataFrame:
    """Percentage error of every candidate order per series, in long form."""
    keys = as_list(key)
    fits = fit_autoregressions(series, key, ds, y) if fits is None else fits
    rows = with_lags(series, key, ds, y).join(fits, keys)
    shares = {}
    for order in ORDERS:
        predicted = one_step(order)
        # a missing prediction must not count, on either side of the quotient
        actual = F.when(predicted.isNotNull(), F.col("_y"))
        shares[_name(order)] = mape_raw(actual, predicted)
    tested = F.first("is_stationary").alias("is_stationary")
    wide = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in shares.items()], tested)
    pairs = F.array(*[F.struct(F.lit(_name(o)).alias("model"), F.col(_name(o)).alias("mape"), F.lit(o[1]).alias("differences")) for o in ORDERS])
    return wide.select(*keys, "is_stationary", F.explode(pairs).alias("_m")).select(*keys, "is_stationary", "_m.*")


def select_order(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y", fits: DataFrame | None = None) -> DataFrame:
    """Order with the lowest in-sample error; only differenced ones if a unit root is likely."""
    keys = as_list(key)
    fits = fit_autoregressions(series, key, ds, y) if fits is None else fits
    errors = in_sample_errors(series, key, ds, y, fits)
    allowed = errors.filter(F.col("is_stationary") | (F.col("differences") == 1))
    best = F.min(F.struct("mape", "model"))
    return allowed.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.model").alias("model"), F.col("_b.mape").alias("mape"))


def autoregressive_forecast(
    series: DataFrame, periods: int = HORIZON, order: tuple[int, int] = (1, 0), key: Key = "location", ds: str = "ds", y: str = "y"
) -> DataFrame:
    days = extend(fit_autoregressions(series, key, ds, y), periods, "last_ds", ds)
    return days.select(*as_list(key), ds, "step", many_steps(order, F.col("step")).alias("yhat"), F.lit(_name(order)).alias("model"))


def best_autoregressive_forecast(series: DataFrame, periods: int = HORIZON, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Forecast of the selected order for every series."""
    keys = as_list(key)
    fits = fit_autoregressions(series, key, ds, y)
    chosen = select_order(series, key, ds, y, fits)
    days = extend(fits.join(chosen, keys), periods, "last_ds", ds)
    yhat = F.coalesce(*[F.when(F.col("model") == _name(o), many_steps(o, F.col("step"))) for o in ORDERS])
    return days.select(*keys, ds, "step", yhat.alias("yhat"), "model", "mape")


def holdout_forecast(series: DataFrame, test_rows: int = LAST_ROWS, min_train: int = 30, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """AR(1) predictions of the last rows of every series from the rows before them."""
    keys = as_list(key)
    marked = row_positions(series, keys, ds).filter(F.col("n") >= test_rows + min_train)
    first_test = F.col("n") - test_rows
    fits = fit_autoregressions(marked.filter(F.col("r") < first_test), keys, ds, y).drop("n")
    tests = marked.filter(F.col("r") >= first_test).join(fits, keys)
    step = F.col("r") - first_test + 1
    return tests.select(*keys, ds, F.col(y).alias("actual"), many_steps((1, 0), step).alias("yhat"))


def selected_holdout(series: DataFrame, test_rows: int = LAST_ROWS, min_train: int = 30, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of the last rows by the order that fits the rows before them best; the test rows take no part in the choice."""
    keys = as_list(key)
    marked = row_positions(series, keys, ds).filter(F.col("n") >= test_rows + min_train)
    first_test = F.col("n") - test_rows
    train = marked.filter(F.col("r") < first_test).drop("r", "n")
    fits = fit_autoregressions(train, keys, ds, y)
    chosen = fits.drop("n").join(select_order(train, keys, ds, y, fits), keys)
    tests = marked.filter(F.col("r") >= first_test).join(chosen, keys)
    step = F.col("r") - first_test + 1
    yhat = F.coalesce(*[F.when(F.col("model") == _name(o), many_steps(o, step)) for o in ORDERS])
    return tests.select(*keys, ds, step.cast("int").alias("step"), F.col(y).alias("actual"), yhat.alias("yhat"), F.col("model").alias("order"))
