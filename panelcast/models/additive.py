"""Additive seasonal model: piecewise-linear trend, Fourier seasons, regressors.

Spark brings the days and values of a series together, in the one exchange that the
row positions need anyway; a task makes the design of its days and sums their outer
products per segment of days. A fit needs nothing but those sums, so

* all validation folds share one pass: an expanding or rolling training set is a
  difference of sums over segments, never a copy of its rows,
* all parameter sets share it too: they differ in penalties and active columns,
* predictions leave the same task, so fits are never joined to days.

A series is never longer than the calendar, which bounds what a task holds.

The multiplicative mode fits log(1 + y).
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators.keys import as_list
from ..operators.ranking import row_positions
from . import ridge
from .baseline import HORIZON, Z95
from .folds import TUNING, horizon_metrics, mean_over_horizons
from .ridge import MIN_ROWS, forecaster, mean_moments

# Executors need not have this package installed: the solver travels with the job.
cloudpickle.register_pickle_by_value(ridge)

Key = str | Sequence[str]

# Parameter sets of the forecaster, the backtest, the comparison
# and the three ensemble members, and the search grid with its sample size.
DEFAULTS = {
    "changepoint_prior_scale": 0.05,
    "seasonality_prior_scale": 10.0,
    "seasonality_mode": "additive",
    "yearly_seasonality": True,
    "weekly_seasonality": True,
    "monthly_seasonality": False,
    "quarterly_seasonality": False,
    "regressors": False,
}
FORECAST = {**DEFAULTS, "seasonality_mode": "multiplicative", "monthly_seasonality": True, "regressors": True}
BACKTEST = {**DEFAULTS, "seasonality_mode": "multiplicative", "monthly_seasonality": True, "quarterly_seasonality": True}
COMPARISON = {**DEFAULTS, "changepoint_prior_scale": 0.01, "seasonality_prior_scale": 1.0}
ENSEMBLE = {
    "conservative": {**DEFAULTS, "changepoint_prior_scale": 0.01, "seasonality_prior_scale": 1.0},
    "flexible": {**DEFAULTS, "changepoint_prior_scale": 0.1, "seasonality_mode": "multiplicative"},
    "smooth": {
        **DEFAULTS,
        "changepoint_prior_scale": 0.001,
        "seasonality_prior_scale": 0.1,
        "weekly_seasonality": False,
    },
}
GRID = {
    "changepoint_prior_scale": [0.001, 0.01, 0.1],
    "seasonality_prior_scale": [0.1, 1.0, 10.0],
    "seasonality_mode": ["additive", "multiplicative"],
    "yearly_seasonality": [True, False],
    "weekly_seasonality": [True, False],
}
GRID_SAMPLE, GRID_SEED = 20, 42



def _predicted(rows: DataFrame, segment: Column, fold: Column, step: Column, param_sets: Mapping[str, Mapping], training: str, span: int, key: Key, ds: str, y: str, ahead: int = 0) -> DataFrame:
    """Key, ds, fold, step, actual, params, yhat and its 95 % band of all rows with a fold."""
    keys = as_list(key)
    wanted = rows.select(*keys, F.unix_date(ds).alias("day"), F.col(y).cast("double").alias("y"), segment.cast("int").alias("segment"), fold.cast("int").alias("fold"), step.cast("int").alias("step"))
    types = StructType.fromDDL("ds date, fold int, step int, actual double, params string, yhat double, yhat_lower double, yhat_upper double")
    task = forecaster(keys, param_sets, training, span, ahead, Z95)
    out = wanted.groupBy(*keys).applyInArrow(task, StructType([*[wanted.schema[k] for k in keys], *types.fields]))
    return out.withColumnRenamed("ds", ds)


def forecast(series: DataFrame, periods: int = HORIZON, param_sets: Mapping[str, Mapping] | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Forecast of all series for one or more parameter sets."""
    param_sets = param_sets or {"additive": FORECAST}
    made = _predicted(series, F.lit(0), F.lit(None), F.lit(None), param_sets, "full", 1, key, ds, y, periods)
    return made.select(*as_list(key), ds, "step", "yhat", "yhat_lower", "yhat_upper", F.col("params").alias("model"))


def gram_means(series: DataFrame, names: Sequence[str] = ("base", "changepoint", "yearly", "weekly"), key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Per series the mean product of every pair (i <= j) of design columns, the target and its logarithm last."""
    keys = as_list(key)
    days = series.select(*keys, F.unix_date(ds).alias("day"), F.col(y).cast("double").alias("y")).where("y IS NOT NULL")
    types = StructType.fromDDL("i long, j long, mean double")
    return days.groupBy(*keys).applyInArrow(mean_moments(keys, names), StructType([*[days.schema[k] for k in keys], *types.fields]))


def _back_position(series: DataFrame, key: Key, ds: str) -> tuple[DataFrame, Column]:
    rows = row_positions(series, key, ds)
    return rows, F.col("n") - 1 - F.col("r")


def cross_validate(series: DataFrame, param_sets: Mapping[str, Mapping], initial: int, period: int, horizon: int, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of every test row by expanding fits at evenly spaced cut-offs."""
    rows, left = _back_position(series, key, ds)
    segment = F.when(left >= horizon, F.floor((left - horizon) / period))
    # the fold whose cut-off lies 1..horizon days before the row
    fold = F.when(left < horizon, 0).otherwise(F.ceil((left + 1 - horizon) / period))
    ahead = horizon + fold * period - left
    tested = (ahead >= 1) & (ahead <= horizon) & (F.col("n") - 1 - horizon - fold * period >= initial)
    scored = _predicted(rows, segment, F.when(tested, fold), ahead, param_sets, "expanding", 1, key, ds, y)
    return scored.withColumn("cutoff", F.date_sub(ds, F.col("step")))


def holdout(series: DataFrame, test_rows: int = 30, param_sets: Mapping[str, Mapping] | None = None, min_train: int = MIN_ROWS, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of the last rows from fits on the rows before them, one for each parameter set."""
    rows, left = _back_position(series, key, ds)
    rows = rows.filter(F.col("n") >= test_rows + min_train)
    tested = left < test_rows
    scored = _predicted(rows, F.when(~tested, 0), F.when(tested, 0), test_rows - left, param_sets or {"additive": FORECAST}, "full", 1, key, ds, y)
    return scored.select(*as_list(key), ds, "step", "actual", "params", "yhat", "yhat_lower", "yhat_upper")


def rolling_backtest(series: DataFrame, window: int, step: int, horizon: int, params: Mapping | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of fixed-length training windows; the window must be a multiple of the step."""
    if window % step or step < horizon:
        raise ValueError("the window must be a multiple of the step, and the step not below the horizon")
    rows = row_positions(series, key, ds).filter(F.col("n") >= window + 30)
    r, n = F.col("r"), F.col("n")
    past = r - window
    opened = past - past % step
    tested = (past >= 0) & (past % step < horizon) & (opened < n - window - horizon)
    scored = _predicted(rows, F.floor(r / step), F.when(tested, opened / step), past % step + 1, {"additive": params or BACKTEST}, "rolling", window // step, key, ds, y)
    return scored.withColumn("cutoff", F.date_sub(ds, F.col("step")))


def parameter_grid(grid: Mapping[str, Sequence] = GRID, sample: int = GRID_SAMPLE, seed: int = GRID_SEED) -> dict[str, dict]:
    """Seeded sample of the grid, keyed by the set written as JSON."""
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    chosen = every if len(every) <= sample else random.Random(seed).sample(every, sample)
    return {json.dumps(p, sort_keys=True): {**DEFAULTS, **p} for p in chosen}


def grid_search(series: DataFrame, param_sets: Mapping[str, Mapping] | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Best parameter set per series by cross-validated error, all sets in one job.

    Series without a single valid fold get the defaults and no error.
    """
    keys = as_list(key)
    param_sets = param_sets or parameter_grid()
    scored = cross_validate(series, param_sets, **TUNING, key=keys, ds=ds, y=y)
    per_step = horizon_metrics(scored, "yhat", F.col("yhat_lower"), F.col("yhat_upper"), [*keys, "params"])
    scores = mean_over_horizons(per_step, [*keys, "params"]).filter(F.col("mape").isNotNull())
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("params", "mape", "mae", "rmse", "mdape", "coverage"), F.struct("mape", "params")).alias("_b"))
    found = series.select(*keys).distinct().join(best.select(*keys, "_b.*"), keys, "left")
    return found.withColumn("params", F.coalesce("params", F.lit(json.dumps(DEFAULTS, sort_keys=True))))

