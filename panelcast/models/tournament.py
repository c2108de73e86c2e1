"""All model families on the same last rows of every series, tuned on the rows before.

One table holds every family's predictions of the test rows: the historical average,
the autoregression of the order chosen on the training rows, the additive model with
the parameter set that cross-validates best on the training rows, and the ensemble of
the fixed additive sets. All additive sets share one pass over the series. Scores and
choices are read off that table; test rows never take part in tuning.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.keys import as_list
from ..operators.ranking import row_positions
from . import additive, autoregressive, baseline, ensemble, folds
from .baseline import LAST_ROWS

Key = str | Sequence[str]

AVERAGE, AUTOREGRESSION, TUNED, COMBINED = "historical_average", "autoregression", "additive_tuned", "additive_ensemble"
MODELS = (AVERAGE, AUTOREGRESSION, TUNED, COMBINED)


def training_part(series: DataFrame, test_rows: int = LAST_ROWS, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Series without their last rows."""
    rows = row_positions(series, key, ds)
    return rows.filter(F.col("r") < F.col("n") - test_rows).drop("r", "n")


def predictions(series: DataFrame, test_rows: int = LAST_ROWS, param_sets: Mapping[str, Mapping] | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """(model, key, ds, actual, yhat, choice) of every family; ``choice`` is the order or parameter set that was tuned."""
    keys = as_list(key)
    grid = param_sets or additive.parameter_grid()
    grid = {json.dumps(additive.DEFAULTS, sort_keys=True): additive.DEFAULTS, **grid}
    tuned = additive.grid_search(training_part(series, test_rows, keys, ds), grid, keys, ds, y)
    made = additive.holdout(series, test_rows, {**grid, **additive.ENSEMBLE}, key=keys, ds=ds, y=y).select(*keys, ds, "actual", "yhat", F.col("params").alias("choice"))
    single = made.join(tuned.select(*keys, F.col("params").alias("choice")), [*keys, "choice"])
    members = made.where(F.col("choice").isin(*additive.ENSEMBLE))
    combined = members.groupBy(*keys, ds).agg(F.max("actual").alias("actual"), F.avg("yhat").alias("yhat"))
    family = {
        AVERAGE: baseline.holdout_forecast(series, test_rows, key=keys, ds=ds, y=y),
        AUTOREGRESSION: autoregressive.selected_holdout(series, test_rows, key=keys, ds=ds, y=y).withColumnRenamed("order", "choice"),
        TUNED: single,
        COMBINED: combined,
    }
    out = None
    for name, rows in family.items():
        choice = F.col("choice") if "choice" in rows.columns else F.lit(None).cast("string").alias("choice")
        part = rows.select(F.lit(name).alias("model"), *keys, ds, F.col("actual").cast("double").alias("actual"), "yhat", choice)
        out = part if out is None else out.unionAll(part)
    return out


def scores(predicted: DataFrame, key: Key = "location") -> DataFrame:
    """Hold-out measures per model and series."""
    return folds.error_table(predicted, ["model", *as_list(key)])


def single_or_ensemble(scored: DataFrame, key: Key = "location") -> DataFrame:
    """Per series the better of the tuned additive model and the additive ensemble."""
    single, combined = (scored.where(F.col("model") == m) for m in (TUNED, COMBINED))
    return ensemble.single_or_ensemble(single, combined, key)


def accuracy_table(scored: DataFrame, key: Key = "location") -> DataFrame:
    """Accuracy of every model and series, its rank there, and the winner; ties go to the first name."""
    best = Window.partitionBy(*as_list(key)).orderBy(F.desc("accuracy"), "model")
    ranked = scored.select("model", *as_list(key), "accuracy", F.row_number().over(best).alias("rank"))
    return ranked.withColumn("winner", F.first("model").over(best))


def forecasts(series: DataFrame, periods: int = baseline.HORIZON, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """The next days by every family, tuned on the whole history: model, key, ds, yhat."""
    keys = as_list(key)
    grid = {json.dumps(additive.DEFAULTS, sort_keys=True): additive.DEFAULTS, **additive.parameter_grid()}
    tuned = additive.grid_search(series, grid, keys, ds, y).select(*keys, F.col("params").alias("model"))
    made = additive.forecast(series, periods, {**grid, **additive.ENSEMBLE}, keys, ds, y)
    combined = ensemble.ensemble(made.where(F.col("model").isin(*additive.ENSEMBLE)), keys, ds)
    family = {
        AVERAGE: baseline.mean_forecast(series, periods, keys, ds, y),
        AUTOREGRESSION: autoregressive.best_autoregressive_forecast(series, periods, keys, ds, y),
        TUNED: made.join(tuned, [*keys, "model"]),
        COMBINED: combined,
    }
    out = None
    for name, rows in family.items():
        part = rows.select(F.lit(name).alias("model"), *keys, ds, "yhat")
        out = part if out is None else out.unionAll(part)
    return out
