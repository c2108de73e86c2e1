"""Time-ordered validation folds and backtests over all series at once.

Folds are arithmetic on row positions or days. Training sets are reduced to a
few statistics per fold, by running windows or partial aggregates, and never
copied to a fitting function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import metrics
from ..operators.keys import as_list, series_window
from ..operators.ranking import row_positions
from .autoregressive import many_steps
from .baseline import weekday_factor

Key = str | Sequence[str]

# Cross-validation, tuning and rolling-window settings.
CV = {"initial": 180, "period": 30, "horizon": 14}
TUNING = {"initial": 180, "period": 14, "horizon": 7}
ROLLING = {"window": 180, "step": 30, "horizon": 14}
SPLITS = 3


def ordered_splits(series: DataFrame, splits: int = SPLITS, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Expanding splits: one row per series and fold with its train and test positions.

    The test part is a fixed share of the series; training is everything before.
    """
    lengths = series.groupBy(*as_list(key)).agg(F.count("*").alias("n"))
    folds = lengths.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    size = F.floor(F.col("n") / (splits + 1))
    start = F.col("n") - (splits + 1 - F.col("fold")) * size
    return folds.withColumns({"train_rows": start, "test_start": start, "test_end": start + size}).filter(size > 0)


def split_members(series: DataFrame, splits: int = SPLITS, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Rows with the fold they test; rows that only ever train get null."""
    rows = row_positions(series, key, ds)
    size = F.floor(F.col("n") / (splits + 1))
    first = F.col("n") - splits * size
    fold = F.when((size > 0) & (F.col("r") >= first), F.floor((F.col("r") - first) / F.greatest(size, F.lit(1))) + 1)
    return rows.withColumn("fold", fold.cast("int"))


def cutoffs(series: DataFrame, initial: int, period: int, horizon: int, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Forecast origins per series, spaced back from the last day that leaves a full horizon."""
    ends = series.groupBy(*as_list(key)).agg(F.min(ds).alias("_a"), F.max(ds).alias("_b"))
    room = F.datediff("_b", "_a") - horizon - initial
    steps = ends.filter(room >= 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(room / period).cast("int"))))
    return steps.select(*as_list(key), F.date_sub("_b", F.lit(horizon) + F.col("_k") * period).alias("cutoff"))


def fold_rows(series: DataFrame, initial: int, period: int, horizon: int, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Every row joined to every fold it belongs to, as training or test row.

    An equi-join on the series with a day condition. It multiplies training
    rows by the number of folds and is meant for inspecting folds; the
    forecasters use carried statistics or summed segments instead.
    """
    folds = cutoffs(series, initial, period, horizon, key, ds)
    joined = series.join(folds, as_list(key))
    joined = joined.filter(F.col(ds) <= F.date_add("cutoff", horizon))
    return joined.withColumn("is_test", F.col(ds) > F.col("cutoff"))


def fold_sizes(series: DataFrame, initial: int, period: int, horizon: int, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Training and test rows of every fold of gap-free series, from row positions alone.

    Two equi-joins look up the positions of the cutoff and of the last test day.
    """
    keys = as_list(key)
    rows = row_positions(series, key, ds).select(*keys, ds, "r")
    origins = cutoffs(series, initial, period, horizon, key, ds).withColumn("_end", F.date_add("cutoff", horizon))
    first = rows.select(*keys, F.col(ds).alias("cutoff"), F.col("r").alias("_first"))
    last = rows.select(*keys, F.col(ds).alias("_end"), F.col("r").alias("_last"))
    found = origins.join(first, [*keys, "cutoff"]).join(last, [*keys, "_end"])
    return found.select(*keys, "cutoff", (F.col("_first") + 1).cast("long").alias("train_rows"), (F.col("_last") - F.col("_first")).cast("long").alias("test_rows"))


def _require_disjoint(spacing: int, horizon: int) -> None:
    if spacing < horizon:
        raise ValueError("test parts would overlap: the spacing of folds must not be below the horizon")


def _predictions(tests: DataFrame, key: Key, ds: str, y: str) -> DataFrame:
    """Both forecasts of rows that carry the training state of their fold."""
    step = F.datediff(F.col(ds), F.col("cutoff"))
    return tests.select(
        *as_list(key),
        "cutoff",
        ds,
        step.alias("step"),
        F.col(y).alias("actual"),
        (F.col("level") * weekday_factor(F.col(ds))).alias("yhat_mean"),
        many_steps((1, 0), step).alias("yhat_ar"),
    )


def rolling_backtest(series: DataFrame, window: int, step: int, horizon: int, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of fixed-length training windows moved forward by ``step`` rows.

    Expects gap-free panels, where rows are days. Series shorter than the
    window plus thirty rows are left out. A row unrolls into the few windows it
    trains, ``window / step`` of them, and is summed up again right away in the
    partition of its series.
    """
    _require_disjoint(step, horizon)
    keys = as_list(key)
    rows = row_positions(series, keys, ds).filter(F.col("n") >= window + 30)
    value, r = F.col(y).cast("double"), F.col("r")
    last_fold = F.ceil((F.col("n") - window - horizon) / step).cast("int") - 1
    lagged = rows.withColumn("_y1", F.lag(value).over(series_window(keys, ds)))
    first = F.greatest(F.lit(0), F.ceil((r - window + 1) / step).cast("int"))
    final = F.least(F.floor(r / step).cast("int"), last_fold)
    member = lagged.filter(first <= final).withColumn("fold", F.explode(F.sequence(first, final)))
    pair = F.when(r > F.col("fold") * step, F.col("_y1"))
    fits = member.groupBy(*keys, "fold").agg(
        F.avg(value).alias("level"),
        F.coalesce(F.regr_slope(value, pair), F.lit(1.0)).alias("phi"),
        F.coalesce(F.regr_intercept(value, pair), F.lit(0.0)).alias("constant"),
        F.max_by(value, ds).alias("last_y"),
        F.max(ds).alias("cutoff"),
    )
    past = r - window
    fold = F.floor(past / step).cast("int")
    tests = rows.filter((past >= 0) & (past % step < horizon) & (fold <= last_fold)).withColumn("fold", fold)
    return _predictions(tests.join(fits, [*keys, "fold"]), keys, ds, y)


def rolling_origin(series: DataFrame, initial: int, period: int, horizon: int, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of expanding training sets at evenly spaced cut-offs.

    Expanding statistics are running window aggregates; the state at each
    cut-off is carried to the test rows that follow it.
    """
    _require_disjoint(period, horizon)
    keys = as_list(key)
    w = series_window(keys, ds)
    value, left = F.col(y).cast("double"), F.col("n") - 1 - F.col("r")
    rows = row_positions(series, keys, ds).withColumn("_y1", F.lag(value).over(w))
    opens = (left >= horizon) & ((left - horizon) % period == 0) & (F.col("r") >= initial)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    state = F.struct(
        F.avg(y).over(so_far).alias("level"),
        F.coalesce(F.regr_slope(value, F.col("_y1")).over(so_far), F.lit(1.0)).alias("phi"),
        F.coalesce(F.regr_intercept(value, F.col("_y1")).over(so_far), F.lit(0.0)).alias("constant"),
        value.alias("last_y"),
        F.col(ds).alias("cutoff"),
    )
    stated = rows.withColumn("_s", F.when(opens, state))
    carried = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    in_test = F.pmod(horizon - 1 - left, F.lit(period)) < horizon
    tests = stated.withColumn("_s", carried).filter(in_test & F.col("_s").isNotNull()).select("*", "_s.*")
    return _predictions(tests, keys, ds, y).filter(F.col("step") <= horizon)


def backtest_metrics(predictions: DataFrame, predicted: str, key: Key = "location", ds: str = "ds", actual: str = "actual") -> DataFrame:
    """Error measures over all folds of a series.

    Directions are compared between neighbouring days of the same fold; a
    change below a billionth is rounding noise and counts as none.
    """
    keys = as_list(key)
    a, p = F.col(actual), F.col(predicted)
    w = Window.partitionBy(*keys, "cutoff").orderBy(ds)

    def direction(value: Column) -> Column:
        return F.signum(F.round((value - F.lag(value).over(w)).cast("double"), 9))

    same = (direction(a) == direction(p)).cast("double")
    return predictions.withColumn("_same", same).groupBy(*keys).agg(
        metrics.mae(a, p).alias("mae"),
        metrics.mse(a, p).alias("mse"),
        metrics.rmse(a, p).alias("rmse"),
        metrics.mape_epsilon(a, p).alias("mape"),
        (F.avg("_same") * 100).alias("directional_accuracy"),
        F.count("*").alias("total_predictions"),
    )


def horizon_metrics(
    predictions: DataFrame, predicted: str, lower: Column | None = None, upper: Column | None = None, key: Key = "location", actual: str = "actual"
) -> DataFrame:
    """Error measures per series and forecast step.

    A group holds one row per fold, so the exact median stays small.
    """
    a, p = F.col(actual), F.col(predicted)
    ape = metrics.absolute_percentage(a, p)
    columns = [
        metrics.mae(a, p).alias("mae"),
        metrics.rmse(a, p).alias("rmse"),
        (F.avg(ape) * 100).alias("mape"),
        (F.percentile(ape, 0.5) * 100).alias("mdape"),
        F.count("*").alias("folds"),
    ]
    if lower is not None:
        columns.append(metrics.coverage(a, lower, upper).alias("coverage"))
    return predictions.groupBy(*as_list(key), "step").agg(*columns)


def mean_over_horizons(per_step: DataFrame, key: Key = "location") -> DataFrame:
    keys = as_list(key)
    values = [c for c in per_step.columns if c not in {*keys, "step", "folds"}]
    means = [F.avg(c).alias(c) for c in values]
    return per_step.groupBy(*keys).agg(*means, F.max("folds").alias("folds"), F.count("*").alias("horizons"))


def error_table(predictions: DataFrame, key: Key, actual: str = "actual", predicted: str = "yhat") -> DataFrame:
    """Hold-out measures per group: absolute, squared, percentage and derived accuracy."""
    a, p = F.col(actual), F.col(predicted)
    sums = predictions.groupBy(*as_list(key)).agg(
        metrics.mae(a, p).alias("mae"),
        metrics.mse(a, p).alias("mse"),
        metrics.rmse(a, p).alias("rmse"),
        metrics.mape_positive(a, p).alias("_mape"),
        metrics.smape(a, p).alias("smape"),
        F.avg(a).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        F.count_if(a > 0).alias("non_zero_samples"),
        F.count("*").alias("test_days"),
    )
    return sums.select(
        *as_list(key),
        "mae",
        "mse",
        "rmse",
        F.least(F.col("_mape"), F.lit(metrics.MAPE_CEILING)).alias("mape"),
        "smape",
        metrics.accuracy(F.col("_mape"), F.col("smape")).alias("accuracy"),
        "mean_actual",
        "mean_predicted",
        "non_zero_samples",
        "test_days",
    )
