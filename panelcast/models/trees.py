"""Boosted trees of Spark ML: one model over all series.

A series enters through the mean of its training rows, a column like any other, so no
list of series is held anywhere and any number of them can be pooled.
"""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import calendar_parts, is_weekend
from ..operators.features import numeric_features
from ..operators.keys import add, as_list, named
from ..operators.windows import lag_columns, leak_free_rolling, split_last_rows
from ..sources.files import checkpointed
from .baseline import HORIZON, LAST_ROWS, extend
from .folds import split_members

Key = str | Sequence[str]

# Default model settings, shortest history and search ranges.
DEFAULTS = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3}
SEED = 42
MIN_ROWS = 60
TRIALS = 50
RANGES = {
    "maxIter": (50, 300),
    "maxDepth": (3, 10),
    "stepSize": (0.01, 0.3),
    "subsamplingRate": (0.6, 1.0),
    "featureSubsetStrategy": (0.6, 1.0),
    "minInstancesPerNode": (1, 10),
}
LEVEL = "series_level"


def model_features(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Calendar parts, lags and rolling statistics that leave the current value out."""
    parts = calendar_parts(F.col(ds))
    wanted = {"day_of_week": "day_of_week", "day_of_month": "day", "month": "month", "week_of_year": "week_of_year", "quarter": "quarter"}
    out = add(series, {name: parts[source] for name, source in wanted.items()})
    out = out.withColumn("is_weekend", is_weekend(F.col(ds)))
    out = leak_free_rolling(lag_columns(out, key=key, ds=ds, y=y), key=key, ds=ds, y=y)
    out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*as_list(key))))
    out = out.filter(F.col("_n") >= MIN_ROWS).drop("_n")
    return out.fillna(0, subset=numeric_features(out))


def _level(key: Key, y: str, chosen: Column) -> Column:
    """Mean target of a series' chosen rows, 0 if there is none."""
    mean = F.avg(F.when(chosen, F.col(y).cast("double"))).over(Window.partitionBy(*as_list(key)))
    return F.coalesce(mean, F.lit(0.0))


def _inputs(frame: DataFrame, features: Sequence[str], key: Key, ds: str, y: str, levels: Mapping[str, Column], *others: str) -> DataFrame:
    """What models read, written once: a fit runs hundreds of jobs over it."""
    slim = frame.select(*as_list(key), ds, y, *others, *[named(n).cast("double").alias(n) for n in features])
    return checkpointed(add(slim, levels), "tree-inputs")


def _vectors(rows: DataFrame, names: Sequence[str], y: str) -> DataFrame:
    whole = VectorAssembler(inputCols=[f"`{n}`" if "." in n else n for n in names], outputCol="features")
    return whole.transform(rows.withColumn("label", F.col(y).cast("double")))


def train(rows: DataFrame, params: Mapping | None = None) -> GBTRegressionModel | None:
    """Model of rows (features, label); None if there are no rows."""
    rows = rows.select("features", "label").filter(F.col("label").isNotNull())
    return None if rows.isEmpty() else GBTRegressor(seed=SEED, **{**DEFAULTS, **(params or {})}).fit(rows)


def _scored(model: GBTRegressionModel | None, rows: DataFrame) -> DataFrame:
    """Rows with ``yhat``, null without a model."""
    return model.transform(rows).withColumnRenamed("prediction", "yhat") if model else rows.withColumn("yhat", F.lit(None).cast("double"))


def fit_predict(frame: DataFrame, features: Sequence[str], params: Mapping | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Trains on the rows marked ``is_train`` and predicts the others: key, ds, y, yhat.

    Without any training row ``yhat`` is null.
    """
    rows = _inputs(frame, features, key, ds, y, {LEVEL: _level(key, y, F.col("is_train"))}, "is_train")
    vectors = _vectors(rows, [*features, LEVEL], y)
    model = train(vectors.filter("is_train"), params)
    return _scored(model, vectors.filter("NOT is_train")).select(*as_list(key), ds, F.col(y).cast("double").alias(y), "yhat")


def holdout(frame: DataFrame, features: Sequence[str], params: Mapping | None = None, test_rows: int = LAST_ROWS, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of each series' last rows from a model of the rows before: key, ds, actual, yhat."""
    marked = split_last_rows(frame, test_rows, "_test", key, ds).withColumn("is_train", ~F.col("_test"))
    return fit_predict(marked, features, params, key, ds, y).withColumnRenamed(y, "actual")


def _whole(frame: DataFrame, features: Sequence[str], params: Mapping | None, key: Key, ds: str, y: str) -> tuple[DataFrame, GBTRegressionModel | None]:
    """All rows as vectors and their model."""
    rows = _inputs(frame, features, key, ds, y, {LEVEL: _level(key, y, F.lit(True))})
    vectors = _vectors(rows, [*features, LEVEL], y)
    return vectors, train(vectors, params)


def importances(frame: DataFrame, features: Sequence[str], params: Mapping | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Share of each input in the gain of the model: feature, importance. No rows without a model."""
    _, model = _whole(frame, features, params, key, ds, y)
    shares = model.featureImportances.toArray().tolist() if model else []
    return frame.sparkSession.createDataFrame(list(zip([*features, LEVEL], shares)), "feature string, importance double")


def series_importances(frame: DataFrame, features: Sequence[str], params: Mapping | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """How much the model's mean absolute error on a series grows when an input is shuffled inside it: key, feature, importance.

    A row meets the row whose place in a hashed order equals its place in time, by an
    equi-join, and unrolls into one variant per input.
    """
    keys, names = as_list(key), list(features)
    vectors, model = _whole(frame, names, params, key, ds, y)
    if model is None:
        return frame.select(*keys, F.lit("").alias("feature"), F.lit(0.0).alias("importance")).limit(0)
    mixed = Window.partitionBy(*keys).orderBy(F.xxhash64(F.col(ds), F.lit(SEED)), ds)
    rows = vectors.select(*keys, ds, "label", vector_to_array("features").alias("own")).filter(F.col("label").isNotNull())
    placed = rows.withColumns({"_at": F.row_number().over(Window.partitionBy(*keys).orderBy(ds)), "_from": F.row_number().over(mixed)})
    others = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_from").alias("_place"), F.col("own").alias("other"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = placed.join(others, [*same, F.col("_at") == F.col("_place")])
    variant = F.transform("own", lambda v, i: F.when(i == F.col("_input"), F.get("other", i)).otherwise(v))
    # variant -1 is the row as it is
    spread = met.withColumn("_input", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))))
    scored = _scored(model, spread.withColumn("features", array_to_vector(variant)))
    errors = scored.groupBy(*keys, "_input").agg(F.avg(F.abs(F.col("label") - F.col("yhat"))).alias("_error"))
    plain = F.max(F.when(F.col("_input") == -1, F.col("_error"))).over(Window.partitionBy(*keys))
    grown = errors.withColumn("importance", F.col("_error") - plain).filter("_input >= 0")
    return grown.select(*keys, F.get(F.array(*[F.lit(n) for n in names]), F.col("_input")).alias("feature"), "importance")


def forecast(frame: DataFrame, features: Sequence[str], periods: int = HORIZON, params: Mapping | None = None, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Predictions of the next days from the last known lags and rolling values.

    Calendar features follow the day; lag and rolling features stay at their
    last values; features with no future value are 0.
    """
    keys = as_list(key)
    held = [c for c in features if "lag_" in c or "rolling_" in c]
    last = frame.groupBy(*keys).agg(F.max(ds).alias("_end"), *[F.max_by(named(c), ds).alias(c) for c in held])
    days = extend(last, periods, "_end", ds)
    parts = calendar_parts(F.col(ds))
    fresh = {**parts, "day_of_month": parts["day"], "is_weekend": is_weekend(F.col(ds))}
    columns = {c: fresh.get(c, F.lit(0)) for c in features if c not in held}

    def cast(df: DataFrame, target, train: bool) -> DataFrame:
        return df.select(*keys, ds, target.cast("double").alias(y), F.lit(train).alias("is_train"), *[named(c).cast("double").alias(c) for c in features])

    both = cast(frame, F.col(y), True).unionByName(cast(add(days, columns), F.lit(0), False))
    return fit_predict(both, features, params, key, ds, y).drop(y)


def random_trials(n: int = TRIALS, ranges: Mapping[str, tuple] = RANGES, seed: int = SEED) -> list[dict]:
    """Seeded random settings inside the search ranges."""
    draw = random.Random(seed)
    trials = [{k: draw.randint(a, b) if isinstance(a, int) else round(draw.uniform(a, b), 4) for k, (a, b) in ranges.items()} for _ in range(n)]
    return [{k: str(v) if k == "featureSubsetStrategy" else v for k, v in t.items()} for t in trials]


def search(frame: DataFrame, features: Sequence[str], trials: Sequence[Mapping], splits: int = 3, steps: int = 3, share: int = 5, parallel: int = 8, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Successive halving over all trials: trial, params, rounds, mae, is_best.

    Every trial is judged by its mean absolute error over time-ordered expanding splits.
    In each step the best of every ``share`` trials go on with ``share`` times the rounds,
    and the last step runs all rounds of its trials; ``steps=1`` runs all rounds of all
    trials. ``mae`` is a trial's least error and ``rounds`` what it had then, since more
    rounds can do worse; the best trial is the one with the least of all. Fits are
    distributed jobs, ``parallel`` of them at a time; one number per trial and split comes
    back. A split without rows on either side is left out.
    """
    spark, numbers = frame.sparkSession, range(1, splits + 1)
    members = split_members(frame, splits, key, ds).withColumn("fold", F.coalesce("fold", F.lit(0)))
    levels = {f"{LEVEL}_{k}": _level(key, y, F.col("fold") < k) for k in numbers}
    rows = _inputs(members, features, key, ds, y, levels, "fold")
    folds = {k: _vectors(rows.filter(F.col("fold") <= k), [*features, f"{LEVEL}_{k}"], y).select("features", "label", "fold") for k in numbers}

    def error(job: tuple[int, int, int]) -> float | None:
        number, rounds, k = job
        model = train(folds[k].filter(F.col("fold") < k), {**trials[number], "maxIter": rounds})
        tests = _scored(model, folds[k].filter(F.col("fold") == k))
        return tests.agg(F.avg(F.abs(F.col("label") - F.col("yhat")))).first()[0]

    found, running = {t: (True, 0.0, 0) for t in range(len(trials))}, list(range(len(trials)))
    with ThreadPoolExecutor(parallel) as pool:
        for step in range(steps):
            part, judged = share ** (steps - 1 - step), {}
            rounds = {t: -(-trials[t].get("maxIter", DEFAULTS["maxIter"]) // part) for t in running}
            jobs = [(t, rounds[t], k) for t in running for k in numbers]
            errors = list(zip(jobs, pool.map(error, jobs)))
            for t in running:
                own = [e for job, e in errors if job[0] == t and e is not None]
                # trials that no split could judge come last
                judged[t] = (not own, sum(own) / max(len(own), 1), rounds[t])
                found[t] = min(found[t], judged[t])
            running = sorted(running, key=lambda t: (judged[t], t))[: max(1, -(-len(running) // share))]
    best = min(found, key=lambda t: (found[t], t), default=None)
    table = [(t, json.dumps(dict(trials[t]), sort_keys=True), rounds, None if unjudged else mae, t == best) for t, (unjudged, mae, rounds) in found.items()]
    return spark.createDataFrame(table, "trial int, params string, rounds int, mae double, is_best boolean")
