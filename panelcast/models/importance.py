"""Permutation importance of the inputs of each series' model, all series in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators.keys import as_list, named

Key = str | Sequence[str]

# Share of the last rows that are predicted, ridge penalty on scaled inputs, seed.
TEST_SHARE, PENALTY, SEED = 0.2, 1.0, 42


def permutation_importances(frame: DataFrame, features: Sequence[str], key: Key = "location", ds: str = "ds", y: str = "y", test_share: float = TEST_SHARE, repeats: int = 5) -> DataFrame:
    """Per series and feature, how much the mean absolute error of a ridge model grows when the feature is shuffled.

    The model learns from the first rows of a series, scaled by their mean and
    deviation; every variant of the last rows has one feature shuffled by a seeded
    permutation, and the growth is averaged over ``repeats`` of them. As the model is linear, a variant is the
    prediction plus the change of one term, so all variants of a series are one
    matrix; a series is never longer than the calendar. Missing inputs count as the
    training mean, rows without a target are left out, and a series with too few rows
    for both parts has no importances.
    """
    keys, inputs = as_list(key), list(features)
    rows = frame.select(*keys, F.unix_date(ds).alias("day"), F.col(y).cast("double").alias("target"), *[named(f).cast("double").alias(f"x{i}") for i, f in enumerate(inputs)])
    types = StructType.fromDDL("feature string, importance double")

    def run(series: pa.Table) -> pa.Table:
        series = series.sort_by("day")
        target = series.column("target").to_numpy()
        x = np.column_stack([series.column(f"x{i}").to_numpy() for i in range(len(inputs))]).astype(float)
        kept = ~np.isnan(target)
        x, target = x[kept], target[kept]
        ids = series.select(keys).slice(0, 1)
        cut = len(target) - int(len(target) * test_share)
        if cut < 2 or cut == len(target):
            nothing = ids.slice(0, 0)
            return nothing.append_column("feature", pa.array([], pa.string())).append_column("importance", pa.array([], pa.float64()))
        counts = np.maximum((~np.isnan(x[:cut])).sum(axis=0), 1)
        means = np.nansum(x[:cut], axis=0) / counts
        x = np.where(np.isnan(x), means, x) - means
        spread = x[:cut].std(axis=0)
        x = np.where(spread > 1e-9 * np.maximum(np.abs(means), 1), x / np.where(spread > 0, spread, 1), 0.0)
        level = target[:cut].mean()
        beta = np.linalg.solve(x[:cut].T @ x[:cut] + PENALTY * np.eye(len(inputs)), x[:cut].T @ (target[:cut] - level))
        tests, actual = x[cut:], target[cut:, None]
        plain = (level + tests @ beta)[:, None]
        draw, grown = np.random.default_rng(SEED), np.zeros(len(inputs))
        for _ in range(repeats):
            shuffled = draw.permuted(tests, axis=0)
            grown += np.abs(actual - (plain + (shuffled - tests) * beta)).mean(axis=0) - np.abs(actual - plain).mean()
        out = ids.take(pa.array(np.zeros(len(inputs), np.int64)))
        return out.append_column("feature", pa.array(inputs)).append_column("importance", pa.array(grown / repeats))

    return rows.groupBy(*keys).applyInArrow(run, StructType([*[rows.schema[k] for k in keys], *types.fields]))
