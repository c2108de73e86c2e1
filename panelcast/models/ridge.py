"""What runs inside tasks for the additive model: designs, sums of outer products and ridge solves."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa

# Trend change points and the share of the history they cover,
# seasonal blocks as (period in days, harmonics), shortest history.
CHANGEPOINTS, CHANGEPOINT_RANGE = 10, 0.8
SEASONS = {"yearly": (365.25, 5), "weekly": (7.0, 3), "monthly": (30.5, 5), "quarterly": (91.25, 8)}
MIN_ROWS = 30
# Assumed noise variance of a series scaled to 1; turns prior scales into penalties.
NOISE = 0.01


def used_blocks(param_sets: Mapping[str, Mapping]) -> tuple[str, ...]:
    """Column blocks any of the parameter sets asks for; the others are never computed."""
    seasons = [name for name in SEASONS if any(p[f"{name}_seasonality"] for p in param_sets.values())]
    regressors = ["regressors"] if any(p["regressors"] for p in param_sets.values()) else []
    return ("base", "changepoint", *seasons, *regressors)


def column_ranges(names: Sequence[str]) -> dict[str, slice]:
    """Position of each block in the design array."""
    sizes = {"base": 2, "changepoint": CHANGEPOINTS, "regressors": 2, **{k: 2 * n for k, (_, n) in SEASONS.items()}}
    ranges, start = {}, 0
    for name in names:
        ranges[name] = slice(start, start + sizes[name])
        start += sizes[name]
    return ranges


def width(names: Sequence[str]) -> int:
    return max(r.stop for r in column_ranges(names).values())


def design(days: np.ndarray, start: int, end: int, names: Sequence[str]) -> np.ndarray:
    """Design rows of days since 1970; the trend position runs from 0 to 1 over the history."""
    position = (days - start) / max(end - start, 1)
    terms = [np.ones(len(days)), position]
    terms += [np.maximum(0.0, position - CHANGEPOINT_RANGE * j / (CHANGEPOINTS + 1)) for j in range(1, CHANGEPOINTS + 1)]
    for name, (period, harmonics) in SEASONS.items():
        for k in range(1, harmonics + 1) if name in names else ():
            angle = days * (2 * math.pi * k / period)
            terms += [np.sin(angle), np.cos(angle)]
    if "regressors" in names:
        # day 0 was a Thursday
        terms += [((days + 3) % 7 >= 5).astype(float), days.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) % 12 / 12 + 1 / 12]
    return np.column_stack(terms)


def moments(days: np.ndarray, y: np.ndarray, start: int, end: int, names: Sequence[str]) -> np.ndarray:
    """Design columns with the target and its logarithm behind them."""
    return np.column_stack([design(days, start, end, names), y, np.log1p(np.maximum(y, 0.0))])


def penalties(params: Mapping, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ridge penalty per column, and which columns take part."""
    ranges = column_ranges(names)
    penalty = np.full(width(names), NOISE / params["seasonality_prior_scale"] ** 2)
    penalty[ranges["base"]] = 1e-8
    penalty[ranges["changepoint"]] = NOISE / params["changepoint_prior_scale"] ** 2
    active = np.ones(width(names), dtype=bool)
    for name, columns in ranges.items():
        if name in SEASONS:
            active[columns] = bool(params[f"{name}_seasonality"])
        elif name == "regressors":
            active[columns] = bool(params["regressors"])
    return penalty, active


def solve(grams: np.ndarray, counts: np.ndarray, params: Mapping, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual deviation for a stack of Gram matrices."""
    size = width(names)
    target = size + (params["seasonality_mode"] == "multiplicative")
    penalty, active = penalties(params, names)
    picked = np.flatnonzero(active)
    systems = grams[:, picked[:, None], picked] + np.diag(penalty[picked])
    beta = np.zeros((len(grams), size))
    beta[:, picked] = np.linalg.solve(systems, grams[:, picked, target][..., None])[..., 0]
    squared = grams[:, target, target] - 2 * np.einsum("fi,fi->f", beta, grams[:, :size, target]) + np.einsum("fi,fij,fj->f", beta, grams[:, :size, :size], beta)
    return beta, np.sqrt(np.maximum(squared, 0.0) / np.maximum(counts, 1.0))


def fold_grams(rows: np.ndarray, segment: np.ndarray, training: str, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fold, rows it trains on, Gram matrix of them) of all folds with enough rows.

    A fold trains on all rows (``full``), on the segments numbered at or above it
    (``expanding``) or on ``span`` segments from it on (``rolling``): a difference of
    sums over the segments from each number on.
    """
    last = int(segment.max(initial=-1))
    if last < 0:
        return np.zeros(0, int), np.zeros(0), np.zeros((0, rows.shape[1], rows.shape[1]))
    sums, counts = np.zeros((last + 2, rows.shape[1], rows.shape[1])), np.zeros(last + 2)
    order = np.argsort(segment, kind="stable")
    bounds = np.searchsorted(segment[order], np.arange(last + 2))
    for s in range(last, -1, -1):
        part = rows[order[bounds[s] : bounds[s + 1]]]
        sums[s], counts[s] = sums[s + 1] + part.T @ part, counts[s + 1] + len(part)
    if training == "full":
        folds, ends = np.zeros(1, int), np.array([last + 1])
    elif training == "expanding":
        folds, ends = np.arange(last + 1), np.full(last + 1, last + 1)
    else:
        folds = np.arange(max(last - span + 2, 0))
        ends = folds + span
    n = counts[folds] - counts[ends]
    kept = n >= MIN_ROWS
    return folds[kept], n[kept], sums[folds[kept]] - sums[ends[kept]]


def forecaster(keys: list[str], param_sets: Mapping[str, Mapping], training: str, span: int, ahead: int, z: float):
    """Fits and predictions of one series, from its days alone.

    Rows with a ``segment`` train, rows with a ``fold`` are predicted by the fit of that
    fold. ``ahead`` adds the days behind the history, predicted by the only fit.
    """
    names = used_blocks(param_sets)

    def run(series: pa.Table) -> pa.Table:
        days, y, segment, fold, step = (series.column(c).to_pandas().to_numpy(float) for c in ("day", "y", "segment", "fold", "step"))
        trained = ~np.isnan(segment)
        start, end = (int(f(days[trained])) if trained.any() else 0 for f in (np.min, np.max))
        used = trained & ~np.isnan(y)
        folds, counts, grams = fold_grams(moments(days[used].astype(int), y[used], start, end, names), segment[used].astype(int), training, span)
        tested = ~np.isnan(fold)
        day, actual, of, at = days[tested].astype(int), y[tested], fold[tested].astype(int), step[tested]
        if ahead:
            future = np.arange(1, ahead + 1)
            day, actual, of, at = end + future, np.full(ahead, np.nan), np.zeros(ahead, int), future.astype(float)
        place = np.full(max(of.max(initial=-1), folds.max(initial=-1)) + 1, -1)
        place[folds] = np.arange(len(folds))
        known = place[of] >= 0 if len(of) else np.zeros(0, bool)
        day, actual, of, at = day[known], actual[known], of[known], at[known]
        x, own = design(day, start, end, names), place[of] if len(of) else of
        parts = []
        for name, params in param_sets.items() if len(day) else ():
            beta, sigma = solve(grams, counts, params, names)
            middle, band = np.einsum("ri,ri->r", x, beta[own]), z * sigma[own]
            shown = np.expm1 if params["seasonality_mode"] == "multiplicative" else np.asarray
            values = [pa.array(day, pa.int32()).cast(pa.date32()), pa.array(of, pa.int32()), pa.array(at.astype(np.int32)), pa.array(actual, from_pandas=True)]
            values += [pa.array([name] * len(day), pa.string()), *(pa.array(shown(v)) for v in (middle, middle - band, middle + band))]
            ids = series.select(keys).take(pa.array(np.zeros(len(day), np.int64)))
            parts.append(pa.table([*ids.columns, *values], names=[*keys, *OUT]))
        return pa.concat_tables(parts) if parts else pa.table([*series.select(keys).slice(0, 0).columns, *(pa.array([], t) for t in OUT.values())], names=[*keys, *OUT])

    return run


OUT = {"ds": pa.date32(), "fold": pa.int32(), "step": pa.int32(), "actual": pa.float64(), "params": pa.string(), "yhat": pa.float64(), "yhat_lower": pa.float64(), "yhat_upper": pa.float64()}


def mean_moments(keys: list[str], names: Sequence[str]):
    """Per series the mean products of all pairs of design and target columns."""

    def run(series: pa.Table) -> pa.Table:
        days, y = (series.column(c).to_numpy() for c in ("day", "y"))
        rows = moments(days.astype(np.int64), y.astype(float), int(days.min()), int(days.max()), names)
        i, j = np.triu_indices(rows.shape[1])
        means = (rows.T @ rows / len(rows))[i, j]
        ids = series.select(keys).take(pa.array(np.zeros(len(i), np.int64)))
        return pa.table([*ids.columns, pa.array(i), pa.array(j), pa.array(means)], names=[*keys, "i", "j", "mean"])

    return run
