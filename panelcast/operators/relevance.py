"""How strongly features relate to the target."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.files import checkpointed
from .keys import named

# Limits of the correlation classes.
HIGH, MODERATE, VERY_HIGH, NEGLIGIBLE = 0.3, 0.1, 0.5, 0.05
BINS = 10


def absolute_correlation(x: Column, y: Column) -> Column:
    """Absolute correlation, 0 where one side does not vary (``corr`` itself divides by zero there)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    flat = F.min(a).eqNullSafe(F.max(a)) | F.min(b).eqNullSafe(F.max(b))
    share = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.abs(share), F.lit(0.0)))


def _numbers(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """The target, then the features, as they are stored, under plain names."""
    return _plain(df, [y, *features])


def _plain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns as doubles, missing ones NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy", "lx", "hx", "ly", "hy")


def _moments(values: np.ndarray) -> np.ndarray:
    """Rows of MOMENTS for every column behind the first with the first one, over pairs without a gap."""
    x, y = values[:, 1:], values[:, :1]
    known = ~np.isnan(x) & ~np.isnan(y)
    n = known.sum(axis=0)
    mx, my = (np.where(known, v, 0.0).sum(axis=0) / np.maximum(n, 1) for v in (x, y))
    dx, dy = (np.where(known, v - m, 0.0) for v, m in ((x, mx), (y, my)))
    low, high = np.where(known, x, np.inf).min(axis=0), np.where(known, x, -np.inf).max(axis=0)
    low_y, high_y = np.where(known, y, np.inf).min(axis=0), np.where(known, y, -np.inf).max(axis=0)
    return np.stack([n, mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0), low, high, low_y, high_y])


def correlations(df: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """Absolute correlation of every feature with the target; 0 for a constant.

    A batch is reduced to one row of moments per feature, whatever the number of
    features; the moments of the batches are merged around their common mean.
    """
    names = list(features)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(m) for m in _moments(_matrix(batch)))], ["feature", *MOMENTS])

    parts = _numbers(df, names, y).mapInArrow(reduce, "feature string, " + ", ".join(f"{m} double" for m in MOMENTS))
    whole = Window.partitionBy("feature")
    for m in ("mx", "my"):
        parts = parts.withColumn(f"_{m}", F.try_divide(F.sum(F.col("n") * F.col(m)).over(whole), F.sum("n").over(whole)))
    ox, oy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    merged = parts.groupBy("feature").agg(
        F.sum(F.col("cxx") + F.col("n") * ox * ox).alias("xx"), F.sum(F.col("cyy") + F.col("n") * oy * oy).alias("yy"), F.sum(F.col("cxy") + F.col("n") * ox * oy).alias("xy"),
        (F.min("lx") >= F.max("hx")).alias("flat_x"), (F.min("ly") >= F.max("hy")).alias("flat_y"),
    )
    share = F.coalesce(F.abs(F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))), F.lit(0.0))
    return merged.select("feature", F.when(F.col("flat_x") | F.col("flat_y"), F.lit(0.0)).otherwise(share).alias("correlation"))


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(feature, bin, edge): the least value of each of ``bins`` equally full bins of every column.

    The bin of a value is the share of smaller values, times ``bins``, rounded down, so
    equal values share a bin and bins may stay empty. All columns are counted in one
    table of distinct values; it is cut into ranges of (column, value), which split a
    long column, and each range starts its running count where the ranges before it end.
    """
    names = list(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in zip(names, _matrix(batch).T if batch.num_rows else ()):
                values, n = np.unique(column[~np.isnan(column)] + 0.0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n)], ["feature", "value", "n"])

    counted = _plain(df, names).mapInArrow(count, "feature string, value double, n long")
    summed = counted.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ranged = checkpointed(summed.repartitionByRange("feature", "value").withColumn("slice", F.spark_partition_id()), "value-counts")
    inside = F.sum("n").over(Window.partitionBy("slice", "feature").orderBy("value")) - F.col("n")
    whole = Window.partitionBy("feature")
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("slice", "feature").agg(F.sum("n").alias("_n"))
    starts = parts.select("slice", "feature", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    placed = ranged.withColumn("_inside", inside).join(starts, ["slice", "feature"])
    bin_ = F.call_function("div", (F.col("_inside") + F.col("_before")) * bins, F.col("_all"))
    return placed.groupBy("feature", bin_.cast("int").alias("bin")).agg(F.min("value").alias("edge"))


def mutual_information(df: DataFrame, features: Sequence[str], y: str = "y", bins: int = BINS) -> DataFrame:
    """Mutual information with the target over equally full bins of both, in nats.

    The edges, ``bins`` per column at most, go to the tasks; a task reduces each batch to
    a table of joint counts per feature.
    """
    names = [y, *features]
    edges: dict[str, list[float]] = {}
    for row in quantile_edges(df, names, bins).orderBy("feature", "bin").collect():  # bins rows per column at most
        edges.setdefault(row["feature"], []).append(row["edge"])
    of_y, of_x = edges.get(y, [0.0]), [edges.get(f, [0.0]) for f in features]
    inputs = list(features)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch)
            target = np.searchsorted(of_y, values[:, 0], side="right") - 1
            out: dict[str, list] = {"feature": [], "bx": [], "by": [], "n": []}
            for name, own, column in zip(inputs, of_x, values[:, 1:].T):
                known = ~np.isnan(column) & ~np.isnan(values[:, 0])
                cells = np.bincount((np.searchsorted(own, column[known], side="right") - 1) * bins + target[known], minlength=bins * bins)
                full = np.flatnonzero(cells)
                out["feature"] += [name] * len(full)
                out["bx"] += (full // bins).tolist()
                out["by"] += (full % bins).tolist()
                out["n"] += cells[full].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out["feature"], pa.string()), *(pa.array(out[c], pa.int64()) for c in ("bx", "by", "n"))], list(out))

    joint = _numbers(df, features, y).mapInArrow(count, "feature string, bx long, by long, n long")
    return _information(joint.groupBy("feature", "bx", "by").agg(F.sum("n").alias("n")))


def _information(joint: DataFrame) -> DataFrame:
    """Sum of p * ln(p / (px * py)) per feature; at most bins**2 rows each."""
    def total(*keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy("feature", *keys))

    shares = joint.withColumns({"nx": total("bx"), "ny": total("by"), "nn": total()})
    gain = F.col("n") / F.col("nn") * F.log(F.col("n").cast("double") * F.col("nn") / (F.col("nx").cast("double") * F.col("ny")))
    return shares.groupBy("feature").agg(F.sum(gain).alias("mutual_information"))


def correlation_classes(scores: DataFrame) -> DataFrame:
    c = F.col("correlation")
    return scores.agg(
        F.count("*").alias("total_features"),
        F.count_if(c > HIGH).alias("highly_correlated"),
        F.count_if((c > MODERATE) & (c <= HIGH)).alias("moderately_correlated"),
        F.count_if(c <= MODERATE).alias("low_correlated"),
        F.count_if(c > VERY_HIGH).alias("very_highly_correlated"),
        F.count_if(c < NEGLIGIBLE).alias("negligible"),
    )
