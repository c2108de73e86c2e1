"""Combining forecasts and choosing between models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.keys import as_list
from .baseline import Z95

Key = str | Sequence[str]

# Error above which a model still needs work.
NEEDS_WORK = 50.0


def ensemble(members: DataFrame, key: Key = "location", ds: str = "ds") -> DataFrame:
    """Mean of the members per day, with a band from their sample deviation."""
    out = members.groupBy(*as_list(key), ds).agg(
        F.avg("yhat").alias("yhat"), F.stddev_samp("yhat").alias("yhat_std"), F.count("*").alias("members")
    )
    spread = Z95 * F.col("yhat_std")
    return out.withColumns({"yhat_lower": F.col("yhat") - spread, "yhat_upper": F.col("yhat") + spread})


def align_forecasts(members: DataFrame, models: Sequence[str], key: Key = "location", ds: str = "ds") -> DataFrame:
    """One column per model, aligned on series and day by conditional aggregation."""
    columns = [F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models]
    return members.groupBy(*as_list(key), ds).agg(*columns)


def best_model(scores: DataFrame, key: Key = "location") -> DataFrame:
    """Model with the lowest error per key, ties to the first name."""
    best = F.min(F.struct("mape", "model"))
    return scores.groupBy(*as_list(key)).agg(best.alias("_b")).select(
        *as_list(key), F.col("_b.model").alias("best_model"), F.col("_b.mape").alias("best_mape")
    )


def model_comparison(scores: DataFrame, key: Key = "location") -> DataFrame:
    """Per model: mean error, series won, and won with an error below the limit.

    The winner of a series is marked in place, so the scores are read once; the
    overall best is picked from the one row per model that is left.
    """
    best = F.min(F.struct("mape", "model")).over(Window.partitionBy(*as_list(key)))
    won = scores.withColumn("_won", best["model"] == F.col("model"))
    rows = won.groupBy("model").agg(
        F.avg("mape").alias("avg_mape"),
        F.count("*").alias("locations"),
        F.count_if("_won").alias("wins"),
        F.count_if(F.col("_won") & (F.col("mape") < NEEDS_WORK)).alias("wins_below_50"),
    )
    lead = F.min(F.struct("avg_mape", "model")).over(Window.partitionBy(F.lit(1)))["model"]
    return rows.withColumn("is_best_overall", F.col("model") == lead)


def single_or_ensemble(single: DataFrame, combined: DataFrame, key: Key = "location") -> DataFrame:
    """Per series the better of a tuned single model and the ensemble."""
    keys = as_list(key)
    both = single.select(*keys, F.col("mape").alias("single_mape")).join(
        combined.select(*keys, F.col("mape").alias("ensemble_mape")), keys, "left"
    )
    wins = F.coalesce(F.col("ensemble_mape") < F.col("single_mape"), F.lit(False))
    out = both.withColumn("model_type", F.when(wins, "ensemble").otherwise("single"))
    out = out.withColumn("mape", F.when(wins, F.col("ensemble_mape")).otherwise(F.col("single_mape")))
    return out.withColumn("improvement_needed", F.col("mape") > NEEDS_WORK)
