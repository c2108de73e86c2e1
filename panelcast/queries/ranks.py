"""Sort, limit and top-k queries (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import importance, trees
from ..operators import features, ranking, relevance
from ..operators.keys import named
from ..sources import tables
from .aggregates import CORRELATION, INFORMATION_SQL, LONG_SQL, feature_frame, with_clause
from .joins import all_forecasts, holdout_scores
from .registry import q6, query, rounded
from .views import with_views


@query("k01_sort_series", with_views(f"SELECT location, ds, y, is_weekend, month, {q6('disease_severity')} FROM series ORDER BY location, ds", "series"))
def k01(spark, sf):
    return rounded(tables.series(spark, sf)).orderBy("location", "ds")


TOP = 20


@query(
    "k02_top_features",
    with_clause(
        f"{INFORMATION_SQL},\nc AS (SELECT feature, {CORRELATION} AS correlation FROM long GROUP BY feature)",
        f"""SELECT * FROM (SELECT 'correlation' AS measure, feature, {q6('correlation', 'score')} FROM c ORDER BY score DESC, feature LIMIT {TOP})
            UNION ALL SELECT * FROM (SELECT 'mutual_information', feature, {q6('mutual_information', 'score')} FROM mi ORDER BY score DESC, feature LIMIT {TOP})""",
    ),
)
def k02(spark, sf):
    frame, names = feature_frame(spark, sf)
    scores = relevance.correlations(frame, names).withColumnRenamed("correlation", "score").withColumn("measure", F.lit("correlation"))
    shared = relevance.mutual_information(frame, names).withColumnRenamed("mutual_information", "score")
    shared = shared.withColumn("measure", F.lit("mutual_information"))
    best = [ranking.top_rows(rounded(s), TOP, F.desc("score"), F.asc("feature")) for s in (scores, shared)]
    return best[0].unionByName(best[1]).select("measure", "feature", "score")


def local_importances(frame, names):
    """Absolute correlation with the target per series and feature."""
    target = F.col("y").cast("double")
    wide = frame.groupBy("location").agg(*[relevance.absolute_correlation(named(f).cast("double"), target).alias(f) for f in names])
    return wide.unpivot(["location"], [named(f) for f in names], "feature", "importance").withColumn("feature", F.translate("feature", "`", ""))


@query(
    "k03_top_features_per_location",
    with_clause(
        LONG_SQL,
        f"""SELECT location, feature, importance FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY importance DESC, feature) AS k FROM
            (SELECT location, feature, {q6(f'round({CORRELATION}, 4)', 'importance')} FROM long GROUP BY location, feature)) WHERE k <= {TOP}""",
    ),
)
def k03(spark, sf):
    scores = local_importances(*feature_frame(spark, sf)).withColumn("importance", F.round("importance", 4))
    best = ranking.top_per_key(rounded(scores), TOP, "location", F.desc("importance"), F.asc("feature"))
    return best.select("location", "feature", "importance")


@query("k03_permutation_importance")
def k03_permutation(spark, sf):
    """The inputs whose shuffling hurts the model of their series most."""
    scores = importance.permutation_importances(*feature_frame(spark, sf)).withColumn("importance", F.round("importance", 4))
    best = ranking.top_per_key(scores, TOP, "location", F.desc("importance"), F.asc("feature"))
    return rounded(best.select("location", "feature", "importance"))


@query("k04_top_locations", with_views(f"SELECT location, {q6('accuracy')} FROM mean_scores ORDER BY accuracy DESC, location LIMIT 3", "mean_scores"))
def k04(spark, sf):
    scores = holdout_scores(spark, sf).filter(F.col("model") == "historical_average").select("location", "accuracy")
    return rounded(ranking.top_rows(scores, 3, F.desc("accuracy"), F.asc("location")))


@query("k05_first_days", with_views(f"SELECT model, location, ds, {q6('yhat')} FROM forecasts WHERE step <= 7", "forecasts"))
def k05(spark, sf):
    return rounded(ranking.first_days(all_forecasts(spark, sf), 7, ["model", "location"]).select("model", "location", "ds", "yhat"))


@query(
    "k06_recent_days",
    with_views("SELECT location, ds, y FROM (SELECT *, max(ds) OVER (PARTITION BY location) AS m FROM series) WHERE ds >= m - 60", "series"),
)
def k06(spark, sf):
    return rounded(ranking.recent_days(tables.series(spark, sf), 60).select("location", "ds", "y"))


@query("k07_last_rows", with_views("SELECT location, ds, y FROM positions WHERE r >= n - 90", "positions"))
def k07(spark, sf):
    return rounded(ranking.last_rows(tables.series(spark, sf), 90).select("location", "ds", "y"))


@query("k08_importance_rank")
def k08(spark, sf):
    """Importance order of the boosted-tree model's inputs on each series."""
    frame = trees.model_features(tables.series(spark, sf))
    scores = trees.series_importances(frame, features.numeric_features(frame)).withColumn("importance", F.round("importance", 6))
    return ranking.importance_rank(scores, "location")


