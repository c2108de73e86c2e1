"""Documents to packed training sequences, in five stages.

Every stage is a function of (spark, docs, sf_dir) and works on all that the
stage before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.llm import jaccard, linededup, packing, positions, quality
from panelcast.llm.store import table, written
from panelcast.llm.token_queries import CAPACITY, WORD_BPE, WORD_END


def _measured(docs: DataFrame) -> DataFrame:
    """The column of text lengths follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines too common in their source."""
    return _measured(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without equal lines of any length and near copies of long ones; those with nothing but repeats go."""
    kept = linededup.dedup_lines(docs, exact_chars=1)
    emptied = (F.col("n_dropped") > 0) & (F.trim("text", F.lit(" \t\n\r")) == "")
    return _measured(kept.where(~emptied).drop("n_dropped"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id."""
    classes = jaccard.join_classes(docs)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"))
    own = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
    # rows equal in id and text are one document
    whole = own.select(F.col("doc_id"), F.xxhash64("text").alias("twin"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.dropDuplicates(["doc_id", "twin"]).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated."""
    found = positions.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = found.select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in a training sequence."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), WORD_END, CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# The packing's plan is not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
