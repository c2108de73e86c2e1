"""Queries on token output: grammar shards and packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import workspace
from . import grammar, packing
from .registry import query
from .store import table

BYTE_BPE, BYTE_END, BYTE_IDS = "byte_bpe_50k.json", 2, 50_257
WORD_BPE, WORD_END, CAPACITY = "word_bpe_49k.json", 1, 4096


@query("op1_grammar_shards")
def grammar_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents encoded, compressed into grammar shards, and read back from them."""
    path = workspace(spark, "grammar")
    grammar.write_shards(table(spark, folder, "documents"), path, public_tokenizers.path(BYTE_BPE), BYTE_END, BYTE_IDS)
    return grammar.read_documents(spark.read.parquet(path))


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE), WORD_END, CAPACITY)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
