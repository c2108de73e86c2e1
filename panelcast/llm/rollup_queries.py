"""Query on token counts per source, language and tokenizer version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.files import workspace
from . import rollups
from .registry import query
from .store import table, words

SHORT = 10
BLANKS = "[\\x20\\x09-\\x0D]+"
# Tokenizer versions that SQL can repeat. The second splits a word
# into runs of ASCII letters, runs of digits and runs of anything else.
PIECES = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]+"

OP4_SQL = f"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '')) AS n FROM documents
), c AS (
  SELECT source, lang, 'words-1' AS tokenizer, n, n AS tokens FROM d
  UNION ALL SELECT source, lang, 'pieces-1', n, len(regexp_extract_all(t, '{PIECES}')) FROM d
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM c WHERE n >= {SHORT} GROUP BY ALL
"""


@query("op4_token_rollups", OP4_SQL)
def token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches over all documents, the last committed twice.

    The first counts every document as inserted, with a rough count by length; the
    second revises each to its exact counts; the third deletes the short ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", F.char_length(text).alias("chars"), F.size(words(text)).alias("words"), F.size(F.regexp_extract_all(text, F.lit(PIECES), 0)).alias("pieces"))
    versions = F.explode(F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("exact")), F.struct(F.lit("pieces-1").alias("tokenizer"), F.col("pieces").alias("exact"))))
    path = workspace(spark, "counts")
    counts = docs.select("doc_id", "source", "lang", "chars", "words", versions.alias("v")).select("doc_id", "source", "lang", "words", "v.*", F.expr("chars div 4").alias("rough"))
    counts.write.parquet(f"{path}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{path}/counts")
    none = F.lit(None)

    def events(before: Column, after: Column) -> DataFrame:
        return counts.select(F.struct("doc_id", "tokenizer").alias("event_id"), "tokenizer", before.alias("before"), after.alias("after"))

    rough, exact = (rollups.image(F.col("source"), F.col("lang"), F.col(c)) for c in ("rough", "exact"))
    empty = none.cast("struct<source:string,lang:string,tokens:bigint>")
    batches = [events(empty, rough), events(rough, exact), events(F.when(F.col("words") < SHORT, exact), empty)]
    for number in (0, 1, 2, 2):
        rollups.commit(batches[number], f"{path}/store", number, unique=True)
    return rollups.totals(spark, f"{path}/store")
