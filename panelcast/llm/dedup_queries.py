"""Queries on near duplicates: lines by edit distance, documents by shared n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import jaccard, linededup
from .registry import query
from .store import table

SHINGLE_WORDS, SIMILAR_PERCENT = 4, 85


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its long lines, how many lines of any length are dropped, and which."""
    docs = linededup.keyed(table(spark, folder, "documents").select("doc_id", "text"))
    lines = linededup.duplicate_lines(docs, exact_chars=1)
    gone = F.array_sort(F.collect_set(F.when(F.col("dropped"), F.col("number"))))
    counts = lines.groupBy("row_key").agg(F.size(F.collect_set(F.when(F.col("long"), F.col("number")))).cast("long").alias("n_long_lines"), gone.alias("gone"))
    joined = docs.select("row_key").join(counts, "row_key", "left")
    n_dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    dropped = F.array_join(F.coalesce(F.col("gone").cast("array<string>"), F.array()), ",")
    return joined.select("row_key.doc_id", F.coalesce("n_long_lines", F.lit(0)).alias("n_long_lines"), n_dropped.alias("n_dropped"), dropped.alias("dropped"))


OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, words, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < {SHINGLE_WORDS} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(words[i:i + {SHINGLE_WORDS - 1}], ' '))) END AS grams FROM w
), n AS MATERIALIZED (SELECT doc_id, len(grams) AS n FROM s
), g AS MATERIALIZED (SELECT doc_id, unnest(grams) AS gram FROM s
), shared AS (SELECT gram, row_number() OVER () AS k FROM g GROUP BY gram HAVING count(*) > 1
), gk AS MATERIALIZED (SELECT doc_id, k FROM g JOIN shared USING (gram)
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM gk x JOIN gk y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {SIMILAR_PERCENT} * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL
"""


@query("op10_ngram_jaccard_join", OP10_SQL)
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_classes(table(spark, folder, "documents"), SHINGLE_WORDS, SIMILAR_PERCENT)
