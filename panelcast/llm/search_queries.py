"""Query on benchmark passages in the training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import positions
from .registry import query
from .store import table

WINDOW = 13
#: All terms of a window within twice its length count as near.
SPAN = 2 * WINDOW

OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS width, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' '))) AS win FROM b WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM bw
), dw AS (
  SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS i, w FROM d, widths WHERE len(w) >= width
), hits AS (
  SELECT doc_id, i, bw.width, item_id FROM (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS win FROM dw) x JOIN bw ON x.win = bw.win AND x.width = bw.width
), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS p FROM hits
), c AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id
), t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return positions.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), WINDOW).drop("n_near")


@query("op8_phrase_and_proximity")
def phrase_and_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op8_benchmark_decontamination, and ``n_near``: items whose terms lie close together, in any order."""
    return positions.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), WINDOW, SPAN)
