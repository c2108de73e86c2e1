"""Query on language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import backoff
from .registry import query
from .store import table

OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), o AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), u AS (SELECT word, count(*) AS c FROM o GROUP BY word
), t AS (SELECT count(*) AS n FROM o
), p AS (SELECT before, word, count(*) AS c FROM o WHERE before IS NOT NULL GROUP BY ALL
), s AS (
  SELECT o.doc_id, CASE WHEN p.c >= 2 THEN ln(p.c) - ln(b.c) ELSE ln(u.c) - ln(t.n) + CASE WHEN o.before IS NULL THEN 0 ELSE ln(0.4) END END AS l,
    o.before IS NOT NULL AND p.c < 2 AS miss
  FROM o JOIN u ON o.word = u.word CROSS JOIN t LEFT JOIN p ON o.before = p.before AND o.word = p.word LEFT JOIN u b ON o.before = b.word
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (miss) AS n_backoff, round(coalesce(fsum(l), 0), 4) + 0.0 AS log_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, w
"""


@query("op6_stupid_backoff", OP6_SQL)
def stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    scored = backoff.score(table(spark, folder, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4) + F.lit(0.0))
