"""Query on quality rules with line frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .registry import query
from .store import table

BLANKS = "[\\x20\\x09-\\x0D]+"
OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, text AS raw FROM documents
), p AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{BLANKS}'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM d
), l AS (
  SELECT doc_id, host, raw, unnest(list_filter(ls, lambda x: regexp_replace(x, '{BLANKS}', '', 'g') <> '')) AS line FROM p
), ln AS (
  SELECT doc_id, host, raw, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '{BLANKS}', ' ', 'g'), ' ') AS norm FROM l
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM p WHERE len(w) >= 5
), wk AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM win
), rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM wk) WHERE c > 1
), cov AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS q FROM rep) GROUP BY doc_id
), hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host
), freq AS (SELECT host, norm, count(DISTINCT raw) AS n_docs, min(doc_id) AS first FROM ln GROUP BY host, norm
), common AS (SELECT host, norm, first FROM freq JOIN hosts USING (host) WHERE n_docs > {quality.MAX_DOCS} OR n_docs > {quality.MIN_DOCS} AND 100 * n_docs > {quality.HOST_PERCENT} * host_docs
), gone AS (
  SELECT doc_id, sum(len(string_split(norm, ' '))) AS removed FROM ln JOIN common USING (host, norm) WHERE doc_id <> first GROUP BY doc_id
), s AS (
  SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{BLANKS}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM p LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (100 * (n_words - removed) < {quality.KEEP_PERCENT} * n_words) AS kept,
  CAST(removed AS BIGINT) AS removed_words
FROM s
"""


@query("op2_quality_rules", OP2_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.assess(table(spark, folder, "documents")).select("doc_id", *counts, "base_failed", "kept", "removed_words")
