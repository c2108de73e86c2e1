"""Query on secrets in the training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import workspace
from . import blobscan
from .registry import query
from .store import table


def _finds(rule: blobscan.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, stop - length(m) AS start, stop, length(part) AS n FROM (
    SELECT doc_id, m, part, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(parts) AS part, unnest(range(len(ms))) AS k FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', {rule.group}) AS parts FROM d))) WHERE length(part) >= {rule.least}"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), f AS ({" UNION ALL ".join(_finds(r, i) for i, r in enumerate(blobscan.RULES))}
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < {len(blobscan.BASE)}) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


#: The rules as they were at the first commit: one of them older, one not there yet.
EARLIER = [*blobscan.BASE, blobscan.MORE[0], blobscan.Rule("github", "ghp_[A-Za-z0-9]{36}", 0, 40, 0)]


@query("op7_secret_scans", OP7_SQL)
def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the documents under earlier rules, then all under the current ones, which scans what the first commit lacks."""
    docs, ledger = table(spark, folder, "documents"), workspace(spark, "blobs")
    blobscan.commit(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger, 1, EARLIER)
    blobscan.commit(docs, ledger, 2)
    return blobscan.by_path(docs, ledger).drop("blob")
