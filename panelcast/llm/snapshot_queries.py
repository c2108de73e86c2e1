"""Query on exact duplicates among documents that come in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import workspace
from . import snapshots
from .registry import query
from .store import table

#: The documents are committed in this many batches, by a hash of their id.
BATCHES = 3

OP12_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
), g AS (SELECT t, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


@query("op12_exact_dedup", OP12_SQL)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs, ledger = table(spark, folder, "documents"), workspace(spark, "snapshots")
    for number in range(BATCHES):
        snapshots.commit(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == number), ledger, number)
    found = snapshots.by_document(docs, ledger, BATCHES)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
