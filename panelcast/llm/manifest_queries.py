"""Query on the Merkle manifest of the training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import merkle
from .registry import query
from .store import table

#: Rows whose id has a checksum divisible by this are shown to the verifier with another length.
TAMPERED = 7


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS digits, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS other FROM documents
), c AS (
  SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(digits) + 1), lambda i: ascii(digits[i])::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM d
), langs AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM documents)
), l AS MATERIALIZED (
  SELECT doc_id, leaf, CASE WHEN crc % {TAMPERED} = 0 THEN other ELSE leaf END AS claimed, tree, trees,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size
  FROM c JOIN langs ON c.lang IS NOT DISTINCT FROM langs.lang
), n AS (
  SELECT tree, 0 AS level, place, leaf AS digest, size FROM l
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (size + 1) // 2 FROM n WHERE size > 1 GROUP BY tree, level, place // 2, size
), nodes AS MATERIALIZED (SELECT * FROM n
), t AS (
  SELECT 0 AS level, nodes.tree AS place, digest, (SELECT count(*) FROM langs) AS size FROM nodes WHERE size = 1
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (size + 1) // 2 FROM t WHERE size > 1 GROUP BY level, place // 2, size
), tops AS MATERIALIZED (SELECT * FROM t
), up AS (
  SELECT doc_id, tree, 0 AS level, place, size, claimed AS digest, '' AS proof FROM l
  UNION ALL
  SELECT doc_id, up.tree, up.level + 1, up.place // 2, (up.size + 1) // 2,
    sha256(CASE WHEN up.place % 2 = 1 THEN s.digest || up.digest ELSE up.digest || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
  FROM up LEFT JOIN nodes s ON s.tree = up.tree AND s.level = up.level AND s.place = xor(up.place, 1) WHERE up.size > 1
), over AS (
  SELECT doc_id, 0 AS level, tree AS place, (SELECT count(*) FROM langs) AS size, digest, proof FROM up WHERE size = 1
  UNION ALL
  SELECT doc_id, over.level + 1, over.place // 2, (over.size + 1) // 2,
    sha256(CASE WHEN over.place % 2 = 1 THEN s.digest || over.digest ELSE over.digest || coalesce(s.digest, '') END), proof || coalesce(s.digest, '')
  FROM over LEFT JOIN tops s ON s.level = over.level AND s.place = xor(over.place, 1) WHERE over.size > 1
)
SELECT l.doc_id, l.leaf, sub.digest AS subroot, root.digest AS root, sha256(over.proof) AS proof_sha256, over.digest AS folded_root, over.digest = root.digest AS verified
FROM l JOIN nodes sub ON sub.tree = l.tree AND sub.size = 1 JOIN tops root ON root.size = 1 JOIN over ON over.doc_id = l.doc_id AND over.size = 1
"""


@query("op11_merkle_manifest", OP11_SQL)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    longer = merkle.leaf_of([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, longer).otherwise(merkle.leaf_of([F.col(f) for f in merkle.FIELDS]))
    proved = merkle.prove(merkle.manifest(docs, claimed=shown))
    digest = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", digest, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
