"""Query on conversations in reply order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import quotes
from .registry import query
from .store import table

OP9_SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
), l AS (
  SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM m
), v AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \\t]*>)+', 0), '[^>]', '', 'g')) AS level, regexp_replace(line, '^(?:[ \\t]*>)+[ \\t]?', '') AS body FROM l
), p AS (SELECT *, CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END AS opens FROM v WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY i) AS pos FROM p
), q AS (
  SELECT conv_id, turn, pos, level, list(body ORDER BY i) AS lines FROM r GROUP BY ALL
), clean AS (
  SELECT conv_id, turn, trim(string_agg(body, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM r WHERE level = 0 GROUP BY ALL
), u AS (
  SELECT conv_id, turn, pos, level, unnest(list_append(lines, array_to_string(lines, ' '))) AS raw FROM q
  UNION ALL SELECT conv_id, turn, -1, 0, clean FROM clean
), n AS (
  SELECT DISTINCT conv_id, turn, pos, level, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS unit FROM u
), found AS (
  SELECT a.conv_id, a.turn, a.pos, a.level, length(a.unit) AS size, max(o.turn) AS found FROM n a JOIN n o ON a.conv_id = o.conv_id AND a.unit = o.unit AND o.level = 0 AND o.turn < a.turn
  WHERE a.level > 0 AND a.unit <> '' GROUP BY a.conv_id, a.turn, a.pos, a.level, a.unit
), passage AS (
  SELECT conv_id, turn, pos, level, arg_max(found, size * 1000000 + found) AS found FROM found GROUP BY ALL
), reply AS (
  SELECT conv_id, turn, count(*) AS n_linked, arg_max(found, found - level * 1000000) AS reply_to FROM passage GROUP BY ALL
), counts AS (SELECT conv_id, turn, count(*) AS n_quotes FROM q WHERE level > 0 GROUP BY ALL
), up AS (
  SELECT conv_id, turn, reply_to AS root FROM reply UNION ALL SELECT up.conv_id, up.turn, r.reply_to FROM up JOIN reply r ON r.conv_id = up.conv_id AND r.turn = up.root
), chain AS (SELECT conv_id, turn, min(root) AS thread FROM up GROUP BY ALL
), threads AS (SELECT m.conv_id, m.turn, coalesce(thread, m.turn) AS thread FROM (SELECT DISTINCT conv_id, turn FROM m) m LEFT JOIN chain USING (conv_id, turn)
), places AS (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS place FROM threads
)
SELECT m.conv_id, m.turn, m.role, sha256(coalesce(c.clean, '')) AS clean_sha256, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to,
  CAST(thread AS BIGINT) AS thread, place, sha256('<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || coalesce(c.clean, '') || chr(10) || '<|end|>' || chr(10)) AS message_sha256
FROM m LEFT JOIN clean c USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn) LEFT JOIN reply USING (conv_id, turn) LEFT JOIN places USING (conv_id, turn)
"""


@query("op9_quotation_linking", OP9_SQL)
def quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations in reply order: ordered by (conv_id, thread, place) the messages read without quotes."""
    linked = quotes.chat_lines(quotes.link(table(spark, folder, "conversations")))
    hashes = F.sha2("clean", 256).alias("clean_sha256"), F.sha2("message", 256).alias("message_sha256")
    return linked.select("conv_id", "turn", "role", "n_quotes", "n_linked", "reply_to", "thread", "place", *hashes)
