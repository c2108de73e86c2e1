"""Query on the collocations of the training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations as c
from .registry import query
from .store import table

OP13_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d
), f1 AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS phrase FROM p) GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
), f2 AS MATERIALIZED (
  SELECT lang, x, y, count(*) AS f FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM p WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= {c.MIN_COUNT}
), f3 AS MATERIALIZED (
  SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM p WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= {c.MIN_COUNT}
), long AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.phrase = f2.x JOIN f1 r ON r.lang = f2.lang AND r.phrase = f2.y LEFT JOIN long ON long.lang = f2.lang AND long.x = f2.x AND long.y = f2.y
  WHERE long.f IS NULL OR 100 * long.f < {c.COVERED_PERCENT} * f2.f
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, l.f, r.f FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.phrase = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, l.f, r.f FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.phrase = f3.z
), scored AS (SELECT *, CAST(({c.SCALE}::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN n USING (lang) WHERE rank <= {c.TOP}
"""


@query("op13_phrase_collocations", OP13_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return c.collocations(table(spark, folder, "documents"))
