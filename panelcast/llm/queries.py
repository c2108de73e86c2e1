"""All registered queries of this subpackage."""

from . import dedup_queries, manifest_queries, phrase_queries, quality_queries, quote_queries, rollup_queries, score_queries, search_queries, secret_queries, snapshot_queries, token_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
