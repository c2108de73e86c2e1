"""All registered queries, one per inventory entry."""

from . import aggregates, calendar, cleaning, files, forecasts, joins, ranks, reports, windows  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
