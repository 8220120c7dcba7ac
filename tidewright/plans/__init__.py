"""All queries of the library's own operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tidewright.plans import catalogs, populations, results, risks, series, signals
from tidewright.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogs", "populations", "results", "risks", "series", "signals"]
