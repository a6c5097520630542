"""All queries of the library, by operator."""

from skribo.plans import aggregates, articles, audits, external, files, joins, matching, pages, records, relations, runs, sets, sources, texts, windows  # noqa: F401
from skribo.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
