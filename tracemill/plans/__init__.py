"""The library's registered queries."""

from tracemill.plans import adapting, curation, filing, filtering, grading, picking, profiling, searching, solving, texts
from tracemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "adapting", "curation", "filing", "filtering", "grading", "picking", "profiling", "searching", "solving", "texts"]
