"""All named queries of the engine."""

from sessionloom.plans import corpus, directives, evidence, logs, more, queries, searching, worklog  # noqa: F401  they register their queries
from sessionloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
