"""Every operator as a named query over the given tables."""

from presslake.workloads import aggregates, extraction, lookups, runs, scalars, sources  # noqa: F401
from presslake.workloads.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
