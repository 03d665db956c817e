"""Queries over the given tables, one per operator, each with its SQL counterpart where SQL can say it."""

from workload import cleaning, clustering, detection, invariants, ranking, relational, sources, temporal  # noqa: F401
from workload.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
