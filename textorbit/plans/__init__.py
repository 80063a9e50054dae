"""Named queries over the given tables, by family."""

from textorbit.plans import calls, catalog, files, fleet, latency, payloads, streams, text  # noqa: F401
from textorbit.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
