"""All registered queries."""

from heliograph.plans import ingest_queries, log_queries, metric_queries, trace_queries  # noqa: F401  (registers)
from heliograph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
