"""All registered queries of this package."""

from heliograph.llm import archive_queries, model_queries, native_queries, near_queries, text_queries, token_queries  # noqa: F401  (registers)
from heliograph.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
