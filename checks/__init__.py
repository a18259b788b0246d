"""The engine's operators as queries over the driver's tables, each with its SQL."""

from checks import file_queries, idiom_queries, model_queries, read_queries, screen_queries, source_queries
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
