"""All registered queries of the graph engine."""
from . import analytics_queries, graph_queries, resolve_queries, source_queries, system_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
