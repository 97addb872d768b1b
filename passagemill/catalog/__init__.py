"""All registered queries."""

from passagemill.catalog import ann_queries, graph_queries, lexical_queries, metric_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from passagemill.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
