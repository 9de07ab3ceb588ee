"""The registered queries of the library's own operators."""

from . import classify_queries, grid_queries, perturb_queries, signal_queries, stream_queries, text_queries, validate_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "classify_queries", "grid_queries", "perturb_queries", "signal_queries", "stream_queries", "text_queries", "validate_queries"]
