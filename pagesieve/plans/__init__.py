"""Registered queries."""

from . import node_queries, record_queries, run_queries, selector_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "node_queries", "record_queries", "run_queries", "selector_queries", "text_queries"]
