"""Every registered query, by importing the modules that register them."""

from __future__ import annotations

from impactlens.plans import graph_queries, record_queries, run_queries, stream_queries, text_queries
from impactlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "record_queries", "run_queries", "stream_queries", "text_queries"]
