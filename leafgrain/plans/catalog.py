"""Imports every query module so that the registry is complete."""

from leafgrain.plans import chunk_queries, element_queries, function_queries, knowledge_queries, run_queries, search_queries, stream_queries  # noqa: F401
from leafgrain.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
