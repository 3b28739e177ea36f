"""Registered queries and their DuckDB twins."""

from . import evaluation_queries, kb_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
