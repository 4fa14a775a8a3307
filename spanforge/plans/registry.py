"""All queries over the fixture views, by name, with their SQL."""

from __future__ import annotations

from . import aggregate_queries, interval_queries, join_queries, mining_queries, rank_queries, scan_queries, statistic_queries  # noqa: F401
from .core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
