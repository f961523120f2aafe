"""The query catalogue."""

from lodestack.plans import answers, building_queries, graphs, items, pages, programs, retrieval, rules, search, storing, texts  # noqa: F401  register their queries
from lodestack.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
