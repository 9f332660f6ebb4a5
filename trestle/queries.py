"""The registered queries over the given tables, and their SQL."""

from trestle.plans import check_queries, graph_queries, record_queries, road_queries, search_queries, store_queries  # noqa: F401
from trestle.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
