"""The registered queries, and for each the SQL its result is checked against."""

from workload import corpus_queries, extract_queries, hierarchy_queries, search_queries, store_queries, text_queries
from workload.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "corpus_queries",
    "extract_queries",
    "hierarchy_queries",
    "search_queries",
    "store_queries",
    "text_queries",
]
