"""Query modules; each has QUERIES (name to callable) and ORACLES (name to SQL)."""

from importlib import import_module

NAMES = ("general", "catalog_queries", "search_queries", "analytics_queries", "dialogue_queries", "store_queries", "report_queries", "stream_queries", "more_queries")


def modules() -> list:
    return [import_module(f"tidemark.plans.{name}") for name in NAMES]
