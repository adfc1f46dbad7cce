"""Runnable queries: every operator applied to the tables at hand, with SQL to check it against."""

from lodgeframe.catalog import (  # noqa: F401  (registers the queries)
    aggregates,
    columns,
    compare,
    ddl,
    joins,
    profile,
    revenue,
    sources,
    variance,
)
from lodgeframe.catalog.registry import oracles, queries

__all__ = ["oracles", "queries"]
