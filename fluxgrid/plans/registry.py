"""Named queries with their oracle text. Families register themselves when imported at the end of this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Adds a query; a name can be used once."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


from fluxgrid.plans import grid_queries, relation_queries, session_queries  # noqa: E402, F401

