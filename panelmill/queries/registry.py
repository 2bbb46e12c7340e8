"""All named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelmill.queries import characteristics, connect, cross_section, model, panel, prep

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (prep, panel, characteristics, cross_section, model, connect)


def core() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries of the core and their SQL."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for module in MODULES:
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
