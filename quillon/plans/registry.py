"""Every registered query of the core operators, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import asking, evaluation, graph, nodes, retrieval, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (nodes, retrieval, asking, graph, store, evaluation):
    for name, (query, sql) in part.PLANS.items():
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages asked of all chunks by BM25, the answers packed within a budget."""
    return QUERIES["repack_budget"](spark, sf_dir)
