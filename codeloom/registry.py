"""All queries of the library's core, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom import cascade_queries, detail_queries, graph_queries, hierarchy_queries, ops_queries, pass_queries, pattern_queries, rank_queries, stream_queries, text_queries, traverse_queries

_MODULES = (hierarchy_queries, graph_queries, traverse_queries, pattern_queries, text_queries, rank_queries, pass_queries, cascade_queries, ops_queries, stream_queries, detail_queries)


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def core_oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
