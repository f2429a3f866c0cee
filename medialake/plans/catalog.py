"""Registered queries of the media library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medialake.plans import q_categorize, q_diff, q_duplicates, q_facets, q_normalize, q_search, q_sources

MODULES = (q_sources, q_diff, q_normalize, q_search, q_facets, q_duplicates, q_categorize)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for module in MODULES for name, function in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
