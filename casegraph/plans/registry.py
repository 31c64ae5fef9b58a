"""All queries of the library by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casegraph.plans import graph_queries, merge_queries, record_queries, report_queries, scalar_queries, table_queries

_MODULES = [scalar_queries, table_queries, graph_queries, report_queries, merge_queries, record_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_evidence_named"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for module in _MODULES for name, s in module.SQL.items()}
