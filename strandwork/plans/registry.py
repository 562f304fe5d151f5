"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwork.plans import export_queries, graph_queries, locus_queries, read_queries, skew_queries

MODULES = [read_queries, graph_queries, locus_queries, export_queries, skew_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for module in MODULES for name, q in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.SQL.items()}
