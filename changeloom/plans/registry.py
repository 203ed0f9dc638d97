"""Registered queries over the given tables, with the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its own name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for family in ("stats_queries", "window_queries", "diff_queries", "join_queries", "graph_queries", "text_queries", "rule_queries", "snapshot_queries", "review_queries", "kind_queries", "search_queries", "upkeep_queries", "context_queries", "scan_queries", "delta_queries", "schema_queries", "change_queries", "config_queries", "catalog_queries"):
    importlib.import_module(f"changeloom.plans.{family}")
