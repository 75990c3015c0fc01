"""Collects the queries of all catalogues, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import check_queries, cleaning_queries, graph_queries, method_queries, quality_queries, relation_queries, report_queries, stats_queries, text_queries, workflow_queries

FLAGSHIP = "gr14_most_influential"
CATALOGUES = (graph_queries, stats_queries, relation_queries, text_queries, workflow_queries, check_queries, report_queries, method_queries, quality_queries, cleaning_queries)


def _all() -> dict:
    return {k: v for c in CATALOGUES for k, v in c.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
