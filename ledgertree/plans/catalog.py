"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgertree.plans import (  # noqa: F401
    attribution_queries,
    folder_queries,
    ingest_queries,
    job_queries,
    log_queries,
    search_queries,
    tree_queries,
)
from ledgertree.plans.registry import CHECKS, QUERIES, check_sql, runnable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: runnable(build) for key, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: check_sql(key) for key in CHECKS}
