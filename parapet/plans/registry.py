"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parapet.plans import q_admission, q_chunks, q_gateway, q_intake, q_metrics, q_output, q_retrieval, q_store, q_streaming
from parapet.session import configure

MODULES = (q_store, q_intake, q_chunks, q_gateway, q_output, q_admission, q_retrieval, q_metrics, q_streaming)


def _configured(query: Callable[[SparkSession, str], DataFrame]):
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(configure(spark), folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(q) for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
