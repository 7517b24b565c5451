"""All named queries of the operators for training data, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from briefmill.llm import queries as own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(own.ORACLE)
