"""Registered queries over the driver's tables, and their DuckDB SQL twins.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a lazy
DataFrame built from the library operators; the entry of ``ORACLE_SQL`` with
the same key is an independent plain-SQL formulation (often the brute-force
one) that DuckDB runs over the same parquet files. Column names match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_activity, queries_cashback, queries_loads, queries_sources, queries_subscription, queries_tables  # noqa: F401,E501
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rolling_active_7"](spark, sf_dir)
