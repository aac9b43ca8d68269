"""Registered queries over the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabaudit.catalog import auditing, cleaning, corruption, repairing, slicing
from tabaudit.catalog.base import Query

_PARTS = (cleaning, corruption, slicing, auditing, repairing)


def all_queries() -> dict[str, Query]:
    return {k: v for p in _PARTS for k, v in p.cat.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.cat.sql.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return all_queries()["q_numeric_audit_add"](spark, folder)
