"""Registry of the library's queries and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import queries_functions, queries_more, queries_order, queries_pages, queries_records

_PARTS = (queries_functions, queries_records, queries_pages, queries_order, queries_more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence spans by source and kind."""
    return queries_records.m_span_kind_counts(spark, sf_dir)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
