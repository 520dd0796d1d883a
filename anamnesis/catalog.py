"""All queries of the memory engine, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anamnesis.plans import files_and_streams, ingestion, models_and_facade, relational, retrieval, upkeep  # noqa: F401
from anamnesis.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents for a few benchmark queries."""
    return retrieval.bm25_arm(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
