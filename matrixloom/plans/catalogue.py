"""All queries of the core and their SQL; the modules register theirs in ``core.QUERIES`` and ``core.SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matrixloom.plans import atlas, benchmarks, core, numbered

__all__ = ["atlas", "benchmarks", "flagship", "oracle_sql", "queries"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Five scores of every program in every sample."""
    return core.program_scores(spark, folder)


def queries() -> dict:
    return numbered.queries() | core.QUERIES


def oracle_sql() -> dict[str, str]:
    return numbered.oracle_sql() | core.SQL
