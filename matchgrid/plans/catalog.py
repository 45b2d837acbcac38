"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchgrid.plans import evaluation_queries, file_queries, market_queries, projection_queries, relational_queries, source_queries, text_queries  # noqa: F401
from matchgrid.plans.registry import ORACLE, QUERIES
from matchgrid.plans.views import Views

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home and away form totals of every match."""
    return relational_queries.flagship(Views(spark, sf_dir))
