"""Reads over the registry of ingested entries, keyed by (context, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_entries(registry: DataFrame) -> DataFrame:
    return registry.orderBy("context", "path")


def entries_for_context(registry: DataFrame, context: str) -> DataFrame:
    return registry.where(F.col("context") == context).orderBy("path")


def context_names(registry: DataFrame) -> DataFrame:
    return registry.select("context").distinct().orderBy("context")


def contexts(registry: DataFrame) -> DataFrame:
    """Distinct contexts with their number of entries and path range."""
    return registry.groupBy("context").agg(
        F.count(F.lit(1)).alias("entries"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )
