"""Groups of equal content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage


def duplicate_members(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once, with the number of copies.

    Members stay rows instead of lists. The counts are written once, so both sides of the join are
    plain shuffles and adaptive execution splits a key that holds a third of the corpus.
    """
    groups = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    return rows.join(groups, keys)


def shared_bodies(functions: DataFrame) -> DataFrame:
    """Same name and body in two or more modules; the first module is the canonical one."""
    return (
        functions.select("name", "body_hash", "module")
        .distinct()
        .groupBy("name", "body_hash")
        .agg(F.count(F.lit(1)).alias("n_modules"), F.min("module").alias("canonical"))
        .where("n_modules >= 2")
    )


def key_set_groups(records: DataFrame, keys: str, record: str, threshold: int = 2) -> DataFrame:
    """Records grouped by their sorted set of keys; an empty set is labelled ``raw``."""
    return (
        records.groupBy(F.array_join(F.sort_array(keys), "_").alias("schema_key"))
        .agg(F.count(F.lit(1)).alias("weight"), F.min(record).alias("first_record"))
        .where(F.col("weight") >= threshold)
        .select(
            F.when(F.col("schema_key") == "", "raw").otherwise(F.lower("schema_key")).alias("label"),
            "weight",
            "first_record",
        )
    )
