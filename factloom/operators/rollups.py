"""Summaries of runs, caches, contexts and objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invocation_summary(invocations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and latencies per module from (success, latency_us) rows."""
    ok = F.count_if("success")
    return invocations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("invocation_count"), ok.alias("successful_invocations"),
        (F.count(F.lit(1)) - ok).alias("failed_invocations"), F.sum("latency_us").alias("total_latency_us"),
        F.avg("latency_us").alias("average_latency_us"), F.min("latency_us").alias("min_latency_us"),
        F.max("latency_us").alias("max_latency_us"),
    )


def batch_verdict(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Any failure fails the batch."""
    return results.groupBy(*keys).agg(F.bool_and("success").alias("passed"), F.count_if(~F.col("success")).alias("failures"))


def counted(rows: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def objective_aggregates(rows: DataFrame, objectives: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, max and min per objective in long form."""
    long = rows.unpivot(list(keys) or [F.lit(0).alias("_all")], [F.col(o).cast("double").alias(o) for o in objectives], "objective", "v")
    return long.groupBy(*keys, "objective").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("max"), F.round(F.min("v"), 6).alias("min")
    )


def cache_stats(lookups: DataFrame, hit: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Hits, misses and hit rate of lookup events."""
    hits = F.count_if(hit)
    return lookups.groupBy(*keys).agg(
        hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"),
        F.coalesce(F.try_divide(hits, F.count(F.lit(1))), F.lit(0.0)).alias("hit_rate"),
    )


def first_lookup_misses(lookups: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mark the first lookup of every key as a miss and the rest as hits.

    The first lookups are an aggregate, joined back, instead of a window. Null keys are keys.
    """
    from factloom.operators.ranking import matched

    first = lookups.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    return matched(lookups, first, key).withColumn("hit", F.struct(*order) != F.col("_first")).drop("_first")


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return rows.groupBy(value).agg(F.min(order).alias("first_seen"))


def merged_lists(a: Column, b: Column) -> Column:
    """Two lists in one, first occurrences kept."""
    return F.array_distinct(F.concat(a, b))
