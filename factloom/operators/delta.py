"""Snapshots of a corpus: what is new, changed, removed, and what must be recomputed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import transitive_dependents
from factloom.session import cut_lineage


def snapshot_delta(previous: DataFrame, current: DataFrame, key: str = "path", value: str = "fingerprint") -> DataFrame:
    """One row per key of either snapshot with its status."""
    old = previous.select(key, F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    new = current.select(key, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    status = (
        F.when(F.col("in_old").isNull(), "new")
        .when(F.col("in_new").isNull(), "removed")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, key, "full").select(key, status.alias("status"), "old_value", "new_value")


def boundary_violations(delta: DataFrame, allowed: DataFrame, key: str = "path") -> DataFrame:
    """Changes outside an allow-list, named as a boundary report names them."""
    named = F.create_map(
        F.lit("removed"), F.lit("removed"), F.lit("changed"), F.lit("modified"), F.lit("new"), F.lit("created")
    )
    return (
        delta.where("status <> 'unchanged'")
        .join(allowed.select(key), key, "left_anti")
        .select(key, named[F.col("status")].alias("violation"))
    )


def upsert(registry: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """New registry contents: the latest version of every key, the batch winning a tie.

    ``max_by`` combines on the map side, so no key's history is ever gathered in one place.
    """
    both = registry.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    payload = [c for c in registry.columns if c not in keys]
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), F.struct(version, "_batch")).alias("latest"))
        .select(*keys, "latest.*")
    )


def stale_keys(cached: DataFrame, current: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Keys to recompute: no cached value with this fingerprint, or downstream of such a key.

    ``dependencies`` holds (node, requires) rows: ``node`` uses the result of ``requires``.
    """
    direct = current.join(cached.select("key", "fingerprint"), ["key", "fingerprint"], "left_anti").select("key")
    if dependencies is None:
        return direct
    direct = cut_lineage(direct)
    downstream = transitive_dependents(dependencies, direct.select(F.col("key").alias("node")))
    return direct.unionByName(downstream.select(F.col("node").alias("key"))).distinct()


def incremental(
    cached: DataFrame,
    current: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    dependencies: DataFrame | None = None,
) -> DataFrame:
    """Results for the current rows: reused where still valid, computed for the stale keys only."""
    stale = cut_lineage(stale_keys(cached, current, dependencies))  # read twice
    fresh = compute(current.join(stale, "key", "left_semi"))
    kept = (
        cached.join(current.select("key"), "key", "left_semi")
        .join(stale, "key", "left_anti")
        .withColumn("reused", F.lit(True))
    )
    return kept.unionByName(fresh.withColumn("reused", F.lit(False)))
