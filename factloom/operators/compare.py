"""Comparison of result sets, snapshots of settings, and three-way merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MIN_DENOMINATOR = 1e-30
MIN_BASELINE = 1e-9
MAX_DRIFT = 0.3
SEQUENCE_START, SEQUENCE_END = "⊢", "⊣"


def differential(legacy: DataFrame, candidate: DataFrame) -> DataFrame:
    """Match two runs (label, succeeded, result_hash, error) by label."""
    old = legacy.select("label", *[F.col(c).alias(f"old_{c}") for c in ("succeeded", "result_hash", "error")])
    new = candidate.select("label", *[F.col(c).alias(f"new_{c}") for c in ("succeeded", "result_hash", "error")])
    old_ok, new_ok = F.coalesce("old_succeeded", F.lit(False)), F.coalesce("new_succeeded", F.lit(False))
    both_failed = ~old_ok & ~new_ok
    match = (
        F.when(both_failed, F.col("old_error").eqNullSafe(F.col("new_error")))
        .when(old_ok & new_ok, F.col("old_result_hash").eqNullSafe(F.col("new_result_hash")))
        .otherwise(F.lit(False))
    )
    detail = F.when(
        ~match,
        F.when(both_failed, "different errors")
        .when(old_ok & new_ok, "hash mismatch")
        .when(old_ok, "candidate failed")
        .otherwise("legacy failed"),
    )
    return old.join(new, "label", "full").select("label", match.alias("match"), detail.alias("detail"))


def differential_report(matches: DataFrame) -> DataFrame:
    failed = F.count_if(~F.col("match"))
    return matches.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("match").alias("passed"), failed.alias("failed"),
        (failed == 0).alias("accepted"),
    )


def max_relative_error(reference: Column, produced: Column) -> Column:
    """Largest relative error of two number arrays, compared up to the shorter one; null if one is empty."""
    n = F.least(F.size(reference), F.size(produced))
    pairs = F.zip_with(
        F.slice(reference, F.lit(1), n),
        F.slice(produced, F.lit(1), n),
        lambda r, g: F.abs(g - r) / F.when(F.abs(r) > MIN_DENOMINATOR, F.abs(r)).otherwise(F.lit(1.0)),
    )
    return F.when(n > 0, F.array_max(pairs))


def parameter_drift(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Relative change per parameter; a missing value counts as 0, a tiny baseline divides by 1."""
    now = current.select(*keys, "parameter", F.col("value").alias("current"))
    was = baseline.select(*keys, "parameter", F.col("value").alias("baseline"))
    filled = now.join(was, [*keys, "parameter"], "full").fillna(0.0, ["current", "baseline"])
    scale = F.when(F.abs("baseline") > MIN_BASELINE, F.abs("baseline")).otherwise(F.lit(1.0))
    return filled.withColumn("drift", F.abs(F.col("current") - F.col("baseline")) / scale)


def drift_report(drift: DataFrame, limit: float = MAX_DRIFT, keys: Sequence[str] = ()) -> DataFrame:
    return drift.groupBy(*keys).agg(
        F.count_if(F.col("drift") > limit).alias("drifted_count"),
        F.round(F.avg("drift"), 6).alias("average_drift"),
        (F.count_if(F.col("drift") > limit) > 0).alias("drift_exceeded"),
    )


def three_way_merge(base: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Decision, kept value and conflict for every keyed entity of three versions.

    A concurrent edit keeps the right value and is reported; a tool that can merge inside an
    entity may take those rows further.
    """
    keys = list(keys)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col(value).alias(name), F.lit(True).alias(f"in_{name}"))

    joined = side(base, "b").join(side(left, "l"), keys, "full").join(side(right, "r"), keys, "full")
    has_b, has_l, has_r = (F.col(f"in_{s}").isNotNull() for s in "blr")
    l_same, r_same, lr_same = (F.col(a).eqNullSafe(F.col(b)) for a, b in (("l", "b"), ("r", "b"), ("l", "r")))
    all3 = has_b & has_l & has_r
    decision = (
        F.when(all3 & l_same & r_same, "unchanged")
        .when(all3 & r_same, "left")
        .when(all3 & l_same, "right")
        .when(all3 & lr_same, "same_edit")
        .when(all3, "concurrent_edit")
        .when(has_b & has_l & ~has_r, F.when(l_same, "deleted").otherwise("modify_delete"))
        .when(has_b & has_r & ~has_l, F.when(r_same, "deleted").otherwise("delete_modify"))
        .when(~has_b & has_l & has_r, F.when(lr_same, "same_add").otherwise("add_add"))
        .when(~has_b & has_l, "left_add")
        .when(~has_b & has_r, "right_add")
        .otherwise("deleted")
    )
    merged = joined.withColumn("decision", decision)
    kept = F.when(
        F.col("decision").isin("left", "modify_delete", "same_edit", "same_add", "left_add", "unchanged"), F.col("l")
    ).when(F.col("decision") != "deleted", F.col("r"))
    return merged.select(
        *keys, "decision", kept.alias("kept"),
        F.col("decision").isin("concurrent_edit", "modify_delete", "delete_modify", "add_add").alias("conflict"),
    )


def successor_triples(items: DataFrame, parent: str, order: str, value: str) -> DataFrame:
    """Distinct (parent, prev, next) of ordered children with start and end sentinels.

    A parent's children are the entries of one record, so the window partition is a record.
    """
    w = Window.partitionBy(parent).orderBy(order)
    linked = items.select(
        F.col(parent).alias("parent"),
        F.coalesce(F.lag(value).over(w), F.lit(SEQUENCE_START)).alias("prev"),
        F.col(value).alias("next"),
        F.lead(value).over(w).isNull().alias("last"),
    )
    steps = F.array_compact(
        F.array(
            F.struct("prev", "next"),
            F.when(F.col("last"), F.struct(F.col("next").alias("prev"), F.lit(SEQUENCE_END).alias("next"))),
        )
    )
    return linked.select("parent", F.inline(steps)).distinct()


def successor_conflicts(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """New triples of the right side whose (parent, prev) got another successor on the left."""
    new_left = left.subtract(base).select("parent", "prev", F.col("next").alias("left_next"))
    new_right = right.subtract(base)
    return (
        new_right.join(new_left, ["parent", "prev"])
        .where(F.col("next") != F.col("left_next"))
        .select("parent", "prev", "next")
        .distinct()
    )


