"""Integrity and validation checks that return violations as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required fields of fact rows by kind.
REQUIRED_FIELDS = {
    "state_variable": ("id", "kind", "domain", "symbol"),
    "boundary": ("id", "kind", "domain", "symbol", "expression"),
    "equation": ("id", "kind", "domain", "symbol", "lhs", "rhs"),
}
# How a consumer binds to a provider, by language pair; anything else uses cffi.
BINDING_MECHANISM = {
    ("cpp", "python"): "pybind11",
    ("c", "python"): "ctypes",
    ("rust", "python"): "pyo3",
    ("fortran", "python"): "ctypes",
}
DEFAULT_MECHANISM = "cffi"


def violations(rows: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """One row per failed check; a check is the condition that must not hold."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))
    return rows.select(*keys, F.explode(failed).alias("violation"))


def fact_violations(facts: DataFrame, bucket: str, kind: str) -> DataFrame:
    """Missing required fields and wrong kinds of one bucket of fact rows."""
    checks: dict[str, Column] = {
        f"missing required field '{name}'": F.col(name).isNull() if name in facts.columns else F.lit(True)
        for name in REQUIRED_FIELDS[kind]
    }
    checks[f"wrong kind, expected '{kind}'"] = F.col("kind").isNotNull() & (F.col("kind") != kind)
    found = violations(facts.withColumn("bucket", F.lit(bucket)), ["bucket", "pos"], checks)
    return found


def field_violations(fields: DataFrame, rules: DataFrame, required: DataFrame) -> DataFrame:
    """Checks of exploded (block, key, value_type, value, size) fields against a rule table.

    ``rules`` has (key, value_type, allowed ARRAY<STRING>) and ``required`` has (key); both are
    the schema of a block, so they hold one row per known key.
    """
    judged = fields.join(rules.withColumnRenamed("value_type", "want_type"), "key", "left")
    known = F.col("want_type").isNotNull()
    problem = F.array_compact(
        F.array(
            F.when(~known, "unknown key"),
            F.when(known & (F.col("value_type") != F.col("want_type")), "wrong type"),
            F.when(
                known & (F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("value")), "value not allowed"
            ),
            F.when(known & (F.col("value_type") == "list") & (F.col("size") == 0), "empty list"),
        )
    )
    bad_fields = judged.select("block", "key", F.explode(problem).alias("violation"))
    needed = required.agg(F.array_sort(F.collect_set("key"))).scalar()  # the schema's required keys
    wanted = fields.withColumn("_needed", needed)
    present = wanted.groupBy("block").agg(
        F.first("_needed").alias("_needed"), F.collect_set(F.when(F.array_contains("_needed", F.col("key")), F.col("key"))).alias("_present")
    )
    absent = present.select(
        "block", F.explode(F.array_except("_needed", "_present")).alias("key"), F.lit("missing required key").alias("violation")
    )
    return bad_fields.unionByName(absent)


def duplicate_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names used more than once with the first use."""
    return (
        rows.groupBy(name)
        .agg(F.count(F.lit(1)).alias("uses"), F.min(order).alias("first_use"))
        .where("uses > 1")
    )


def shared_ownership(rows: DataFrame, symbol: str, owner: str) -> DataFrame:
    """Symbols claimed by more than one owner."""
    return (
        rows.select(symbol, owner)
        .distinct()
        .groupBy(symbol)
        .agg(F.count(F.lit(1)).alias("owners"), F.min(owner).alias("first_owner"))
        .where("owners > 1")
    )


def unknown_references(rows: DataFrame, reference: str, known: DataFrame, known_key: str) -> DataFrame:
    return rows.join(known.select(F.col(known_key).alias(reference)), reference, "left_anti")


def binding_boundaries(targets: DataFrame) -> DataFrame:
    """Every binding of a project with every core of the same project, and the mechanism.

    ``targets`` has (project, name, language, role). The product is the result here, so it is
    built by an equality join on the project and never across projects.
    """
    pair = F.create_map(*[F.lit(x) for (p, c), m in BINDING_MECHANISM.items() for x in (f"{p}>{c}", m)])
    core = targets.where("role = 'core'").select(
        "project", F.col("name").alias("provider"), F.col("language").alias("provider_language")
    )
    binding = targets.where("role = 'binding'").select(
        "project", F.col("name").alias("consumer"), F.col("language").alias("consumer_language")
    )
    mechanism = F.coalesce(
        F.try_element_at(pair, F.concat_ws(">", "provider_language", "consumer_language")), F.lit(DEFAULT_MECHANISM)
    )
    return binding.join(core, "project").withColumn("mechanism", mechanism)


def tolerance_report(cases: DataFrame, tolerance: float, keys: Sequence[str] = ()) -> DataFrame:
    """Passed and failed cases; a case fails on its flag or when its error leaves the tolerance.

    ``cases`` has (passed BOOLEAN, error DOUBLE); a null error leaves the flag alone.
    """
    ok = F.coalesce("passed", F.lit(True)) & F.coalesce(F.abs("error") <= tolerance, F.lit(True))
    return cases.groupBy(*keys).agg(
        F.count_if(ok).alias("passed_cases"), F.count_if(~ok).alias("failed_cases"),
        (F.count_if(~ok) == 0).alias("overall"),
    )
