"""Sinks: graphs and reports as JSON, nested manifests, registry versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, target: str) -> None:
    """Nodes and edges as JSON lines in two folders; nothing passes through the driver."""
    nodes.write.mode("overwrite").json(f"{target}/nodes")
    edges.write.mode("overwrite").json(f"{target}/edges")


def nested_manifest(rows: DataFrame, key: str, head: Sequence[str], items: Sequence[str], order: str, name: str = "functions") -> DataFrame:
    """One row per file with its ordered list of items (a file holds a bounded number of them)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*items).alias("item"))))
    return rows.groupBy(key, *head).agg(F.transform(listed, lambda x: x["item"]).alias(name))


def write_manifest(manifest: DataFrame, target: str) -> None:
    manifest.write.mode("overwrite").json(target)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table version under ``root`` and return its path; earlier versions stay readable."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path
