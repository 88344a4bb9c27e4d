"""Connected components of a link table, by merging labels over edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored


def tree_edges(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect sorted members as a binary tree: no node has many, and paths are short."""
    i = np.arange(1, len(members))
    return members[(i - 1) // 2], members[i]


def local_components(linked: np.ndarray) -> np.ndarray:
    """Label per row of a symmetric boolean matrix: the first row that it is connected to."""
    label = np.arange(len(linked))
    while True:
        best = np.concatenate([
            np.where(linked[low : low + 256], label[None, :], len(label)).min(axis=1, initial=len(label))
            for low in range(0, len(label), 256)
        ])
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b): the smallest node they are connected to.

    In each round all nodes of one label take the smallest label across any of their edges, after
    short cuts over such steps. Tables are written between rounds, so a lost executor costs little,
    and large labels are split by skew joins, as both sides of the joins are stored tables.
    """
    edges = stored(
        edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        across = edges.join(left, "a").join(right, "b").where("x <> y")
        steps = across.groupBy(F.greatest("x", "y").alias("label")).agg(F.min(F.least("x", "y")).alias("lower"))
        steps = stored(steps, "steps")
        if steps.isEmpty():
            return labels.withColumnRenamed("label", "component")
        for _ in range(2):
            further = steps.select(F.col("label").alias("lower"), F.col("lower").alias("lowest"))
            steps = stored(
                steps.join(further, "lower", "left").select("label", F.coalesce("lowest", "lower").alias("lower")), "steps"
            )
        labels = stored(
            labels.join(steps, "label", "left").select("node", F.coalesce("lower", "label").alias("label")), "labels"
        )
