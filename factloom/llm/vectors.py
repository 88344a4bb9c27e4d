"""Embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import stored
from factloom.llm.components import components, tree_edges

COSINE = 0.98
#: Vectors that teach the codebooks, at most: those first in the order of a hash of their ids.
SAMPLE = 20_000
#: Vectors of one label that a cell of the grid should hold; the codebooks grow with the table.
CELL_ROWS = 50
#: Recall of the traversal on neighbours at exactly the threshold, in random directions from sampled vectors.
RECALL = 0.999
PROBES = 2000
#: Rows a side of one product.
PART = 1024


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two halves of a vector; their pairs of centres are the cells of a grid."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def order(self, unit: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each vector, nearest first.

        The sequence that the multi-sequence traversal of both sorted lists of centres yields: cells
        by the sum of the two squared distances. Of each list the first ``count`` are enough.
        """
        half = unit.shape[1] // 2
        near = [squared(unit[:, :half], self.first), squared(unit[:, half:], self.second)]
        lists = [np.argsort(d, axis=1, kind="stable")[:, :count] for d in near]
        a, b = (np.take_along_axis(d, i, axis=1) for d, i in zip(near, lists, strict=True))
        # the cell at ranks (i, j) has (i + 1) * (j + 1) - 1 cells before it, so others can't be among the first
        i, j = np.nonzero(np.outer(np.arange(1, a.shape[1] + 1), np.arange(1, b.shape[1] + 1)) <= count)
        best = np.argsort(a[:, i] + b[:, j], axis=1, kind="stable")[:, :count]
        cells = lists[0][:, i] * len(self.second) + lists[1][:, j]
        return np.take_along_axis(cells, best, axis=1)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        own = squared(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def fit_index(sample: np.ndarray, k: int, cosine: float = COSINE, recall: float = RECALL) -> MultiIndex:
    """Codebooks of k centres for each half, and how many cells reach the target recall."""
    rng = np.random.default_rng(11)
    unit = unit_rows(sample)
    half = unit.shape[1] // 2
    index = MultiIndex(_centres(unit[:, :half], k, rng), _centres(unit[:, half:], k, rng), 1)
    cells = len(index.first) * len(index.second)
    probe = unit[rng.choice(len(unit), min(PROBES, len(unit)), replace=False)]
    aside = rng.normal(size=probe.shape)
    aside = unit_rows(aside - (aside * probe).sum(axis=1, keepdims=True) * probe + 1e-300)
    neighbour = cosine * probe + np.sqrt(1 - cosine**2) * aside
    home = index.order(neighbour, 1)[:, 0]
    rank = (index.order(probe, cells) == home[:, None]).argmax(axis=1)
    return MultiIndex(index.first, index.second, int(np.quantile(rank, recall, method="higher")) + 1)


def _linked(queries: np.ndarray, items: np.ndarray, query_ids: np.ndarray, item_ids: np.ndarray, cosine: float) -> np.ndarray:
    """Verified links, each seen once: from the smaller id's query to the larger id's entry."""
    close = queries @ items.T >= cosine * np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(items, axis=1)[None, :]
    return close & (query_ids[:, None] < item_ids[None, :])


def _groups(linked: np.ndarray, query_ids: np.ndarray, item_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its group) of the linked rows."""
    rows, columns = np.nonzero(linked)
    a, b = query_ids[rows], item_ids[columns]
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (vec_id is the component_id).

    Vectors with equal labels link when their cosine in double precision is at least ``cosine``. The
    cells of a grid of two codebooks are the index; every vector is in its nearest cell, and every
    vector visits as many cells, nearest first, as the target recall takes; what it meets there is
    verified. Equal vectors are one entry, counted as often as they occur. Visitors and entries of a
    cell are multiplied in parts of bounded size.

    A vector that is null, empty, zero or has null or non-finite components, or whose label or id is
    null, links with nothing. Repeated rows of one id count as copies of each other. An empty table
    gives no rows; other columns are ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite)
    key = ["label", "size", "key1", "key2"]
    keyed = valid.select("vec_id", "vector", *_keys())
    classes = stored(
        keyed.groupBy(*key).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min_by("vector", "vec_id").alias("vector")),
        "vectors",
    )
    indexes = _fitted(classes, cosine)
    visits = _visits(classes, indexes)
    parts = visits.groupBy("label", "size", "cell").agg(
        *[F.ceil(F.sum((F.col("query") == q).cast("long")) / PART).cast("int").alias(name) for q, name in ((True, "queries"), (False, "items"))]
    )
    parts = stored(parts.where("queries > 0 AND items > 0"), "cells")
    cells = visits.join(parts, ["label", "size", "cell"])
    own = F.pmod(F.xxhash64("first"), F.when(F.col("query"), F.col("queries")).otherwise(F.col("items"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("items")).otherwise(F.col("queries")) - 1)
    dealt = cells.select("label", "size", "cell", "query", "first", "copies", "vector", own.alias("own"), F.explode(others).alias("other"))
    blocks = dealt.select(
        "label", "size", "cell", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("j"), "query", "first", "copies", "vector",
    )

    def verify(block: pa.Table) -> pa.Table:
        query = block.column("query").to_numpy()
        ids, copies = block.column("first").to_numpy(), block.column("copies").to_numpy()
        matrix = block.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        linked = _linked(matrix[query], matrix[~query], ids[query], ids[~query], cosine)
        owners, labels = _groups(linked, ids[query], ids[~query])
        trees = [tree_edges(owners[labels == k]) for k in np.unique(labels)]
        a, b = (np.concatenate([t[s] for t in trees]) if trees else np.empty(0, np.int64) for s in (0, 1))
        to_items, to_queries = linked @ copies[~query], linked.T @ copies[query]
        node = np.concatenate([ids[query], ids[~query], a])
        count = np.concatenate([to_items, to_queries, np.zeros(len(a), np.int64)])
        other = np.concatenate([np.full(len(ids), -1), b])
        edge = np.concatenate([np.zeros(len(ids), bool), np.ones(len(a), bool)])
        keep = edge | (count > 0)
        return pa.table({"node": node[keep], "n": count[keep], "other": other[keep].astype(np.int64), "edge": edge[keep]})

    found = blocks.groupBy("label", "size", "cell", "i", "j").applyInArrow(verify, "node long, n long, other long, edge boolean")
    found = stored(found, "vector-links")
    counts = found.where("NOT edge").groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.where("edge").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, classes["first"] == counts["node"], "left").drop("node").join(
        groups, F.col("first") == F.col("node"), "left"
    )
    named = stored(
        named.select(
            *key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")
        ),
        "vector-classes",
    )
    linked = keyed.select("vec_id", *key).join(named, key).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite, F.lit(False)))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _keys() -> list:
    text = F.col("vector").cast("string")
    return ["label", F.size("vector").alias("size"), F.xxhash64("vector").alias("key1"), F.xxhash64(F.lit(1), text).alias("key2")]


def _fitted(classes: DataFrame, cosine: float) -> dict[int, MultiIndex]:
    """An index for each vector length of the sample, from at most SAMPLE vectors on the driver."""
    total, labels = classes.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    rows = classes.orderBy(F.xxhash64("first"), "first").limit(SAMPLE).select("size", "vector").toPandas()
    k = int(np.clip(np.ceil(np.sqrt(total / max(1, labels) / CELL_ROWS)), 1, 128))
    return {
        int(size): fit_index(np.array(group["vector"].tolist(), np.float64), k, cosine)
        for size, group in rows.groupby("size") if size > 1
    }


def _visits(classes: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """Every class once as an entry of its cell and once as a query in each cell it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for low in range(0, part.num_rows, 2000):
                    rows = part.slice(low, 2000)
                    unit = unit_rows(rows.column("vector").flatten().to_numpy().reshape(-1, int(size)))
                    index = indexes.get(int(size))
                    cells = index.order(unit, index.visits) if index else np.zeros((len(unit), 1), np.int64)
                    which = np.concatenate([np.arange(len(unit)), np.repeat(np.arange(len(unit)), cells.shape[1])])
                    out = rows.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(out.column(c) for c in ("label", "size", "first", "copies", "vector")),
                            pa.array(np.concatenate([cells[:, 0], cells.ravel()]).astype(np.int64)),
                            pa.array(np.arange(len(which)) >= len(unit)),
                        ],
                        names=["label", "size", "first", "copies", "vector", "cell", "query"],
                    )

    schema = T.StructType(classes.select("label", "size", "first", "copies", "vector").schema.fields)
    schema = schema.add("cell", "long").add("query", "boolean")
    return classes.select("label", "size", "first", "copies", "vector").mapInArrow(run, schema)
