"""Exact cosine similarity joins without a cross join.

Two unit vectors within angle ``w`` of each other differ by at most ``w`` in their angle to any
fixed pivot (triangle inequality on the sphere). Rounding the pivot angles down to multiples of
``w`` gives cells such that a similar pair lies in the same or in adjacent cells. Cells are cut
into blocks of bounded size, and only pairs that pass the cutoff leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

TOLERANCE = 1e-12
#: Rows of a block; a row travels once to each block it meets, so larger blocks move less. Products are taken in
#: strips of fewer rows, which bounds a task's memory.
BLOCK_ROWS = 8192
STRIP_ROWS = 512
#: Vectors compared with each other to learn how similar the best pairs are at least.
NEIGHBOURS = 2048


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _signs(vector: Column, period: int) -> Column:
    """The pivot with signs alternating every ``period`` places (0: all positive), unscaled."""
    if period == 0:
        return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)
    signed = F.transform(
        vector, lambda x, i: F.when(F.pmod(F.floor(i / period), F.lit(2)) == 0, x).otherwise(-x)
    )
    return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x)


def _block_pairs(h: np.ndarray, v: np.ndarray, hid: np.ndarray, vid: np.ndarray, cutoff: float, limit: int | None):
    """Places (in v, in h) and cosines of the pairs with a smaller id in v; the ``limit`` best ones, ties by ids."""
    rows, columns, cosines = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]

    def best(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if limit is None or len(i) <= limit:
            return i, j, cosine
        kept = np.lexsort((hid[j], vid[i], -cosine))[:limit]
        return i[kept], j[kept], cosine[kept]

    for start in range(0, len(v), STRIP_ROWS):
        cosine = v[start : start + STRIP_ROWS] @ h.T
        i, j = np.nonzero((cosine >= cutoff - TOLERANCE) & (vid[start : start + STRIP_ROWS, None] < hid[None, :]))
        found = best(i + start, j, np.minimum(cosine[i, j], 1.0))
        for whole, part in zip((rows, columns, cosines), found, strict=True):
            whole.append(part)
    return best(*[np.concatenate(parts) for parts in (rows, columns, cosines)])


def _reached(unit: DataFrame, angles: list[Column], cutoff: float, limit: int) -> float:
    """A cosine that the ``limit`` best pairs of the table reach, at least ``cutoff``.

    Vectors with near angles to the pivots are compared with each other only; their best pairs bound the best
    pairs of the table from below. Every vector goes into one run, so this grows with the rows.
    """
    def compare(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for start in range(0, len(page), NEIGHBOURS):
                rows = page.iloc[start : start + NEIGHBOURS]
                v, ids = np.vstack(rows["v"].to_numpy()), rows["id"].to_numpy()
                _, _, cosine = _block_pairs(v, v, ids, ids, cutoff, limit)
                yield pd.DataFrame({"similarity": cosine})

    placed = unit.select("id", "v", *[a.alias(f"_a{i}") for i, a in enumerate(angles)])
    order = [f"_a{i}" for i in range(len(angles))]
    near = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v").mapInPandas(compare, "similarity double")
    best = [r.similarity for r in near.orderBy(F.desc("similarity")).limit(limit).collect()]  # ``limit`` numbers
    # products of other blocks may differ in the last places
    return max(cutoff, best[-1] - 1e-9) if len(best) == limit else cutoff


def similar_pairs(
    vectors: DataFrame, id_col: str, vector: str, cutoff: float, weight: str | None = None, limit: int | None = None
) -> DataFrame:
    """All pairs ``id_a < id_b`` with cosine at least ``cutoff``; zero vectors match nothing.

    With ``limit`` only pairs leave a block that are among its ``limit`` most similar ones, ties by
    ids, and the cutoff is first raised to what that many pairs reach; the most similar pairs of the
    table are all among these.
    """
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("cutoff must lie in (0, 1]")
    id_type = vectors.schema[id_col].dataType.simpleString()
    norm = F.sqrt(_dot(F.col("v"), F.col("v")))
    unit = (
        vectors.select(
            F.col(id_col).alias("id"), F.col(vector).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")
        )
        .withColumn("norm", norm)
        .where("norm > 0")
        .withColumn("v", F.transform("v", lambda x: F.try_divide(x, F.col("norm"))))
        .drop("norm")
    )

    def pivot(period: int) -> Column:
        cosine = _signs(F.col("v"), period) / F.sqrt(F.size("v"))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

    if limit is not None:
        unit = cut_lineage(unit)  # read several times, and a norm is taken for every entry
        cutoff = _reached(unit, [F.floor(pivot(period) * 100) for period in (0, 1, 2, 4)], cutoff, limit)
    width = max(math.acos(cutoff), 0.01) + 1e-6

    def angle(period: int) -> Column:
        return F.floor(pivot(period) / width)

    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    home = unit.withColumns({"cx": angle(0), "cy": angle(1)})

    def around(rows: DataFrame) -> DataFrame:
        near = F.array(*[F.struct((F.col("cx") + x).alias("cx"), (F.col("cy") + y).alias("cy")) for x, y in steps])
        return rows.withColumn("near", F.explode(near)).withColumns({"cx": F.col("near.cx"), "cy": F.col("near.cy")}).drop("near")

    # Cells number at most (pi / width + 1) squared, whatever the data: safe to broadcast.
    counts = home.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    visits = around(counts).groupBy("cx", "cy").agg(F.sum("n").alias("n_visit"))
    grid = counts.join(visits, ["cx", "cy"]).select(
        "cx", "cy",
        F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("home_blocks"),
        F.ceil(F.col("n_visit") / BLOCK_ROWS).cast("int").alias("visit_blocks"),
    )

    def block(blocks: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    keys = ["cx", "cy", "hb", "vb"]
    left = home.join(F.broadcast(grid), ["cx", "cy"]).withColumn("hb", block("home_blocks")).withColumn("vb", every("visit_blocks"))
    right = around(home).join(F.broadcast(grid), ["cx", "cy"]).withColumn("vb", block("visit_blocks")).withColumn("hb", every("home_blocks"))

    # Fresh names, because both sides of the cogroup come from one table.
    visitors = right.select(*[F.col(k).alias(k) for k in keys], *[F.col(c).alias(f"visit_{c}") for c in ("id", "v", "w")])

    def match(home_rows: pd.DataFrame, visit_rows: pd.DataFrame) -> pd.DataFrame:
        if home_rows.empty or visit_rows.empty:
            return pd.DataFrame(columns=["id_a", "id_b", "similarity", "weight_a", "weight_b"])
        h, v = np.vstack(home_rows["v"].to_numpy()), np.vstack(visit_rows["visit_v"].to_numpy())
        hid, vid = home_rows["id"].to_numpy(), visit_rows["visit_id"].to_numpy()
        i, j, cosine = _block_pairs(h, v, hid, vid, cutoff, limit)
        return pd.DataFrame(
            {
                "id_a": vid[i], "id_b": hid[j], "similarity": cosine,
                "weight_a": visit_rows["visit_w"].to_numpy()[i], "weight_b": home_rows["w"].to_numpy()[j],
            }
        )

    pairs = (
        left.select(*keys, "id", "v", "w")
        .groupBy(*keys)
        .cogroup(visitors.groupBy(*keys))
        .applyInPandas(match, f"id_a {id_type}, id_b {id_type}, similarity double, weight_a long, weight_b long")
    )
    return pairs if weight else pairs.drop("weight_a", "weight_b")


def similar_profiles(vectors: DataFrame, id_col: str, vector: str, cutoff: float) -> DataFrame:
    """Similar pairs of *distinct* vectors with the number of rows behind each.

    Rows with one vector are all similar to each other; keeping them as one profile with a
    member count keeps the result whole without writing the square of a hot profile.
    """
    # Written once, because the join below reads it from several sides and computing a profile
    # means reading the texts.
    distinct = cut_lineage(
        vectors.groupBy(vector).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("members"))
    )
    return similar_pairs(distinct, "rep", vector, cutoff, weight="members").select(
        F.col("id_a").alias("profile_a"), F.col("id_b").alias("profile_b"),
        F.col("weight_a").alias("members_a"), F.col("weight_b").alias("members_b"),
        F.round("similarity", 6).alias("similarity"),
    )



