"""Multi-objective ranking: dominance, front layers, crowding, volume, selection.

Objectives are columns. ``maximise`` flips the direction; inside, everything is minimised.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.operators import ordered
from factloom.session import cut_lineage

#: Points that are compared pair by pair in one task.
LEAF_ROWS = 4096
#: Distinct vectors of a cell whose layers are one task's work, for two objectives and for more.
CELL_ROWS = 200_000
CELL_ROWS_MANY = 8192
#: Points of one slab of a volume.
SLAB_ROWS = 20_000


def _minimised(df: DataFrame, objectives: Sequence[str], maximise: bool, prefix: str = "_o") -> tuple[DataFrame, list[str]]:
    names = [f"{prefix}{i}" for i in range(len(objectives))]
    sign = -1.0 if maximise else 1.0
    return df.withColumns({n: F.col(o).cast("double") * sign for n, o in zip(names, objectives, strict=True)}), names


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls being equal to nulls; no keys match every row with the one row of ``right``."""
    key = F.struct(*keys) if keys else F.lit(0)
    return left.withColumn("_match", key).join(right.withColumn("_match", key).drop(*keys), "_match", how).drop("_match")


def _comparable(names: Sequence[str]) -> Column:
    """Whether a vector takes part in dominance: one with a null or undefined objective does not."""
    return ~F.exists(F.array(*names), lambda x: F.isnull(x) | F.isnan(x))


def _skyline_mask(points: np.ndarray) -> np.ndarray:
    """Non-dominated rows of minimised points; of equal points one is kept.

    A dominating point has the smaller coordinate sum, so the head of the sorted rest is always
    on the front; it then removes everything it dominates in one vector operation.
    """
    rest = np.lexsort([*points.T[::-1], points.sum(axis=1)])
    mask = np.zeros(len(points), dtype=bool)
    while len(rest):
        head = rest[0]
        mask[head] = True
        rest = rest[np.any(points[rest] < points[head], axis=1)]
    return mask


def _matrix(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    if not table.num_rows:  # the empty side of a group may come without columns
        return np.empty((0, len(names)))
    return np.column_stack([table[n].to_numpy() for n in names])


def _two_objective_front(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Distinct non-dominated (keys, x, y): smaller y than at every smaller x."""
    best = cut_lineage(df.groupBy(*keys, x).agg(F.min(y).alias(y)))
    prefix = ordered.running(best, keys, [x], F.col(y), F.min, F.least, "_prefix", inclusive=False)
    return prefix.where(F.col("_prefix").isNull() | (F.col(y) < F.col("_prefix"))).drop("_prefix")


def _local_skylines(points: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The skyline of every group of ``by``, each of which is one task's work."""

    def local(table: pa.Table) -> pa.Table:
        return table.filter(pa.array(_skyline_mask(_matrix(table, names))))

    return points.groupBy(*by).applyInArrow(local, points.schema)


def _halves(rows: DataFrame, leaves: int, depth: int) -> DataFrame:
    """Every row once for each level of a binary tree over its ``_leaf``: the pair of nodes, and on which side it is."""
    level, pair, right = f"_level{depth}", f"_pair{depth}", "_right"
    levels = F.explode(F.sequence(F.lit(0), F.lit((leaves - 1).bit_length() - 1)))
    node = F.expr(f"shiftright(_leaf, {level})")
    return rows.withColumn(level, levels).withColumns({pair: F.shiftright(node, 1), right: node % 2 == 1}).drop("_leaf")


def _met_by_a_source(rows: DataFrame, by: list[str], rest: list[str], ident: list[str], depth: int) -> DataFrame:
    """``ident`` of the queries that a source of their group of ``by`` is nowhere above in ``rest``.

    With two coordinates left that is a running minimum. With more, rows are numbered by the first,
    sources before queries where they tie; leaves of these numbers are compared in tasks, and at each
    level of a tree over the leaves the sources of a left node meet the queries of the right one in
    the other coordinates.
    """
    if len(rest) == 2:
        x, y = rest
        lowest = F.when(~F.col("_query"), F.col(y))
        known = ordered.running(cut_lineage(rows), by, [x, "_query"], lowest, F.min, F.least, "_lowest")
        return known.where(F.col("_query") & (F.col("_lowest") <= F.col(y))).select(*ident)
    numbered = ordered.row_number(cut_lineage(rows), by, [rest[0], "_query"], "_rn")
    numbered = cut_lineage(numbered.withColumn("_leaf", F.floor((F.col("_rn") - 1) / LEAF_ROWS)).drop("_rn"))

    def local(table: pa.Table) -> pa.Table:
        query, points = table["_query"].to_numpy(), _matrix(table, rest)
        sources, met = points[~query], np.zeros(len(points), bool)
        for i in np.flatnonzero(query):
            met[i] = bool((sources <= points[i]).all(axis=1).any())
        return table.filter(pa.array(met)).select(ident)

    found = numbered.groupBy(*by, "_leaf").applyInArrow(local, numbered.select(*ident).schema)
    leaves = (numbered.agg(F.max("_leaf")).first()[0] or 0) + 1
    if leaves == 1:
        return found
    split = _halves(numbered, leaves, depth).where(F.col("_right") == F.col("_query")).drop("_right")
    return found.unionByName(_met_by_a_source(split, [*by, f"_level{depth}", f"_pair{depth}"], rest[1:], ident, depth + 1))


def _many_objective_front(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Distinct non-dominated vectors of each group, in several rounds; no step sees a whole front.

    First parts of at most about LEAF_ROWS rows lose what is dominated inside them. What is left is
    numbered in the order of whole vectors, in which a dominating vector comes first; leaves of that
    order are compared in tasks, and a tree over the leaves finds, level by level, what a vector of
    a left node dominates in the right one. The work grows as n log n for three objectives and by a
    further logarithm for each one more.
    """
    group, ident = ["_g"], ["_g", *names]
    points = df.select(F.struct(*keys).alias("_g") if keys else F.lit(0).alias("_g"), *names).distinct()
    sizes = cut_lineage(points.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    parts = F.ceil(F.col("_n") / LEAF_ROWS)
    salted = points.join(sizes, "_g").withColumn("_part", F.pmod(F.xxhash64(*names), parts)).drop("_n")
    left = _local_skylines(salted, ["_g", "_part"], names).drop("_part")
    if (sizes.agg(F.max("_n")).first()[0] or 0) > LEAF_ROWS:  # else every part was a whole group
        numbered = ordered.row_number(cut_lineage(left), group, names, "_rn")
        left = numbered.withColumn("_leaf", F.floor((F.col("_rn") - 1) / LEAF_ROWS)).drop("_rn")
        left = cut_lineage(_local_skylines(left, ["_g", "_leaf"], names))
        leaves = (left.agg(F.max("_leaf")).first()[0] or 0) + 1
        if leaves > 1:
            halves = _halves(left, leaves, 0).withColumnRenamed("_right", "_query")
            dominated_ones = _met_by_a_source(halves, ["_g", "_level0", "_pair0"], names[1:], ident, 1)
            left = left.join(dominated_ones.distinct(), ident, "left_anti")
        left = left.drop("_leaf")
    return left.select(*[F.col("_g")[k].alias(k) for k in keys], *names)


def front(df: DataFrame, objectives: Sequence[str], keys: Sequence[str] = (), maximise: bool = False) -> DataFrame:
    """Rows of ``df`` that no other row of their group dominates."""
    return dominated(df, objectives, keys, maximise).where("NOT dominated").drop("dominated")


def dominated(df: DataFrame, objectives: Sequence[str], keys: Sequence[str] = (), maximise: bool = False) -> DataFrame:
    """Add ``dominated``. Equal vectors do not dominate each other.

    A vector is dominated exactly when it is not on the front of its group, so rows meet the
    front through an equality join instead of a test of every pair. A vector with a null or
    undefined objective neither dominates nor is dominated.
    """
    rows, names = _minimised(df, objectives, maximise, "_d")
    keys = list(keys)
    known = rows.where(_comparable(names)).select(*keys, *names)
    if len(names) == 2:
        best = _two_objective_front(known, keys, *names)
    else:
        best = _many_objective_front(known, keys, names)
    marks = best.withColumn("_front", F.lit(True))
    flag = F.col("_front").isNull() & _comparable(names)
    return matched(rows, marks, [*keys, *names], "left").withColumn("dominated", flag).drop("_front", *names)


def _staircase_layers(points: np.ndarray, sources: np.ndarray, layers: np.ndarray) -> np.ndarray:
    """Layers of two-objective points, which also lie above ``sources`` with known layers.

    A source counts for all points that it is nowhere above; coordinates that do not matter are
    -inf. Points go in their order; ``tails[k]`` is the lowest second coordinate of what has come so
    far with layer ``k`` or more, so the tails rise and a point's layer is found by bisection.
    """
    tails: list[float] = []

    def place(layer: int, y: float) -> None:
        while len(tails) <= layer:
            tails.append(math.inf)
        while layer >= 0 and tails[layer] > y:
            tails[layer] = y
            layer -= 1

    behind = np.lexsort((layers, sources[:, 0]))  # sources enter when their first coordinate is reached
    queue = list(zip(sources[behind, 0].tolist(), sources[behind, 1].tolist(), layers[behind].tolist(), strict=True))
    out, at = np.empty(len(points), np.int64), 0
    order = np.lexsort((points[:, 1], points[:, 0]))
    for i, x, y in zip(order.tolist(), points[order, 0].tolist(), points[order, 1].tolist(), strict=True):
        while at < len(queue) and queue[at][0] <= x:
            place(queue[at][2], queue[at][1])
            at += 1
        out[i] = bisect.bisect_right(tails, y)
        place(int(out[i]), y)
    return out


def _pairwise_layers(points: np.ndarray, sources: np.ndarray, layers: np.ndarray) -> np.ndarray:
    """As :func:`_staircase_layers` for any number of objectives, by comparing pairs."""
    order = np.lexsort(points.T[::-1])
    points = points[order]
    found = np.zeros(len(points), np.int64)
    for i, p in enumerate(points):
        above = layers[(sources <= p).all(axis=1)].max(initial=-1)
        found[i] = 1 + max(above, found[:i][(points[:i] <= p).all(axis=1)].max(initial=-1))
    out = np.empty_like(found)
    out[order] = found
    return out


def _sliced(vectors: DataFrame, names: list[str], slices: int) -> DataFrame:
    """Add the slice of each axis, cut at quantiles of the group; equal values share a slice."""
    cuts = [f"_c{d}" for d in range(len(names))]
    if slices == 1:
        return vectors.withColumns({c: F.lit(0) for c in cuts})
    shares = [k / slices for k in range(1, slices)]
    bounds = vectors.groupBy("_g").agg(*[F.percentile_approx(n, shares).alias(f"{c}b") for n, c in zip(names, cuts, strict=True)])

    def place(name: str, bound: str) -> Column:
        return F.size(F.filter(F.col(bound), lambda x: x < F.col(name)))

    joined = vectors.join(bounds, "_g")
    return joined.withColumns({c: place(n, f"{c}b") for n, c in zip(names, cuts, strict=True)}).drop(*[f"{c}b" for c in cuts])


def _known_before(cells: DataFrame, done: DataFrame, names: list[str], cuts: list[str]) -> DataFrame:
    """For each cell, layered points of lower cells that bear on its layers: ``_g``, cuts, names, front.

    A point of a cell that is lower on some axes and level on the others lies below all points of
    the cell on the former, which become -inf. Where at most one axis is left, only its lowest value
    of each layer counts, and where none is, the highest layer.
    """
    parts = []
    below = done.select("_g", *[F.col(c).alias(f"{c}l") for c in cuts], *names, "front")
    for level in itertools.chain.from_iterable(itertools.combinations(range(len(names)), k) for k in range(len(names))):
        same = [f"{c}l" for d, c in enumerate(cuts) if d in level]
        known = below
        if len(level) <= 1:
            lowest = [F.min(names[d]).alias(names[d]) for d in level]
            highest = known.groupBy("_g", *[f"{c}l" for c in cuts])
            known = known.groupBy("_g", *[f"{c}l" for c in cuts], "front").agg(*lowest) if level else highest.agg(F.max("front").alias("front"))
        met = cells.join(known.withColumnsRenamed({x: x[:-1] for x in same}), ["_g", *[x[:-1] for x in same]])
        for d, c in enumerate(cuts):
            if d not in level:
                met = met.where(F.col(f"{c}l") < F.col(c))
        if not level:
            met = met.groupBy("_g", *cuts).agg(F.max("front").alias("front"))
        elif len(level) == 1:
            met = met.groupBy("_g", *cuts, "front").agg(F.min(names[level[0]]).alias(names[level[0]]))
        gone = {n: F.lit(float("-inf")) for d, n in enumerate(names) if d not in level}
        parts.append(met.withColumns(gone).select("_g", *cuts, *names, "front"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def front_layers(
    df: DataFrame, objectives: Sequence[str], keys: Sequence[str] = (), maximise: bool = False,
    max_layers: int | None = None, cell_rows: int | None = None,
) -> DataFrame:
    """Add ``front``: 0 for the front, 1 for the front of the rest, and so on.

    The layer of a vector is the length of the longest chain of dominating vectors that ends in it.
    Space is cut into a grid at the quantiles of every axis, as fine as the largest group needs;
    cells whose numbers add up to the same sum do not depend on each other, so each such wave is one
    distributed step that takes what it needs from lower cells as steps of known layers. The number
    of waves follows from the number of rows, not of fronts. Vectors with a null or undefined
    objective are on front 0. With ``max_layers`` deeper rows keep a null front.
    """
    rows, names = _minimised(df, objectives, maximise)
    keys = list(keys)
    rows = rows.withColumn("_g", F.struct(*keys) if keys else F.lit(0))
    vectors = cut_lineage(rows.where(_comparable(names)).select("_g", *names).distinct())
    largest = vectors.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
    cell_rows = cell_rows or (CELL_ROWS if len(names) == 2 else CELL_ROWS_MANY)
    slices = max(1, math.ceil((largest / cell_rows) ** (1 / len(names))))
    cuts = [f"_c{d}" for d in range(len(names))]
    sliced = _sliced(vectors, names, slices)
    sliced = cut_lineage(sliced) if slices > 1 else sliced
    layers_of = _staircase_layers if len(names) == 2 else _pairwise_layers

    def layer(points: pa.Table, known: pa.Table) -> pa.Table:
        layers = known["front"].to_numpy() if known.num_rows else np.empty(0, np.int64)
        found = layers_of(_matrix(points, names), _matrix(known, names), layers)
        return points.append_column("front", pa.array(found))

    layered = vectors.limit(0).withColumns({**{c: F.lit(0) for c in cuts}, "front": F.lit(0).cast("long")})
    schema = layered.select("_g", *names, *cuts, "front").schema
    for wave in range(len(names) * (slices - 1) + 1):
        active = sliced.where(sum((F.col(c) for c in cuts), F.lit(0)) == wave).select("_g", *names, *cuts)
        # written, because both sides of a cogroup must not come from one table
        known = cut_lineage(_known_before(active.select("_g", *cuts).distinct(), layered, names, cuts)) if wave else layered
        placed = active.groupBy("_g", *cuts).cogroup(known.groupBy("_g", *cuts)).applyInArrow(layer, schema)
        layered = layered.unionByName(cut_lineage(placed)) if slices > 1 else placed
    result = rows.join(layered.drop(*cuts), ["_g", *names], "left").withColumn(
        "front", F.coalesce("front", F.when(~_comparable(names), F.lit(0).cast("long")))
    )
    if max_layers is not None:
        result = result.withColumn("front", F.when(F.col("front") < max_layers, F.col("front")))
    return result.select(*df.columns, "front")


def crowding_distance(df: DataFrame, objectives: Sequence[str], keys: Sequence[str], id_col: str) -> DataFrame:
    """Add ``crowding`` per group: gap of the neighbours over the span, ends infinite.

    Groups of two or fewer are all infinite, and an objective without spread adds nothing but
    its infinite ends. Ties are ordered by id.
    """
    keys = list(keys)
    pairs = F.array(*[F.struct(F.lit(i).alias("obj"), F.col(o).cast("double").alias("v")) for i, o in enumerate(objectives)])
    # Written once: quantiles, spans and neighbours all read it.
    long = cut_lineage(df.select(*keys, id_col, F.inline(pairs)))
    spans = long.groupBy(*keys, "obj").agg((F.max("v") - F.min("v")).alias("span"), F.count(F.lit(1)).alias("n"))
    cut = ordered.add_neighbour(ordered.bucketed(long, [*keys, "obj"], ["v", id_col]), ["v", id_col], "v", "prev")
    near = ordered.plain(ordered.add_neighbour(cut, ["v", id_col], "v", "next", following=True))
    infinite = F.lit(float("inf"))
    gap = (
        F.when((F.col("n") <= 2) | F.col("prev").isNull() | F.col("next").isNull(), infinite)
        .when(F.col("span") == 0, F.lit(0.0))
        .otherwise(F.try_divide(F.col("next") - F.col("prev"), F.col("span")))
    )
    total = (
        matched(near, spans, [*keys, "obj"])
        .groupBy(*keys, id_col)
        .agg(F.sum(gap).alias("crowding"))
    )
    return matched(df, total, [*keys, id_col])


def select_best(
    df: DataFrame, objectives: Sequence[str], count: int, id_col: str, keys: Sequence[str] = (), maximise: bool = False
) -> DataFrame:
    """``count`` rows per group: whole fronts first, the last one filled by crowding distance."""
    keys = list(keys)
    layered = front_layers(df, objectives, keys, maximise)
    sizes = layered.groupBy(*keys, "front").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("front").rowsBetween(Window.unboundedPreceding, 0)
    if not keys:
        sizes, upto = sizes.withColumn("_g", F.lit(0)), Window.partitionBy("_g").orderBy("front").rowsBetween(Window.unboundedPreceding, 0)
    filled = sizes.withColumn("_upto", F.sum("_n").over(upto)).select(
        *keys, "front", "_upto", (F.lit(count) - (F.col("_upto") - F.col("_n"))).alias("_room")
    ).where("_room > 0")
    joined = matched(layered, filled, [*keys, "front"])
    whole = joined.where(F.col("_upto") <= count).drop("_upto", "_room")
    edge = joined.where(F.col("_upto") > count)
    crowded = crowding_distance(edge, objectives, [*keys, "front"], id_col)
    place = F.row_number().over(Window.partitionBy(*keys, "front").orderBy(F.desc("crowding"), id_col))
    picked = crowded.withColumn("_place", place).where((F.col("_place") <= count) & (F.col("_place") <= F.col("_room")))
    return whole.unionByName(picked.drop("_upto", "_room", "_place", "crowding"))


class Staircase:
    """Area that maximised points of two objectives cover above a corner, point by point."""

    def __init__(self, floor_x: float, floor_y: float) -> None:
        self.floor_x, self.floor_y = floor_x, floor_y
        self.xs: list[float] = []  # rising, while
        self.ys: list[float] = []  # these fall

    def add(self, x: float, y: float) -> float:
        """Take a point in; returns by how much the area grows. Steps that it covers go, each once."""
        at = bisect.bisect_left(self.xs, x)
        top = self.ys[at] if at < len(self.xs) else self.floor_y
        if top >= y:
            return 0.0
        right, first, grown = x, at, 0.0
        while first and self.ys[first - 1] <= y:
            grown += (right - self.xs[first - 1]) * (y - top)
            right, top = self.xs[first - 1], self.ys[first - 1]
            first -= 1
        grown += (right - (self.xs[first - 1] if first else self.floor_x)) * (y - top)
        if at < len(self.xs) and self.xs[at] == x:
            at += 1  # the same x, lower
        self.xs[first:at] = [x]
        self.ys[first:at] = [y]
        return grown


def hypervolume(
    points: DataFrame, objectives: Sequence[str], reference: Sequence[float], keys: Sequence[str] = (), slab_rows: int = SLAB_ROWS
) -> DataFrame:
    """Exact dominated volume of maximised points against a reference, per group, in 1 to 3 dimensions.

    In three, points go downwards in slabs of ``slab_rows``: what a point adds to the area of the
    staircase of those above it, times its height over the reference, is its share of the volume.
    """
    keys = list(keys)
    above = points
    for objective, ref in zip(objectives, reference, strict=True):
        above = above.where(F.col(objective) > ref)
    if len(objectives) == 1:
        return above.groupBy(*keys).agg((F.max(objectives[0]) - reference[0]).alias("hypervolume"))
    if len(objectives) == 2:
        x, y = objectives
        edge = front(above, objectives, keys, maximise=True).select(*keys, x, y).distinct()
        steps = ordered.neighbour(edge, keys, [y, x], y, "_below")
        area = (F.col(x) - reference[0]) * (F.col(y) - F.coalesce("_below", F.lit(float(reference[1]))))
        return steps.groupBy(*keys).agg(F.sum(area).alias("hypervolume"))
    if len(objectives) != 3:
        raise ValueError("hypervolume takes one to three objectives")
    x, y, z = objectives
    edge = front(above, objectives, keys, maximise=True).select(
        F.struct(*keys).alias("_g") if keys else F.lit(0).alias("_g"), *[F.col(o).cast("double").alias(n) for o, n in zip(objectives, "xyz", strict=True)]
    ).distinct()
    numbered = ordered.row_number(cut_lineage(edge.withColumn("_down", -F.col("z"))), ["_g"], ["_down", "x", "y"], "_rn")
    slabs = cut_lineage(numbered.select("_g", "x", "y", "z", F.floor((F.col("_rn") - 1) / slab_rows).alias("_slab")))
    # A slab needs the staircase of all points above it; each slab above gives its own.
    lasts = cut_lineage(slabs.groupBy("_g").agg(F.max("_slab").alias("_last")).where("_last > 0"))
    many = slabs.join(lasts, "_g").where("_slab < _last")
    stairs = many if lasts.isEmpty() else front(many, ["x", "y"], ["_g", "_slab"], maximise=True)
    above_slab = cut_lineage(stairs.select("_g", "_last", "_slab", "x", "y").distinct().select(
        "_g", F.explode(F.sequence(F.col("_slab") + 1, F.col("_last"))).alias("_slab"), "x", "y"
    ))
    floor_x, floor_y, floor_z = map(float, reference)

    def sweep(own: pa.Table, before: pa.Table) -> pa.Table:
        stair = Staircase(floor_x, floor_y)
        for px, py in _matrix(before, ["x", "y"]).tolist():
            stair.add(px, py)
        points = _matrix(own, ["x", "y", "z"])
        volume = math.fsum(stair.add(px, py) * (pz - floor_z) for px, py, pz in points[np.argsort(-points[:, 2], kind="stable")].tolist())
        return own.select(["_g"]).slice(0, 1).append_column("volume", pa.array([volume]))

    schema = slabs.select("_g").withColumn("volume", F.lit(0.0)).schema
    parts = slabs.groupBy("_g", "_slab").cogroup(above_slab.groupBy("_g", "_slab")).applyInArrow(sweep, schema)
    return parts.groupBy("_g").agg(F.sum("volume").alias("hypervolume")).select(*[F.col("_g")[k].alias(k) for k in keys], "hypervolume")


def compromise(front_rows: DataFrame, objectives: Sequence[str], id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Member of each front nearest to the ideal after min-max scaling; flat objectives are skipped."""
    keys = list(keys)
    bounds = front_rows.groupBy(*keys).agg(
        *[F.struct(F.min(o).alias("lo"), F.max(o).alias("hi")).alias(f"_b{i}") for i, o in enumerate(objectives)]
    )
    joined = matched(front_rows, bounds, keys)
    total = F.lit(0.0)
    for i, o in enumerate(objectives):
        span = F.col(f"_b{i}.hi") - F.col(f"_b{i}.lo")
        share = F.coalesce(F.try_divide(F.col(o) - F.col(f"_b{i}.lo"), span), F.lit(1.0))
        total = total + F.pow(1.0 - share, 2)
    return joined.withColumn("distance", F.sqrt(total)).groupBy(*keys).agg(
        F.min_by(id_col, F.struct("distance", id_col)).alias(id_col), F.min("distance").alias("distance")
    )


def champions(front_rows: DataFrame, objectives: Sequence[str], id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Member with the best value per objective, in long form; the first id wins a tie."""
    picks = front_rows.groupBy(*keys).agg(
        *[F.min_by(F.struct(F.lit(o).alias("objective"), F.col(id_col), F.col(o).cast("double").alias("value")), F.struct(-F.col(o), id_col)).alias(f"c{i}")
          for i, o in enumerate(objectives)]
    )
    return picks.select(*keys, F.inline(F.array(*[f"c{i}" for i in range(len(objectives))])))


def merge_archive(
    archive: DataFrame, batch: DataFrame, config: Sequence[str], objectives: Sequence[str], id_col: str,
    keys: Sequence[str] = (), capacity: int = 64, tolerance: float = 1e-9, maximise: bool = True,
) -> DataFrame:
    """Kept front after a batch: a newer measurement of a configuration replaces the old one,
    dominated members leave, and beyond ``capacity`` the most crowded leave first."""
    keys = list(keys)
    both = archive.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    same = [F.round(F.col(c) / tolerance).alias(f"_c{i}") for i, c in enumerate(config)]
    latest = both.groupBy(*keys, *same).agg(
        F.max_by(F.struct(*[c for c in archive.columns if c not in keys]), F.struct("_batch", id_col)).alias("m")
    ).select(*keys, "m.*")
    members = cut_lineage(front(latest, objectives, keys, maximise))
    crowded = crowding_distance(members, objectives, keys, id_col)
    place = F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("crowding"), id_col))
    return crowded.withColumn("_place", place).where(F.col("_place") <= capacity).drop("_place")
