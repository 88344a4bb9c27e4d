"""Ordered analytics per key that survive a key holding a third of all rows.

A window over such a key would run in one task. Here rows are cut into buckets at quantiles of (key,
order, hash of the row), windows run per (key, bucket), and what a bucket needs from the buckets of
its key before it is carried over through a table with one row per (key, bucket). The results equal
those of the plain window over the key; rows that tie in all order columns follow their hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from factloom.session import cut_lineage

#: Buckets of a table, more of them from BUCKET_ROWS rows a bucket on, up to MOST_BUCKETS; beyond that they grow.
BUCKETS = 64
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 4096
#: Rows of the sample per bucket.
PER_BUCKET = 50
BUCKET = "_bucket"
KEY = "_key"
TIE = "_tie"


def _upper_place(bounds: Column, value: Column, most: int) -> Column:
    """How many of the sorted bounds are not above the value, by binary steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length(), -1, -1)])

    def search(v: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= v, at + step).otherwise(at))

    return F.get(F.transform(F.array(value), search), F.lit(0))


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Add the key as one struct, a hash of the row, and the bucket of (key, order, hash).

    Bounds are quantiles of a sample of rows, so buckets hold about equally many rows: a hot key has
    many of them to itself, small keys share one, and rows that tie in all order columns are dealt
    apart as long as they differ in anything. Bucket numbers follow the key and its order. A struct
    of nulls equals itself, so rows with a null key stay together without null-safe joins. Counting
    and sampling read ``df`` twice; callers write it first where that is dear.
    """
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = df.withColumns({KEY: F.struct(*keys) if keys else F.lit(0), TIE: F.xxhash64(*hashed)})
    value = F.struct(KEY, *order, TIE)
    n = rows.count()
    count = max(buckets, min(math.ceil(n / BUCKET_ROWS), MOST_BUCKETS))
    wanted = count * PER_BUCKET
    sample = rows.select(value.alias("_o"))
    sample = sample.sample(wanted / n, seed=17) if n > wanted else sample
    every = F.greatest(F.floor(F.size("_all") / count), F.lit(1))
    bounds = sample.agg(F.sort_array(F.collect_list("_o")).alias("_all")).select(
        F.filter("_all", lambda _, i: (i % every == 0) & (i > 0)).alias("_bounds")
    )
    placed = rows.withColumn("_bounds", cut_lineage(bounds).scalar())
    return placed.withColumn(BUCKET, _upper_place(F.col("_bounds"), value, 2 * count)).drop("_bounds")


def _inside(order: Sequence[str]) -> Window:
    return Window.partitionBy(KEY, BUCKET).orderBy(*order, TIE)


def plain(cut: DataFrame) -> DataFrame:
    return cut.drop(KEY, BUCKET, TIE)


def _carried(
    cut: DataFrame, per_bucket: Mapping[str, Column], combine: Mapping[str, Callable[[Column], Column]], backwards: bool = False,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Join to every row what the buckets before (or after) its own add up to, per key.

    ``rows`` may give more columns of the rows than the sums need.
    """
    order = F.col(BUCKET).desc() if backwards else F.col(BUCKET).asc()
    before = Window.partitionBy(KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summary = cut.groupBy(KEY, BUCKET).agg(*[c.alias(n) for n, c in per_bucket.items()])
    carry = summary.select(KEY, BUCKET, *[combine[n](F.col(n)).over(before).alias(n) for n in per_bucket])
    return (cut if rows is None else rows).join(carry, [KEY, BUCKET], "left")


def add_row_number(cut: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    w = _inside(order)
    counted = _carried(cut, {"_before": F.count(F.lit(1))}, {"_before": F.sum})
    return counted.withColumn(name, F.row_number().over(w) + F.coalesce("_before", F.lit(0))).drop("_before")


def add_neighbour(cut: DataFrame, order: Sequence[str], value: str, name: str, following: bool = False) -> DataFrame:
    w = _inside(order)
    pick = F.min_by if following else F.max_by
    edge = {"_edge": pick(F.struct(value), F.struct(*order, TIE))}
    near = _carried(cut, edge, {"_edge": F.last}, backwards=following)
    inside = (F.lead if following else F.lag)(F.struct(value)).over(w)
    return near.withColumn(name, F.coalesce(inside, F.col("_edge"))[value]).drop("_edge")


def add_running(
    cut: DataFrame, order: Sequence[str], value: Column, agg: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column], name: str, inclusive: bool = True,
) -> DataFrame:
    """Running min, max or sum; ``merge`` joins the carried part with the own bucket's."""
    end = Window.currentRow if inclusive else -1
    w = _inside(order).rowsBetween(Window.unboundedPreceding, end)
    have = _carried(cut.withColumn("_value", value), {"_carry": agg(F.col("_value"))}, {"_carry": agg})
    own = agg(F.col("_value")).over(w)
    both = F.when(own.isNull(), F.col("_carry")).when(F.col("_carry").isNull(), own).otherwise(merge(F.col("_carry"), own))
    return have.withColumn(name, both).drop("_value", "_carry")


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """1, 2, 3, ... per key in ``order``."""
    return plain(add_row_number(bucketed(df, keys, order), order, name))


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, following: bool = False
) -> DataFrame:
    """The value of the previous (or following) row per key, null at the end."""
    return plain(add_neighbour(bucketed(df, keys, order), order, value, name, following))


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, agg: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column], name: str, inclusive: bool = True,
) -> DataFrame:
    return plain(add_running(bucketed(df, keys, order), order, value, agg, merge, name, inclusive))


def kinetics(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, epsilon: float = 0.005, patience: int = 15
) -> DataFrame:
    """Velocity, acceleration, stall run and stall flag of an ordered score per key.

    A row stalls when it has two predecessors and both differences are below ``epsilon``; the
    run counts the stalled rows in a row, ending at the row itself.
    """
    cut = bucketed(cut_lineage(df), keys, order)  # written once: bounds, rows and both carries read it
    w, value = _inside(order), F.struct(score)
    inside = cut.withColumns({"_i": F.row_number().over(w), "_p1": F.lag(value, 1).over(w), "_p2": F.lag(value, 2).over(w)})
    ends = inside.groupBy(KEY, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(value, "_i").alias("_l1"), F.max_by("_p1", "_i").alias("_l2")
    )
    buckets = Window.partitionBy(KEY).orderBy(BUCKET)
    carry = ends.select(
        KEY, BUCKET,
        F.coalesce(F.sum("_n").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_l1", 1).over(buckets).alias("_c1"),
        F.when(F.lag("_n", 1).over(buckets) >= 2, F.lag("_l2", 1).over(buckets)).otherwise(F.lag("_l1", 2).over(buckets)).alias("_c2"),
    )
    last = F.coalesce("_p1", "_c1")[score]
    second = F.when(F.col("_i") >= 3, F.col("_p2")).when(F.col("_i") == 2, F.col("_c1")).otherwise(F.col("_c2"))[score]
    rows = inside.join(carry, [KEY, BUCKET]).withColumns(
        {"_rn": F.col("_i") + F.col("_before"), "velocity": F.coalesce(F.col(score) - last, F.lit(0.0)), "_last": F.coalesce(last - second, F.lit(0.0))}
    )
    rows = rows.withColumn("acceleration", F.when(F.col("_rn") >= 3, F.col("velocity") - F.col("_last")).otherwise(F.lit(0.0)))
    stalled = (F.col("_rn") >= 3) & (F.abs("velocity") < epsilon) & (F.abs("acceleration") < epsilon)
    rows = add_running(rows, order, F.when(~stalled, F.col("_rn")), F.max, F.greatest, "_break")
    return plain(
        rows.withColumn("stall_run", F.col("_rn") - F.coalesce("_break", F.lit(0)))
        .withColumn("stagnation", F.col("stall_run") >= patience)
        .drop("_i", "_p1", "_p2", "_before", "_c1", "_c2", "_rn", "_last", "_break")
    )


def steps_since_improvement(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, min_delta: float = 0.0005,
    patience: int = 200, novel: str | None = None, initial_best: float = 0.0,
) -> DataFrame:
    """Steps since the best moved by more than ``min_delta`` (or a novel row), and the stagnation flag.

    The best only moves on a qualifying step, so this is a fold. Only strict running maxima can
    qualify, since the best never lies more than ``min_delta`` below the running maximum; the
    fold therefore sees those few rows and not a key's whole history.
    """
    cut = bucketed(df, keys, order)
    w = _inside(order)
    inside = cut.withColumns({"_i": F.row_number().over(w), "_own": F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    sums = {"_before": F.count(F.lit(1)), "_carry": F.max(score)}
    cut = _carried(cut, sums, {"_before": F.sum, "_carry": F.max}, rows=inside).withColumns(
        {"_rn": F.col("_i") + F.coalesce("_before", F.lit(0)), "_max_before": F.greatest("_own", "_carry")}
    )
    cut = cut_lineage(cut.drop("_i", "_own", "_before", "_carry"))
    peaks = cut.where((F.col(score) > F.coalesce("_max_before", F.lit(float("-inf")))) & (F.col(score) > initial_best + min_delta))

    keyed = peaks.select(F.to_json(F.struct(KEY)).alias("_k"), "_rn", F.col(score).alias("_score"))

    def improvements(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, current = initial_best, None
        for page in pages:
            hits = []
            for key, rn, value in zip(page["_k"], page["_rn"], page["_score"], strict=True):
                if key != current:
                    best, current = initial_best, key
                if value > best + min_delta:
                    best = value
                    hits.append((key, rn))
            yield pd.DataFrame(hits, columns=["_k", "_rn"])

    # Sorted runs per key inside a partition: no per-key call and only one page in memory.
    runs = keyed.repartition("_k").sortWithinPartitions("_k", "_rn")
    moved = cut_lineage(runs.mapInPandas(improvements, "_k string, _rn long").withColumn("_moved", F.lit(True)))
    marked = cut.withColumn("_k", F.to_json(F.struct(KEY))).join(moved, ["_k", "_rn"], "left")
    reset = F.col("_moved").isNotNull() | (F.coalesce(F.col(novel), F.lit(False)) if novel else F.lit(False))
    marked = add_running(marked, order, F.when(reset, F.col("_rn")), F.max, F.greatest, "_last_reset")
    steps = F.col("_rn") - F.coalesce("_last_reset", F.lit(0))
    return plain(
        marked.withColumn("steps", steps).withColumn("stagnant", steps >= patience).drop("_k", "_rn", "_moved", "_max_before", "_last_reset")
    )


def overlapping_chunks(df: DataFrame, rn: str, size: int, overlap: int) -> DataFrame:
    """Cut numbered rows into chunks that also hold the ``overlap`` rows before them.

    ``_own`` marks the rows a chunk answers for. A chunk has at most ``size + overlap`` rows.
    """
    chunk = F.floor((F.col(rn) - 1) / size)
    tail = (F.col(rn) - 1) % size >= size - overlap
    homes = F.array_compact(
        F.array(
            F.struct(chunk.alias("_chunk"), F.lit(True).alias("_own")),
            F.when(tail, F.struct((chunk + 1).alias("_chunk"), F.lit(False).alias("_own"))),
        )
    )
    return df.select("*", F.inline(homes))


def rolling(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], aggs: Mapping[str, Column], rows: int = 100
) -> DataFrame:
    """Aggregates over the last ``rows`` rows per key."""
    chunks = overlapping_chunks(row_number(df, keys, order), "rn", max(4096, rows), rows - 1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("rn").rowsBetween(-(rows - 1), 0)
    return chunks.withColumns({n: c.over(w) for n, c in aggs.items()}).where("_own").drop("_chunk", "_own", "rn")


def moving_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.1, seed: float = 0.0, name: str = "ema"
) -> DataFrame:
    """Exponential moving average ``a*x + (1-a)*previous`` per key, starting from ``seed``.

    A step is the map e -> (1-a)*e + a*x, and maps compose. Rows are cut into chunks; a chunk's own
    average is a scaled running sum, and what it began with is put together from the ends of the
    chunks before it, as far back as any double can still count after so many steps. An infinite or
    undefined value never fades: from the first of each kind of its key on, the average is what the
    recursion gives. A null value only lets the average decay.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie in (0, 1)")
    decay = 1.0 - alpha
    size = max(1, math.floor(60 / -math.log10(decay)))
    back = math.ceil(640 / (-math.log10(decay) * size)) + 1  # beyond, the largest double is below the smallest
    rows = row_number(cut_lineage(df), keys, order, "_rn").withColumns(
        {KEY: F.struct(*keys) if keys else F.lit(0), "_chunk": F.floor((F.col("_rn") - 1) / size), "_x": F.col(value).cast("double")}
    )
    step, x = (F.col("_rn") - 1) % size + 1, F.col("_x")
    finite = F.abs(x) < float("inf")
    w = Window.partitionBy(KEY, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    # Weights end at 1 with the chunk, so nothing overflows that the average itself could hold.
    scaled = F.sum(F.when(finite, alpha * x * F.pow(F.lit(decay), size - step))).over(w) * F.pow(F.lit(decay), step - size)
    rows = rows.withColumns({"_own": F.coalesce(scaled, F.lit(0.0)), "_step": step})
    ends = rows.groupBy(KEY, "_chunk").agg(F.max_by("_own", "_rn").alias("_end"))
    later = ends.select(KEY, "_end", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("_d"), "_chunk").select(
        KEY, (F.col("_chunk") + F.col("_d")).alias("_chunk"), F.struct(F.col("_d"), F.col("_end")).alias("_part")
    )
    nearest = later.groupBy(KEY, "_chunk").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))  # ``back`` at most
    began = F.aggregate("_parts", F.lit(0.0), lambda e, part: e + part["_end"] * F.pow(F.lit(decay), (part["_d"] - 1) * size))
    joined = rows.join(nearest.select(KEY, "_chunk", began.alias("_began")), [KEY, "_chunk"], "left")
    firsts = rows.where(~finite).groupBy(KEY).agg(
        F.min(F.when(x == float("inf"), F.col("_rn"))).alias("_up"), F.min(F.when(x == float("-inf"), F.col("_rn"))).alias("_down"),
        F.min(F.when(F.isnan(x), F.col("_rn"))).alias("_undefined"),
    )
    joined = joined.join(firsts, KEY, "left")
    carried = F.coalesce("_began", F.lit(0.0)) * F.pow(F.lit(decay), F.col("_step"))
    smooth = F.col("_own") + carried + seed * F.pow(F.lit(decay), F.col("_rn"))
    up, down, undefined = (F.col("_rn") >= F.col(c) for c in ("_up", "_down", "_undefined"))
    result = F.when(undefined | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(smooth)
    return joined.withColumn(name, result).drop(KEY, "_rn", "_chunk", "_x", "_own", "_step", "_began", "_up", "_down", "_undefined")
