"""Buckets of hot and tied orders, non-finite averages, large skylines, layers and volumes against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import ordered, ranking

INF = float("inf")


def bucket_sizes(cut):
    return [r["count"] for r in cut.groupBy(ordered.BUCKET).count().collect()]


def test_buckets_of_few_order_values(spark):
    days = spark.range(400_000).select((F.col("id") % 270).alias("day"), F.col("id").alias("value"))
    sizes = bucket_sizes(ordered.bucketed(days, [], ["day"]))
    assert len(sizes) >= 48 and max(sizes) < 3 * 400_000 / 64
    keyed = spark.range(300_000).select((F.col("id") % 5000).alias("user"), F.floor(F.col("id") / 5000).alias("day"))
    sizes = bucket_sizes(ordered.bucketed(keyed, ["user"], ["day"]))
    assert len(sizes) >= 48 and max(sizes) < 3 * 300_000 / 64


def test_a_hot_key_is_split_and_ties_are_numbered_once(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 2000)).alias("k"), (F.col("id") % 7).alias("day"), "id"
    )
    cut = ordered.bucketed(rows, ["k"], ["day"])
    assert cut.where("k = 'hot'").select(ordered.BUCKET).distinct().count() >= 16
    got = ordered.row_number(rows, ["k"], ["day"]).toPandas()
    hot = got[got.k == "hot"].sort_values("rn")
    assert list(hot.rn) == list(range(1, 20_001)) and hot.day.is_monotonic_increasing
    assert (got.groupby("k").rn.max() == got.groupby("k").rn.count()).all()


def test_kinetics_with_tiny_buckets(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice([0.0, 0.001, 0.002, 1.0])) for k in ("a", "b", None) for i in range(90)] + [("one", 0, 1.0)]
    got = ordered.kinetics(spark.createDataFrame(rows, "k string, i long, s double"), ["k"], ["i"], "s", patience=3).collect()
    found = {(r.k, r.i): (r.velocity, r.acceleration, r.stall_run, r.stagnation) for r in got}
    for key in ("a", "b", None, "one"):
        scores = [s for k, _, s in rows if k == key]
        run = 0
        for i, s in enumerate(scores):
            v = s - scores[i - 1] if i else 0.0
            a = v - (scores[i - 1] - scores[i - 2]) if i >= 2 else 0.0
            run = run + 1 if i >= 2 and abs(v) < 0.005 and abs(a) < 0.005 else 0
            assert found[key, i] == (pytest.approx(v), pytest.approx(a), run, run >= 3)


@pytest.mark.parametrize("kinds", [[INF], [-INF], [math.nan], [INF, -INF], [-INF, math.nan]])
def test_averages_after_values_that_are_not_finite(spark, kinds):
    values = [1.0 + i % 3 for i in range(3000)]
    for k, v in enumerate(kinds):
        values[5 + 1000 * k] = v
    values[20] = 1e300
    got = ordered.moving_average(spark.createDataFrame(list(enumerate(values)), "i long, v double"), [], ["i"], "v")
    by_row = {r.i: r.ema for r in got.collect()}
    want, e = [], 0.0
    for x in values:
        e = 0.9 * e + 0.1 * x
        want.append(e)
    np.testing.assert_allclose([by_row[i] for i in range(3000)], want, rtol=1e-9)


def test_sixty_thousand_points_on_one_front(spark):
    rng = np.random.default_rng(2)
    points = np.abs(rng.normal(size=(60_000, 3)))
    points /= np.linalg.norm(points, axis=1, keepdims=True)  # a sphere: none dominates another
    inner = points[:5000] * 0.99
    rows = spark.createDataFrame(np.concatenate([points, inner]).tolist(), "a double, b double, c double").withColumn("id", F.monotonically_increasing_id())
    got = ranking.dominated(rows, ["a", "b", "c"], maximise=True)
    assert got.groupBy("dominated").count().collect() and got.where("dominated").count() == 5000


def plain_dominated(points):
    return {i for i, p in enumerate(points) if any(all(x <= y for x, y in zip(q, p, strict=True)) and q != p for q in points)}


@pytest.mark.parametrize("objectives", [3, 4])
def test_trees_over_small_leaves(spark, monkeypatch, objectives):
    monkeypatch.setattr(ranking, "LEAF_ROWS", 8)
    rnd = random.Random(objectives)
    groups = {g: [tuple(float(rnd.randint(0, 5)) for _ in range(objectives)) for _ in range(n)] for g, n in ((0, 120), (1, 5), (None, 40))}
    names = "abcd"[:objectives]
    rows = [(g, i, *p) for g, points in groups.items() for i, p in enumerate(points)] + [(0, 900, None, *[0.0] * (objectives - 1)), (0, 901, math.nan, *[0.0] * (objectives - 1))]
    table = spark.createDataFrame(rows, "g int, i int, " + ", ".join(f"{n} double" for n in names))
    got = {(r.g, r.i) for r in ranking.dominated(table, list(names), ["g"]).where("dominated").collect()}
    assert got == {(g, i) for g, points in groups.items() for i in plain_dominated(points)}


def plain_layers(points):
    out, left, number = {}, dict(enumerate(points)), 0
    while left:
        best = {i for i, p in left.items() if not any(all(x <= y for x, y in zip(q, p, strict=True)) and q != p for q in left.values())}
        out.update(dict.fromkeys(best, number))
        left, number = {i: p for i, p in left.items() if i not in best}, number + 1
    return out


@pytest.mark.parametrize(("objectives", "cell"), [(2, 1000), (2, 12), (3, 20)])
def test_layers_in_waves_of_cells(spark, objectives, cell):
    rnd = random.Random(objectives * cell)
    groups = {g: [tuple(float(rnd.randint(0, 30)) for _ in range(objectives)) for _ in range(n)] for g, n in ((0, 110), (None, 30))}
    names = "abc"[:objectives]
    rows = [(g, i, *p) for g, points in groups.items() for i, p in enumerate(points)] + [(0, 900, None, *[0.0] * (objectives - 1))]
    table = spark.createDataFrame(rows, "g int, i int, " + ", ".join(f"{n} double" for n in names))
    got = {(r.g, r.i): r.front for r in ranking.front_layers(table, list(names), ["g"], cell_rows=cell).collect()}
    assert got == {(g, i): k for g, points in groups.items() for i, k in plain_layers(points).items()} | {(0, 900): 0}


@pytest.mark.parametrize("slab", [7, 1000])
def test_volume_in_slabs(spark, slab):
    rnd = random.Random(slab)
    points = [(g, *(float(rnd.randint(0, 9)) for _ in range(3))) for g in (0, 0, 0, 1) for _ in range(25)]
    table = spark.createDataFrame(points, "g int, x double, y double, z double")
    got = {r.g: r.hypervolume for r in ranking.hypervolume(table, ["x", "y", "z"], [1.0, 0.0, 2.0], ["g"], slab_rows=slab).collect()}
    for g in (0, 1):
        own = [p[1:] for p in points if p[0] == g]
        cells = itertools.product(range(1, 9), range(0, 9), range(2, 9))
        assert got[g] == sum(any(px > x and py > y and pz > z for px, py, pz in own) for x, y, z in cells)


def test_staircase_area():
    rnd = random.Random(1)
    stair, points, total = ranking.Staircase(0.0, 0.0), [], 0.0
    for _ in range(300):
        x, y = rnd.randint(0, 20), rnd.randint(0, 20)
        points.append((x, y))
        total += stair.add(float(x), float(y))
        assert total == sum(max((py for px, py in points if px > cell), default=0) for cell in range(20))
