"""Rows that the test tables do not hold: nulls in keys, ties, spikes, other order types, odd messages."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import scores
from factloom.operators import ordered, ranking, rollups, stages
from factloom.sources import records


def plain_average(values, alpha=0.1, seed=0.0):
    out, e = [], seed
    for x in values:
        e = (1 - alpha) * e + alpha * x
        out.append(e)
    return out


@pytest.mark.parametrize("alpha", [0.1, 0.9, 0.003])
def test_moving_average_keeps_all_history(spark, alpha):
    values = [1.0] * 6000
    values[4000] = 1e25
    rows = [(i, k, v) for i, v in enumerate(values) for k in ("a", None)]
    got = ordered.moving_average(spark.createDataFrame(rows, "i long, k string, v double"), ["k"], ["i"], "v", alpha, 2.0)
    by_row = {(r.k, r.i): r.ema for r in got.collect()}
    want = plain_average(values, alpha, 2.0)
    for k in ("a", None):
        np.testing.assert_allclose([by_row[k, i] for i in range(6000)], want, rtol=1e-9)


@pytest.mark.parametrize("kind", ["string", "date", "tied"])
def test_buckets_split_one_key(spark, kind):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 270) for i in range(3650)]
    rows = [(i, None if i % 2 else "k", d.isoformat(), d, 7) for i, d in enumerate(days)]
    table = spark.createDataFrame(rows, "i long, k string, string string, date date, tied int")
    cut = ordered.bucketed(table, ["k"], [kind, "i"])
    assert cut.select(ordered.BUCKET).distinct().count() > 16
    numbered = ordered.row_number(table, ["k"], [kind, "i"]).toPandas()
    column = {"string": 2, "date": 3, "tied": 4}[kind]
    for key in ("k", None):
        own = sorted((r[column], r[0]) for r in rows if r[1] == key)
        got = numbered[numbered.k.isna() if key is None else numbered.k == key].sort_values("rn")
        assert list(got.i) == [i for _, i in own] and list(got.rn) == list(range(1, len(own) + 1))


def points(spark, objectives):
    names = ["x", "y", "z"][:objectives]
    rows = [(i, None if i < 4 else "g", *[float(v) for v in p]) for i, p in enumerate([(1, 5, 3), (5, 1, 3), (3, 3, 3), (9, 9, 9)] * 2)]
    return spark.createDataFrame([r[: 2 + objectives] for r in rows], "id long, g string, " + ", ".join(f"{n} double" for n in names)), names


@pytest.mark.parametrize("objectives", [2, 3])
def test_null_groups_are_ranked(spark, objectives):
    table, names = points(spark, objectives)
    assert {r.id for r in ranking.dominated(table, names, ["g"]).where("dominated").collect()} == {3, 7}
    assert {r.id: r.front for r in ranking.front_layers(table, names, ["g"]).collect()} == {i: int(i % 4 == 3) for i in range(8)}
    assert ranking.crowding_distance(table, names, ["g"], "id").count() == 8
    assert ranking.compromise(table, names, "id", ["g"]).count() == 2
    assert ranking.compromise(table, names, "id").count() == 1


def test_lookups_with_a_null_key(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, t int")
    assert sorted((r.t, r.hit) for r in rollups.first_lookup_misses(rows, ["k"], ["t"]).collect()) == [(1, False), (2, False), (3, True)]


def test_gcc_messages_may_hold_brackets(spark):
    message = "cannot convert int [3][4] to p"
    one = '[{"kind": "error", "message": "%s", "locations": []}]' % message
    rows = spark.createDataFrame([(1, one + "\n" + one), (2, "[]\n  " + one)], "id int, text string")
    assert [(r.id, r.message) for r in records.gcc_diagnostics(rows, ["id"]).orderBy("id").collect()] == [(1, message)] * 2 + [(2, message)]


def test_files_that_share_a_path(spark):
    docs = spark.createDataFrame([("p.py", "code:python", "d1", "A = 1"), ("p.py", "code:python", "d2", "A = 2")], "path string, format string, domain string, text string")
    assert sorted(r.domain for r in stages.extract_facts(docs).collect()) == ["d1", "d2"]


def test_cosine_restarts_at_any_cycle(spark):
    cycles = [0, 49, 50, 149, 150, 349, 350, 50 + 100 * (2**40 - 1), 49 + 100 * (2**40 - 1), 2**52]
    got = spark.createDataFrame([(c,) for c in cycles], "c long").select("c", scores.cosine_rate(F.col("c")).alias("r")).collect()
    for r in got:
        if r.c < scores.WARMUP:
            continue
        start, length = 0, scores.PERIOD
        while start + length <= r.c - scores.WARMUP:
            start, length = start + length, length * 2
        fraction = (r.c - scores.WARMUP - start) / length
        want = scores.MIN_RATE + (scores.INITIAL_RATE - scores.MIN_RATE) * 0.5 * (1 + np.cos(3.141592653589793 * fraction))
        assert r.r == pytest.approx(max(scores.MIN_RATE, want), abs=1e-12)
