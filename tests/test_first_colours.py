"""Strong components that are coloured in two phases equal those found by search."""

import random

import pytest

from factloom.operators import graph
from tests.test_components import random_edges, reachable


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_components_with_a_first_phase(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "FIRST_OF", 3)  # a third of the nodes go first
    shift = random.Random(3).sample(range(-50, 50), 48)
    edges = [(shift[a + 24 * k], shift[b + 24 * k]) for k in range(2) for a, b in random_edges(k + 5)]
    to = {r: s for r, s in reachable(edges).items()}
    want = {(n, min(m for m in to[n] if n in to[m])) for n in to if n in to[n]}
    frame = spark.createDataFrame(edges, "src long, dst long").selectExpr(f"CAST(src AS {kind}) AS src", f"CAST(dst AS {kind}) AS dst")
    got = graph.strong_components(frame)
    assert got.schema["component"].dataType == frame.schema["src"].dataType
    rows = {(int(r.node), int(r.component)) for r in got.collect()}
    if kind == "string":  # names order as text
        groups = lambda pairs: {frozenset(n for n, c in pairs if c == k) for k in {c for _, c in pairs}}
        assert groups(rows) == groups(want)
    else:
        assert rows == want


def test_few_nodes_go_first(spark, monkeypatch):
    """A ring of 64 nodes: the marks that travel are those of the first nodes, not one from every node."""
    sent = []
    counted = graph._counted
    monkeypatch.setattr(graph, "FIRST_OF", 16)
    monkeypatch.setattr(graph, "_counted", lambda df: (lambda r: sent.append(r[1]) or r)(counted(df)))
    edges = spark.range(64).selectExpr("id AS src", "(id + 1) % 64 AS dst")
    nodes = edges.selectExpr("src AS node", "xxhash64(src) AS label")
    start = graph.F.col("label") < -(1 << 63) + (1 << 64) // 16
    found = {r.label for r in graph._spread(nodes, graph.cut_lineage(edges), [], start).collect()}
    assert found == {min(r.label for r in nodes.collect())}
    assert max(sent) <= 16
