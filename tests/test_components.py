"""Strong components, witness cycles and append-only loops against plain searches."""

import random

import pytest

from factloom.operators import graph


def reachable(edges):
    out = {n: set() for e in edges for n in e}
    for a in out:
        stack = [a]
        while stack:
            for b in (y for x, y in edges if x == stack[-1] and y not in out[a]):
                out[a].add(b)
                stack.append(b)
                break
            else:
                stack.pop()
    return out


def random_edges(seed, n=24, m=34):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_witnesses(spark, seed):
    edges = random_edges(seed) + ([(100, 100), (101, 102)] if seed == 1 else [(i, i + 1) for i in range(200, 206)] + [(206, 200), (5, 200)])
    reach = reachable(edges)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
    table = spark.createDataFrame(edges + edges[:3], "src long, dst long").union(spark.createDataFrame([(None, 1), (2, None)], "src long, dst long"))
    components = graph.strong_components(table)
    found = {r.node: r.component for r in components.collect()}
    assert found == want
    rows = graph.witness_cycles(table, components).collect()
    paths = {c: [r.node for r in sorted((x for x in rows if x.component == c), key=lambda r: r.position)] for c in set(want.values())}
    assert {r.component for r in rows} == set(paths) and sum(map(len, paths.values())) == len(rows)
    for c, path in paths.items():
        assert path[0] == c and len(set(path)) == len(path) and all(want[n] == c for n in path)
        assert all(e in edges for e in zip(path, path[1:] + [c], strict=True))
        layers, seen = [{c}], {c}  # no shorter way back
        while not any((n, c) in edges for n in layers[-1]):
            layers.append({y for x, y in edges if x in layers[-1]} - seen)
            seen |= layers[-1]
        assert len(path) == len(layers)


def test_a_graph_without_cycles(spark):
    table = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    components = graph.strong_components(table)
    assert components.count() == 0 and graph.witness_cycles(table, components).count() == 0
    assert graph.strong_components(table.limit(0)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_levels_and_dependents(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "SMALL_ROWS", 10**6 if few else 0)
    rnd = random.Random(8)
    edges = sorted({(i, rnd.randrange(max(0, i - 4), i)) for i in range(1, 22) for _ in range(2)}) + [(70, 71), (71, 70), (72, 70), (73, 999)]
    nodes = sorted({n for e in edges for n in e} - {999}) + [500]
    level = {}
    for _ in range(80):
        for n in nodes:
            needs = [b for a, b in edges if a == n]
            if all(b in level for b in needs):
                level[n] = max((level[b] + 1 for b in needs), default=0)
    deps = spark.createDataFrame(edges, "node long, requires long")
    got = {r.node: r.level for r in graph.levels(spark.createDataFrame([(n,) for n in nodes], "node long"), deps).collect()}
    assert got == {n: level.get(n) for n in nodes} and max(level.values()) > 4
    back = reachable([(b, a) for a, b in edges])
    for seeds in ([0], [3, 71], [12345]):
        table = spark.createDataFrame([(s,) for s in seeds], "node long")
        assert {r.node for r in graph.transitive_dependents(deps, table).collect()} == set().union(*(back.get(s, set()) for s in seeds))


def test_parts_are_merged_by_size(spark):
    parts = graph.Parts(spark.range(0))
    for i in range(40):
        parts.append(spark.range(i, i + 1), 1)
    assert len(parts.parts) <= 14 and sorted(r.id for r in parts.table().collect()) == list(range(40))
