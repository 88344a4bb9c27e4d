"""Dependency graphs as edge tables.

Loops run on the driver, each step is a few Spark jobs, and only row counts come back. A step writes
what it has newly found and leaves older rows where they are; lineage is cut with reliable
checkpoints, so a lost executor costs one step and not the whole loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factloom.session import cut_lineage

#: Counted rows up to which a step's new rows travel to the tables they meet, which then need no shuffle.
SMALL_ROWS = 200_000
#: One of so many nodes colours the graph before the others in the search for strong components.
FIRST_OF = 4096


class Parts:
    """A table that grows by appended parts.

    Parts of similar size are merged, so a row is written again only when its part has doubled, and
    the number of parts grows with the logarithm of the rows.
    """

    def __init__(self, empty: DataFrame, merged: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        self.empty, self.merged = empty, merged
        self.parts: list[tuple[DataFrame, int]] = []

    def append(self, part: DataFrame, rows: int) -> None:
        """Add a part whose lineage is cut."""
        if rows:
            self.parts.append((part, rows))
        run = len(self.parts)
        while run > 1 and self.parts[run - 2][1] <= 2 * sum(n for _, n in self.parts[run - 1 :]):
            run -= 1
        if len(self.parts) - run >= 7:  # merge eight similar ones at once
            tail = self.parts[run - 1 :]
            width = int(self.empty.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            whole = cut_lineage(self.merged(_union([df for df, _ in tail])).coalesce(width))
            self.parts[run - 1 :] = [(whole, whole.count())]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.parts)

    def table(self) -> DataFrame:
        return _union([df for df, _ in self.parts]) if self.parts else self.empty


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    cut = cut_lineage(df)
    return cut, cut.count()


def _light(df: DataFrame, rows: int) -> DataFrame:
    """Counted rows for a join: sent to the other side where they are few, else joined as Spark sees fit."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _unmet(found: DataFrame, met: Parts, on: list[str]) -> tuple[DataFrame, int]:
    """Rows of ``found`` whose ``on`` is not in ``met`` yet, counted; a large ``met`` stays where it is."""
    if met.rows <= SMALL_ROWS:
        return _counted(found.join(F.broadcast(met.table().select(*on)), on, "left_anti"))
    found, rows = _counted(found)
    known = met.table().join(_light(found.select(*on), rows), on, "left_semi")
    return _counted(found.join(known.select(*on), on, "left_anti"))


def transitive_dependents(deps: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that require a seed directly or through others, the seeds excluded unless reached.

    ``deps`` has (node, requires), ``seeds`` has (node). Every node enters the frontier once, so
    a cycle ends the loop as well. What is reached is kept in appended parts.
    """
    edges = cut_lineage(deps.select("node", "requires"))
    frontier, rows = _counted(seeds.select("node").distinct())
    reached = Parts(frontier.limit(0))
    while rows:
        step = _light(frontier.select(F.col("node").alias("requires")), rows)
        frontier, rows = _unmet(edges.join(step, "requires").select("node").distinct(), reached, ["node"])
        reached.append(frontier, rows)
    return reached.table()


def direct_dependents(deps: DataFrame, node: object) -> DataFrame:
    return deps.where(F.col("requires") == F.lit(node)).select("node").distinct()


def levels(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """Longest dependency depth per node; ``level`` is null in or behind a cycle or an unknown node.

    Kahn's layers as counting: a node joins the next layer when its last open requirement was in the
    layer just finished. Every edge carries how many requirements its node has, so a step looks only
    at the edges that leave the layer: what arrives at a node now and has arrived before makes up
    that number, or is appended to what has arrived. Each edge is touched in one step, and hub nodes
    are counted with map-side combine.
    """
    every = cut_lineage(nodes.select("node").distinct())
    edges = deps.select("node", "requires").distinct()
    needed = edges.groupBy("node").agg(F.count(F.lit(1)).alias("needed"))
    edges = cut_lineage(edges.join(needed, "node").join(every, "node", "left_semi"))
    layer, rows = _counted(every.join(edges, "node", "left_anti"))
    arrived = Parts(edges.select("node", F.col("needed").alias("n")).limit(0), lambda df: df.groupBy("node").agg(F.max("n").alias("n")))
    done = Parts(layer.limit(0).withColumn("level", F.lit(0)))
    depth = 0
    while rows:
        done.append(layer.withColumn("level", F.lit(depth)), rows)
        step = _light(layer.select(F.col("node").alias("requires")), rows)
        met = edges.join(step, "requires").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        if arrived.parts:
            before = arrived.table()
            if arrived.rows > SMALL_ROWS:
                met, rows = _counted(met)
                before = before.join(_light(met.select("node"), rows), "node", "left_semi")
            before = _light(before.groupBy("node").agg(F.max("n").alias("before")), arrived.rows)
            met = met.join(before, "node", "left").select("node", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), "needed")
        met, rows = _counted(met)
        layer = met.where("n = needed").select("node")
        open_rows = met.where("n < needed").count()
        arrived.append(met.where("n < needed").select("node", "n"), open_rows)
        rows, depth = rows - open_rows, depth + 1
    return every.join(done.table(), "node", "left")


def topological_order(levelled: DataFrame) -> DataFrame:
    """Order by level, then name; the unlevelled rest comes last, flagged."""
    return levelled.select("node", "level", F.col("level").isNull().alias("cyclic")).orderBy(
        F.col("level").asc_nulls_last(), "node"
    )


def cycle_core(edges: DataFrame) -> DataFrame:
    """Edges left after removing nodes without incoming or without outgoing edges again and again.

    ``edges`` has (src, dst). Every cycle lies in the core, and every core node lies on a cycle
    or on a path between cycles.
    """
    core, size = _counted(edges.select("src", "dst").distinct())
    while size:
        # an end of an edge has an edge on that side already; only the other side is asked for
        entered = _light(core.select(F.col("dst").alias("src")).distinct(), size)
        left = _light(core.select(F.col("src").alias("dst")).distinct(), size)
        core_next, rows = _counted(core.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))
        if rows == size:
            break
        core, size = core_next, rows
    return core


def _spread(start: DataFrame, edges: DataFrame, by: list[str], first: Column | None = None) -> DataFrame:
    """Smallest ``label`` of each node among all nodes with a path to it; ``start`` has (by, node, label).

    Only nodes whose label has fallen send it on, and each step appends the labels that fell. Where
    few nodes are to go ``first``, the others only send what is smaller than what has reached them.
    """
    best = Parts(start.limit(0), lambda df: df.groupBy(*by, "node").agg(F.min("label").alias("label")))
    if first is not None:
        _send(start.where(first), edges, by, best)
        reached = cut_lineage(best.table().groupBy(*by, "node").agg(F.min("label").alias("_old")))
        start = start.join(reached, [*by, "node"], "left").where("_old IS NULL OR label < _old").drop("_old")
    _send(start, edges, by, best)
    return best.table().groupBy(*by, "node").agg(F.min("label").alias("label"))


def _send(start: DataFrame, edges: DataFrame, by: list[str], best: Parts) -> None:
    news, rows = _counted(start)
    best.append(news, rows)
    while rows:
        step = _light(news.withColumnRenamed("node", "src"), rows)
        sent = edges.join(step, [*by, "src"]).groupBy(*by, F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        old, small = best.table(), best.rows <= SMALL_ROWS
        if not small:
            sent, rows = _counted(sent)
            old = old.join(_light(sent.select(*by, "node"), rows), [*by, "node"], "left_semi")
        old = old.groupBy(*by, "node").agg(F.min("label").alias("_old"))
        better = sent.join(_light(old, best.rows), [*by, "node"], "left").where("_old IS NULL OR label < _old")
        news, rows = _counted(better.select(*by, "node", "label"))
        best.append(news, rows)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that lies on a cycle of any length; ``edges`` has (src, dst).

    Two nodes are in one component when each has a path to the other; its name is its smallest node.
    Each round trims the graph to its core, colours every node with the smallest mark of a node that
    has a path to it, and walks back from each node that kept its own colour, inside that colour:
    what is met is its component. Components leave with their edges until the core is empty.
    Marks of whole numbers are their hashes, which are one-to-one, and the lowest few colour first:
    they settle large components before all other nodes send marks that would soon be overtaken.
    """
    whole = isinstance(edges.schema["src"].dataType, IntegralType) and isinstance(edges.schema["dst"].dataType, IntegralType)
    mark = F.xxhash64(F.col("node").cast("long")) if whole else F.col("node")
    low = F.col("label") < -(1 << 63) + (1 << 64) // FIRST_OF if whole else None
    every = cut_lineage(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    left, out = every, []
    while True:
        left = cycle_core(left)
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colours = cut_lineage(_spread(nodes.withColumn("label", mark), left, [], low))
        ends = colours.select(F.col("node").alias("src"), F.col("label").alias("colour"))
        inner = left.join(ends, "src").join(colours.select(F.col("node").alias("dst"), F.col("label").alias("colour")), ["dst", "colour"])
        # a walk back from the root is a walk along reversed edges
        back = cut_lineage(inner.select("colour", F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colours.where(F.col("label") == mark).select(F.col("label").alias("colour"), "node", "label")
        found = cut_lineage(_spread(roots, back, ["colour"]).select("node", "label"))
        names = cut_lineage(found.groupBy("label").agg(F.min("node").alias("component")))
        found = cut_lineage(found.join(names, "label").select("node", "component"))
        out.append(found)
        gone = found.select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(
            gone.withColumnRenamed("node", "dst"), "dst", "left_anti"
        )
    if not out:
        return every.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = _union(out)
    # a single node is a cycle only with an edge to itself
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    loops = every.where("src = dst").select(F.col("src").alias("component")).withColumn("_loop", F.lit(True))
    real = sizes.join(loops, "component", "left").where("_n > 1 OR _loop").select("component")
    return found.join(real, "component", "left_semi").select("node", "component")


def witness_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, position, node): a shortest cycle through the smallest node of each component.

    Breadth-first search from all those nodes at once keeps one parent per node met, the smallest;
    the first layer with an edge back to the start ends a component's search, and the cycle is read
    off the parents. The start stands at position 0, and the last node has an edge to it.
    """
    own = components.select(F.col("node").alias("src"), "component")
    inner = edges.select("src", "dst").distinct().join(own, "src").join(
        components.select(F.col("node").alias("dst"), "component"), ["dst", "component"]
    )
    inner = cut_lineage(inner.select("component", "src", "dst"))
    start = components.select("component", F.col("component").alias("node")).distinct()
    layer, rows = _counted(start.withColumns({"parent": F.lit(None).cast(start.schema["node"].dataType), "depth": F.lit(0)}))
    met, closed = Parts(layer.limit(0)), []
    while rows:
        met.append(layer, rows)
        step = _light(layer.select("component", F.col("node").alias("src"), "depth"), rows)
        onward = inner.join(step, ["component", "src"])
        ends, n_ends = _counted(onward.where("dst = component").groupBy("component").agg(F.min("src").alias("node"), F.min("depth").alias("position")))
        closed.append(ends)
        going = onward if not n_ends else onward.join(_light(ends.select("component"), n_ends), "component", "left_anti")
        found = going.groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("parent"), (F.min("depth") + 1).alias("depth"))
        layer, rows = _unmet(found, met, ["component", "node"])
    if not closed:
        return met.table().select("component", F.col("depth").alias("position"), "node")
    walk, rows = _counted(_union(closed).select("component", "position", "node"))
    path = Parts(walk.limit(0))
    while rows:
        path.append(walk, rows)
        step = _light(walk.where("position > 0"), rows)
        walk, rows = _counted(
            met.table().join(step, ["component", "node"]).select("component", (F.col("position") - 1).alias("position"), F.col("parent").alias("node"))
        )
    return path.table()


def cycles_up_to(edges: DataFrame, max_length: int) -> DataFrame:
    """All simple cycles of at most ``max_length`` nodes, each once, starting at its smallest node."""
    core = cycle_core(edges)
    paths = core.select("src", "dst").where("src <= dst").select(
        F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.col("dst").alias("last")
    )
    closed = paths.where("start = last").select("path")
    open_paths = paths.where("start < last")
    for _ in range(max_length - 1):
        grown = open_paths.join(core.withColumnRenamed("src", "last"), "last").select(
            "start", "path", F.col("dst").alias("last")
        )
        closed = closed.unionByName(
            grown.where("last = start").select(F.array_append("path", F.col("last")).alias("path"))
        )
        open_paths = cut_lineage(
            grown.where((F.col("last") > F.col("start")) & ~F.array_contains("path", F.col("last"))).select(
                "start", F.array_append("path", F.col("last")).alias("path"), "last"
            )
        )
    return closed


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long-form counts: nodes by type and domain, edges by type, cross-domain edges.

    ``nodes`` has (id, node_type, domain), ``edges`` has (src, dst, edge_type).
    """
    def counted(df: DataFrame, measure: str, key: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(measure).alias("measure"), "key", "n"
        )

    domains = nodes.select("id", "domain")
    src = domains.select(F.col("id").alias("src"), F.col("domain").alias("src_domain"))
    dst = domains.select(F.col("id").alias("dst"), F.col("domain").alias("dst_domain"))
    ends = edges.join(src, "src").join(dst, "dst")  # hubs are split by adaptive skew joins
    crossing = ends.where("src_domain <> dst_domain").withColumn("all", F.lit("all"))
    return (
        counted(nodes, "nodes_by_type", "node_type")
        .unionByName(counted(nodes, "nodes_by_domain", "domain"))
        .unionByName(counted(edges, "edges_by_type", "edge_type"))
        .unionByName(counted(crossing, "cross_domain_edges", "all"))
    )
