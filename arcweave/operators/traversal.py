"""Reachability, components and connectivity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.kernels import search, walks
from arcweave.kernels.arrays import Csr
from arcweave.operators.components import component_labels
from arcweave.plans.kernels import on_arcs, on_components, on_graph
from arcweave.plans.lineage import materialize, partitioned
from arcweave.plans.ordering import number_rows

TREE = "id long, level int, parent long"
#: Levels after which the visited vertices are written as one table, so that plans stay short.
COMPACT = 16


def bfs(g: Graph, root: int = 0, parent: str = "id", max_levels: int | None = None, engine: str = "auto") -> DataFrame:
    """(id, level, parent) of the vertices reachable from ``root``; the root's parent is null.

    ``parent`` is the smallest neighbour one level up ("id"), or the first to
    discover the vertex when a queue takes arcs in input order ("queue").
    ``engine``: one kernel task for small graphs, otherwise a join a level;
    "compact" takes any graph in one task, as compact arrays, with parents by id.
    """
    g.require(root)
    if engine == "compact":
        if parent != "id":
            raise ValueError("compact search has parents by id only")

        def levels(n: Csr) -> list:
            reached, level, up = walks.bfs(n, n.find(root))
            near = level <= (n.size if max_levels is None else max_levels)
            return [n.ids[reached[near]], level[near], np.ma.masked_array(up[near], level[near] == 0)]

        return on_arcs(g.arcs().select("src", "dst"), [F.col("src"), F.col("dst")], levels, TREE)
    if engine == "kernel" or (engine == "auto" and g.small()):
        both = not g.directed

        def kernel(rows: pd.DataFrame) -> list[tuple]:
            arcs = search.adjacency(rows.src.tolist(), rows.dst.tolist(), rows.weight.tolist(), rows.ord.tolist(), both)
            found = search.bfs(arcs, root)
            if parent == "id":
                level = {v: d for v, d, _ in found}
                best: dict[int, int] = {}
                for u, out in arcs.items():
                    if u in level:
                        for v, _, _ in out:
                            if level[v] == level[u] + 1 and u < best.get(v, u + 1):
                                best[v] = u
                found = [(v, d, best.get(v)) for v, d, _ in found]
            return [x for x in found if max_levels is None or x[1] <= max_levels]

        return on_graph(g, kernel, TREE)
    arcs = partitioned(g.arcs(), "src")
    near = seen = g.edges.sparkSession.createDataFrame([(root, 0, None, 0)], "id long, level int, parent long, rank long")
    level = 0
    while max_levels is None or level < max_levels:
        level += 1
        via = F.min(F.struct("rank", "ord", F.col("near.id").alias("parent"))) if parent == "queue" else F.min("near.id")
        step = near.alias("near").join(arcs, F.col("near.id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(via.alias("via"))
        step = step.join(seen.select("id"), "id", "left_anti")
        if parent == "queue":
            step = number_rows(step.select("id", "via.rank", "via.ord", "via.parent"), F.col("rank"), F.col("ord"), F.col("parent"), name="place")
            step = step.select("id", F.lit(level).alias("level"), "parent", F.col("place").alias("rank"))
        else:
            step = step.select("id", F.lit(level).alias("level"), F.col("via").alias("parent"), F.lit(0).cast("long").alias("rank"))
        near = materialize(step, "level")
        if near.isEmpty():
            break
        seen = seen.union(near)
        if level % COMPACT == 0:
            seen = materialize(seen, "seen")
    arcs.unpersist()
    return seen.select("id", "level", "parent")


def dfs(g: Graph, root: int = 0) -> DataFrame:
    """(id, visit_order, tree_parent, last_in_neighbor) of a depth-first search that takes the latest arc first.

    Inherently sequential: one kernel over the graph, on compact adjacency without a limit of edges.
    ``last_in_neighbor`` is the last visited vertex with an arc to the row's.
    """
    g.require(root)
    order = [F.col("src"), F.col("ord"), *([F.col("dst")] if g.directed else [F.least("src", "dst"), F.greatest("src", "dst")])]

    def kernel(n: Csr) -> list:
        visits, parent, last = walks.dfs(n, n.find(root))
        return [n.ids[visits], np.arange(len(visits), dtype=np.int32), *[np.ma.masked_array(n.ids[x], x < 0) for x in (parent, last)]]

    return on_arcs(g.arcs().select("src", "dst", "ord"), order, kernel, "id long, visit_order int, tree_parent long, last_in_neighbor long")


def connected_components(g: Graph) -> DataFrame:
    """(id, component) without regard to direction; a component is named by its smallest id."""
    return component_labels(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def strongly_connected_components(g: Graph, max_rounds: int | None = None) -> DataFrame:
    """(id, component): the largest id that a vertex both reaches and is reached from names its component.

    Forward coloring with the largest id that reaches a vertex, then backward
    search from each color's own vertex inside the color; the found components
    leave and the rest goes on. Every round takes a vertex at least, and searches
    go on until nothing is new; ``max_rounds`` makes more rounds an error.
    """
    if not g.directed:
        return connected_components(g)
    spark = g.edges.sparkSession
    left, arcs = materialize(g.vertices.select("id"), "left"), g.edges.select("src", "dst").where("src <> dst")
    done = spark.createDataFrame([], "id long, component long")
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        # vertices without an arc in or out are components of their own
        alive = left.join(arcs.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(arcs.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        alive = materialize(alive, "alive")
        single = left.join(alive, "id", "left_anti").select("id", F.col("id").alias("component"))
        done = materialize(done.union(single), "done")
        if alive.isEmpty():
            return done
        ids = alive.select("id")
        arcs = materialize(arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "arcs")
        if single.isEmpty():
            color = _spread_largest(ids, arcs)
            inside = arcs.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b")
            inside = materialize(inside.select("src", "dst"), "inside")
            near = materialize(color.where("id = color").select("id", "color"), "near")
            found = near
            level = 0
            while True:
                level += 1
                step = near.join(inside, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "color").distinct().join(found, "id", "left_anti")
                near = materialize(step, "near")
                if near.isEmpty():
                    break
                found = found.union(near)
                if level % COMPACT == 0:
                    found = materialize(found, "found")
            done = done.union(found.select("id", F.col("color").alias("component")))
            alive = alive.join(found, "id", "left_anti")
        left = materialize(alive, "left")
    raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")


def _spread_largest(ids: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, color): the largest id from which each vertex can be reached."""
    color = materialize(ids.select("id", F.col("id").alias("color")), "color")
    changed = color
    while True:
        step = changed.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.max("color").alias("new"))
        merged = color.join(step, F.col("id") == F.col("dst"), "left").select("id", F.greatest("color", F.coalesce("new", "color")).alias("color"), (F.coalesce("new", "color") > F.col("color")).alias("moved"))
        merged = materialize(merged, "color")
        color, changed = merged.select("id", "color"), merged.where("moved").select("id", "color")
        if changed.isEmpty():
            return color


def bipartition(g: Graph) -> DataFrame:
    """(id, side, component, bipartite): the smallest vertex of a component is on side 0; a component with an odd cycle has null sides.

    Components of the double cover, whose vertices are (id, side) and whose edges
    change sides: a component is bipartite if its two copies stay apart. Rounds
    grow with the logarithm of the vertices, whatever the distances. Ids must fit
    62 bits, as a copy is numbered ``2 * id + side``.
    """
    u, v = F.col("src") * 2, F.col("dst") * 2
    cover = g.edges.select(u.alias("u"), (v + 1).alias("v")).union(g.edges.select((u + 1).alias("u"), v.alias("v")))
    alone = g.vertices.select((F.col("id") * 2).alias("u"), (F.col("id") * 2).alias("v"))
    labels = component_labels(cover.union(alone).union(alone.select(F.col("u") + 1, F.col("v") + 1)))
    ends = labels.groupBy(F.shiftright("id", 1).alias("id")).agg(F.min_by("component", "id").alias("a"), F.max_by("component", "id").alias("b"))
    bipartite = F.col("a") != F.col("b")
    return ends.select("id", F.when(bipartite, (F.col("a") % 2).cast("int")).alias("side"), F.shiftright("a", 1).alias("component"), bipartite.alias("bipartite"))


def is_bipartite(g: Graph) -> DataFrame:
    """(component, bipartite)."""
    return bipartition(g).select("component", "bipartite").distinct()


def _undirected_arcs(rows: pd.DataFrame) -> search.Arcs:
    return search.adjacency(rows.src.tolist(), rows.dst.tolist(), rows.weight.tolist(), rows.ord.tolist(), True)


def _renamed_ords(rows: pd.DataFrame) -> pd.DataFrame:
    """Every edge its own ord, so parallel edges are told apart."""
    return rows.assign(ord=range(len(rows)))


def articulation_points(g: Graph) -> DataFrame:
    """(id) of the vertices whose removal disconnects their component."""
    return on_components(g.undirected(), lambda rows: [(v,) for v in sorted(search.lowpoints(_undirected_arcs(_renamed_ords(rows)))[0])], "id long")


def biconnected_components(g: Graph) -> DataFrame:
    """(src, dst, block): edges by block; a block is named by its smallest edge, as text ``src-dst``."""

    def kernel(rows: pd.DataFrame) -> list[tuple]:
        out = []
        for block in search.lowpoints(_undirected_arcs(_renamed_ords(rows)))[2]:
            edges = sorted({(min(e), max(e)) for e in block})
            out += [(u, v, f"{edges[0][0]}-{edges[0][1]}") for u, v in edges]
        return out

    return on_components(g.undirected(), kernel, "src long, dst long, block string")


def bridges(g: Graph, engine: str = "auto") -> DataFrame:
    """(src, dst), src < dst: edges whose removal disconnects their component.

    The relational engine works on a spanning forest level by level: subtree
    sizes and preorder numbers, then the smallest and largest number that a
    subtree's other edges reach; a tree edge is a bridge if they stay inside.
    """
    u = g.undirected()
    if engine == "kernel" or (engine == "auto" and u.small()):
        return on_components(u, lambda rows: sorted(search.lowpoints(_undirected_arcs(_renamed_ords(rows)))[1]), "src long, dst long")
    return _relational_bridges(u)


def _relational_bridges(u: Graph) -> DataFrame:
    arcs = u.arcs().select("src", "dst").where("src <> dst")
    labels = materialize(connected_components(u), "labels")
    near = tree = materialize(labels.where("id = component").select("id", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("level")), "near")
    depth = 0
    while True:
        step = near.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent")).join(tree.select("id"), F.col("dst") == F.col("id"), "left_anti")
        near = materialize(step.select(F.col("dst").alias("id"), "parent", F.lit(depth + 1).alias("level")), "near")
        if near.isEmpty():
            break
        tree = tree.union(near)
        depth += 1
        if depth % COMPACT == 0:
            tree = materialize(tree, "tree")
    tree = materialize(tree, "tree")
    # subtree sizes, bottom up
    sizes = {depth: materialize(tree.where(F.col("level") == depth).select("id", "parent", F.lit(1).cast("long").alias("size")), "size")}
    for level in range(depth - 1, -1, -1):
        below = sizes[level + 1].groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("below"))
        sizes[level] = materialize(tree.where(F.col("level") == level).join(below, "id", "left").select("id", "parent", (1 + F.coalesce("below", F.lit(0))).alias("size")), "size")
    # preorder numbers, top down; each component counts from 0
    numbers = {0: sizes[0].select("id", "parent", "size", F.lit(0).cast("long").alias("num"))}
    before = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, depth + 1):
        placed = sizes[level].withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0)))
        numbers[level] = materialize(placed.join(numbers[level - 1].select(F.col("id").alias("parent"), F.col("num").alias("up")), "parent").select("id", "parent", "size", (F.col("up") + 1 + F.col("skip")).alias("num")), "num")
    every = numbers[0]
    for level in range(1, depth + 1):
        every = every.union(numbers[level])
        if level % COMPACT == 0:
            every = materialize(every, "numbered")
    every = materialize(every, "numbered")
    num = every.select("id", "num", "parent")
    other = arcs.join(num.select(F.col("id").alias("src"), F.col("parent").alias("p")), "src").join(num.select(F.col("id").alias("dst"), F.col("num").alias("to"), F.col("parent").alias("q")), "dst")
    other = other.where("not (p <=> dst) and not (q <=> src)").groupBy(F.col("src").alias("id")).agg(F.min("to").alias("l"), F.max("to").alias("h"))
    own = every.join(other, "id", "left").select("id", "parent", "size", "num", F.least("num", F.coalesce("l", "num")).alias("l"), F.greatest("num", F.coalesce("h", "num")).alias("h"))
    own = materialize(own.join(tree.select("id", "level"), "id"), "own")
    reach = materialize(own.where(F.col("level") == depth), "reach")
    all_ = reach
    for level in range(depth - 1, -1, -1):
        below = reach.groupBy(F.col("parent").alias("id")).agg(F.min("l").alias("bl"), F.max("h").alias("bh"))
        reach = materialize(own.where(F.col("level") == level).join(below, "id", "left").select("id", "parent", "size", "num", F.least("l", F.coalesce("bl", "l")).alias("l"), F.greatest("h", F.coalesce("bh", "h")).alias("h"), "level"), "reach")
        all_ = all_.union(reach)
        if level % COMPACT == 0:
            all_ = materialize(all_, "reach")
    found = all_.where("parent is not null and l = num and h < num + size")
    return found.select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))


def two_edge_components(g: Graph) -> DataFrame:
    """(id, component): components after the bridges are taken away."""
    u = g.undirected()
    cut = bridges(u)
    rest = u.edges.join(cut, ["src", "dst"], "left_anti").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return component_labels(rest.union(u.vertices.select(F.col("id").alias("u"), F.col("id").alias("v"))))
