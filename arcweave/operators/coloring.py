"""Vertex coloring and independent sets of undirected graphs; loops are left out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.kernels import classes, walks
from arcweave.kernels import coloring as kernels
from arcweave.kernels.arrays import Csr, spread
from arcweave.plans.kernels import on_components, on_neighbours
from arcweave.plans.lineage import materialize

COLORING = "id long, color int"


def _simple(g: Graph) -> Graph:
    return g.undirected().without_loops()


def _arcs(g: Graph) -> DataFrame:
    return g.arcs().select("src", "dst")


def first_free(used: Column) -> Column:
    """The smallest integer from 0 that is not in an array."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))


def greedy_by_rank(g: Graph, ranked: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(id, color): greedy in the order of ``ranked`` (id, rank...), in rounds.

    A vertex is colored once all neighbours of higher priority are, with the
    first free color; the result is that of the sequential order (Jones and
    Plassmann 1993). Rounds are the longest chain of falling priority.
    """
    keys = [c for c in ranked.columns if c != "id"]
    rank = ranked.select("id", F.struct(*keys, "id").alias("r"))
    arcs = _arcs(g).join(rank.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src").join(rank.select(F.col("id").alias("dst"), F.col("r").alias("rd")), "dst")
    # dst waits for src
    waits = materialize(arcs.where("rs < rd").select("src", "dst"), "waits")
    left = materialize(rank.select("id").join(waits.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("due")), "id", "left").select("id", F.coalesce("due", F.lit(0)).alias("due"), F.array().cast("array<int>").alias("used")), "left")
    done = None
    for _ in range(max_rounds):
        ready = materialize(left.where("due = 0").select("id", first_free(F.col("used")).cast("int").alias("color")), "ready")
        if ready.isEmpty():
            return done if done is not None else left.select("id", F.lit(0).alias("color")).limit(0)
        done = ready if done is None else done.union(ready)
        told = ready.join(waits, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("_dst")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("color").alias("new"))
        left = left.where("due > 0").join(told, F.col("id") == F.col("_dst"), "left")
        left = materialize(left.select("id", (F.col("due") - F.coalesce("n", F.lit(0))).alias("due"), F.array_union("used", F.coalesce("new", F.array().cast("array<int>"))).alias("used")), "left")
    raise RuntimeError(f"coloring did not end in {max_rounds} rounds")


def ranked_vertices(g: Graph, by_degree: bool) -> DataFrame:
    """Priorities: order of appearance, or largest degree first."""
    vertices = g.vertices.select("id", "ord")
    if not by_degree:
        return vertices
    return vertices.join(_simple(g).degrees(), "id").select("id", (-F.col("degree")).alias("minus"), "ord")


def maximal_independent_set(g: Graph, seed_vertex: int | None = None, seed: int = 0) -> DataFrame:
    """(id): a maximal independent set, with ``seed_vertex`` if given; priorities are hashes of a seed."""
    simple = _simple(g)
    arcs = materialize(_arcs(simple), "arcs")
    draw = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    first = F.when(F.col("id") == seed_vertex, 0).otherwise(1) if seed_vertex is not None else F.lit(1)
    left = materialize(g.vertices.select("id", F.struct(first, draw, "id").alias("r")), "left")
    chosen = None
    while not left.isEmpty():
        live = arcs.join(left.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src").join(left.select(F.col("id").alias("dst"), F.col("r").alias("rd")), "dst")
        beaten = live.where("rd < rs").select(F.col("src").alias("id")).distinct()
        new = materialize(left.join(beaten, "id", "left_anti").select("id"), "chosen")
        chosen = new if chosen is None else chosen.union(new)
        beside = arcs.join(new, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).union(new).distinct()
        left = materialize(left.join(beside, "id", "left_anti"), "left")
    return chosen if chosen is not None else left.select("id")


def color_by_sets(g: Graph, seed: int = 0) -> DataFrame:
    """One color for each of a row of maximal independent sets, each around a vertex of largest degree."""
    left, color, done = _simple(g), 0, None
    rest = materialize(g.vertices.select("id", "ord"), "rest")
    while not rest.isEmpty():
        now = Graph(left.edges, rest, False)
        top = now.max_degree_vertex().first()[0]
        members = materialize(maximal_independent_set(now, top, seed + color).select("id", F.lit(color).alias("color")), "set")
        done = members if done is None else done.union(members)
        rest = materialize(rest.join(members, "id", "left_anti"), "rest")
        gone = members.select("id")
        edges = left.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = Graph(materialize(edges.select("src", "dst", "weight", "ord"), "edges"), rest, False)
        color += 1
    return done if done is not None else rest.select("id", F.lit(0).alias("color"))


def iterated_greedy(g: Graph, rounds: int = 3, order: str = "largest", seed: int = 0) -> DataFrame:
    """Greedy repeated with whole classes as the order: "largest" first, "reverse" or "random"."""
    simple = _simple(g)
    now = materialize(greedy_by_rank(simple, ranked_vertices(g, False)), "coloring")
    for k in range(rounds):
        size = F.count(F.lit(1)).over(Window.partitionBy("color"))
        rank = {"largest": -size, "reverse": -F.col("color"), "random": F.md5(F.concat_ws(":", F.col("color").cast("string"), F.lit(f"{seed}:{k}")))}[order]
        now = materialize(greedy_by_rank(simple, now.select("id", rank.alias("class"), "color").select("id", "class", "color")), "coloring")
    return now


def _neighbours(rows: pd.DataFrame) -> tuple[kernels.Neighbours, dict[int, int]]:
    g: kernels.Neighbours = {}
    rank: dict[int, tuple[int, int]] = {}
    for u, v, ru, rv in zip(rows.src.tolist(), rows.dst.tolist(), rows.src_rank.tolist(), rows.dst_rank.tolist(), strict=True):
        rank[u], rank[v] = (ru, u), (rv, v)
        g.setdefault(u, set())
        g.setdefault(v, set())
        if u != v:
            g[u].add(v)
            g[v].add(u)
    return g, {v: k for k, v in enumerate(sorted(rank, key=rank.__getitem__))}


def _by_kernel(g: Graph, solve: Callable[[kernels.Neighbours, dict[int, int]], dict[int, int]], limit: int | None = None) -> DataFrame:
    return on_components(g.undirected(), lambda rows: sorted(solve(*_neighbours(rows)).items()), COLORING, limit)


def _by_arrays(g: Graph, solve: Callable[[Csr], list[int] | np.ndarray]) -> DataFrame:
    return on_neighbours(g.undirected(), lambda n: [n.ids, np.array(solve(n), dtype=np.int32)], COLORING)


def color(g: Graph, method: str = "greedy", seed: int = 0) -> DataFrame:
    """(id, color) by a named method; colors count from 0.

    greedy, welsh_powell, sets (also mis) and iterated run as joins; dsatur,
    dsatur_heap, dsatur_recompute, rlf, anneal, anneal_partial, tabu, ants and
    exact run a kernel for each connected component, all but the last two on
    compact adjacency without a limit of edges.
    """
    if method == "greedy":
        return greedy_by_rank(_simple(g), ranked_vertices(g, False))
    if method == "welsh_powell":
        return greedy_by_rank(_simple(g), ranked_vertices(g, True))
    if method in ("sets", "mis"):
        return color_by_sets(g, seed)
    if method == "iterated":
        return iterated_greedy(g, seed=seed)
    arrays: dict[str, Callable[[Csr], list[int]]] = {
        "dsatur": classes.dsatur,
        "dsatur_heap": classes.dsatur,
        "dsatur_recompute": lambda n: classes.dsatur(n, False),
        "rlf": classes.rlf,
        "anneal": lambda n: classes.anneal(n, seed),
        "anneal_partial": lambda n: classes.anneal(n, seed, partial=True),
        "tabu": lambda n: classes.tabu(n, seed),
    }
    if method in arrays:
        return _by_arrays(g, arrays[method])
    solvers: dict[str, Callable] = {"ants": lambda n, r: kernels.ants(n, r, seed), "exact": kernels.exact}
    return _by_kernel(g, solvers[method])


def coloring_report(g: Graph, coloring: DataFrame) -> DataFrame:
    """One row: colors_used, whether they are 0 to k-1, edges between equal colors, and uncolored vertices."""
    colors = coloring.select("id", "color")
    ends = _simple(g).edges.join(colors.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst")
    used = colors.agg(F.countDistinct("color").alias("colors_used"), (F.coalesce(F.max("color") + 1, F.lit(0)) == F.countDistinct("color")).alias("contiguous"))
    bad = ends.agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))
    missing = g.vertices.join(colors, "id", "left_anti").agg(F.count(F.lit(1)).alias("uncolored"))
    return used.crossJoin(bad).crossJoin(missing)


def dominated_vertices(g: Graph) -> DataFrame:
    """(id, by): vertices whose neighbours are all neighbours of a vertex not next to them, which can give them its color.

    The neighbourhood test is a count of shared neighbours over two-step walks.
    """
    arcs = _arcs(_simple(g))
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    shared = arcs.select(F.col("src").alias("id"), F.col("dst").alias("m")).join(arcs.select(F.col("src").alias("by"), F.col("dst").alias("m")), "m").where("id <> by").groupBy("id", "by").agg(F.count(F.lit(1)).alias("n"))
    inside = shared.join(degree, "id").where("n = degree").join(arcs.select(F.col("src").alias("id"), F.col("dst").alias("by")), ["id", "by"], "left_anti")
    return inside.groupBy("id").agg(F.min("by").alias("by"))


def universal_vertices(g: Graph) -> DataFrame:
    """(id): vertices next to all others."""
    n = g.vertices.agg(F.count(F.lit(1)).alias("n"))
    return _simple(g).degrees().crossJoin(n).where("degree = n - 1").select("id")


def color_by_blocks(g: Graph, method: Callable[[Csr], list[int]] = classes.dsatur) -> DataFrame:
    """(id, color): blocks between articulation points are colored apart and their colors exchanged to agree at the points."""

    def solve(n: Csr) -> np.ndarray:
        colors, place = np.full(n.size, -1, np.int32), np.full(n.size, -1, np.int32)
        for block in walks.blocks(n):
            block.sort()
            place[block] = np.arange(len(block))
            degree, to = np.zeros(len(block), np.int64), []
            for tail, at in spread(n.start, block):
                u = place[n.to[at]]
                degree += np.bincount(place[tail[u >= 0]], minlength=len(block))
                to.append(u[u >= 0])
            own = np.array(method(Csr(n.ids[block], np.r_[0, np.cumsum(degree)], np.concatenate(to))), dtype=np.int32)
            place[block] = -1
            fixed = np.flatnonzero(colors[block] >= 0)
            if len(fixed):  # one at most: blocks come along a tree
                a, b = own[fixed[0]], colors[block[fixed[0]]]
                own = np.where(own == a, b, np.where(own == b, a, own))
            colors[block] = own
        return colors

    return _by_arrays(g, solve)


def clique_bound(g: Graph) -> DataFrame:
    """One row: the largest clique size found among 1 to 4, a lower bound of the number of colors."""
    simple = _simple(g)
    rank = simple.degrees()
    arcs = simple.edges.select("src", "dst").join(rank.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(rank.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    # each edge from the end of smaller degree, so no vertex has many arcs out
    low = F.struct("ds", "src") < F.struct("dd", "dst")
    arcs = materialize(arcs.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("v")), "arcs")
    triangles = arcs.join(arcs.select("u", F.col("v").alias("w")), "u").join(arcs.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"]).select("u", "v", "w")
    triangles = materialize(triangles, "triangles")
    x = arcs.select("u", F.col("v").alias("x"))
    fours = triangles.join(x, "u").join(arcs.select(F.col("u").alias("v"), F.col("v").alias("x")), ["v", "x"]).join(arcs.select(F.col("u").alias("w"), F.col("v").alias("x")), ["w", "x"])
    sizes = g.vertices.select(F.lit(1).alias("k")).union(arcs.select(F.lit(2))).union(triangles.select(F.lit(3))).union(fours.select(F.lit(4)))
    return sizes.agg(F.coalesce(F.max("k"), F.lit(0)).alias("clique"))
