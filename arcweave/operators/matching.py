"""Matchings and assignments in bipartite graphs. Edges run from left to right vertices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.kernels import flow as kernels
from arcweave.kernels import walks
from arcweave.kernels.arrays import Csr
from arcweave.operators.traversal import bipartition
from arcweave.plans.kernels import on_arcs, on_graph

FEASIBLE = 1e-8


def oriented(g: Graph) -> Graph:
    """The edges of an undirected bipartite graph from side 0 to side 1; raises ValueError on an odd cycle."""
    sides = bipartition(g)
    if not sides.where("not bipartite").limit(1).isEmpty():
        raise ValueError("the graph is not bipartite")
    zero = sides.where("side = 0").select("id")
    there = g.edges.join(zero, F.col("src") == F.col("id"), "left_semi")
    back = g.edges.join(zero, F.col("dst") == F.col("id"), "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "ord")
    return Graph.from_edges(there.union(back))


def unit_network(g: Graph) -> tuple[Graph, int, int]:
    """The flow network of a matching: a source before the left, a target after the right, all capacities 1.

    Left, right, source and target get new ids: 2v + 2, 2v + 3, 0 and 1.
    """
    left = g.edges.select((F.col("src") * 2 + 2).alias("id")).distinct()
    right = g.edges.select((F.col("dst") * 2 + 3).alias("id")).distinct()
    arcs = g.edges.select((F.col("src") * 2 + 2).alias("src"), (F.col("dst") * 2 + 3).alias("dst"))
    arcs = arcs.union(left.select(F.lit(0).cast("long"), "id")).union(right.select("id", F.lit(1).cast("long")))
    return Graph.from_edges(arcs.select("src", "dst", F.lit(1.0).alias("weight"))), 0, 1


def bipartite_matching(g: Graph, method: str = "hopcroft_karp") -> DataFrame:
    """(left, right) of a largest matching; "flow" reduces to a maximum flow, else Hopcroft and Karp; one task, without a limit of edges."""
    if method == "flow":
        from arcweave.operators.flow import max_flow

        network, s, t = unit_network(g)
        used = max_flow(network, s, t).where("flow > 0.5 and src <> 0 and dst <> 1")
        return used.select(((F.col("src") - 2) / 2).cast("long").alias("left"), ((F.col("dst") - 3) / 2).cast("long").alias("right"))
    # left and right may share ids
    doubled = g.edges.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))

    def kernel(n: Csr) -> list:
        partner = walks.hopcroft_karp(n)
        left = np.flatnonzero((partner >= 0) & (np.diff(n.start) > 0))
        return [n.ids[left] >> 1, n.ids[partner[left]] >> 1]

    return on_arcs(doubled, [F.col("src"), F.col("dst")], kernel, "left long, right long")


def matching_report(g: Graph, matching: DataFrame) -> DataFrame:
    """One row: pairs, vertices used twice, pairs that are no edge."""
    twice = matching.select(F.concat(F.lit("l"), F.col("left")).alias("v")).union(matching.select(F.concat(F.lit("r"), F.col("right")))).groupBy("v").count().where("count > 1")
    edges = g.edges.select(F.col("src").alias("left"), F.col("dst").alias("right"))
    foreign = matching.join(edges, ["left", "right"], "left_anti")
    return matching.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(twice.agg(F.count(F.lit(1)).alias("used_twice"))).crossJoin(foreign.agg(F.count(F.lit(1)).alias("not_an_edge")))


def _assigned(rows: pd.DataFrame, sense: str) -> tuple[list[tuple[int, int, float]], dict[int, float], dict[int, float]]:
    lefts, rights = sorted(set(rows.src.tolist())), sorted(set(rows.dst.tolist()))
    sign = -1.0 if sense == "max" else 1.0
    known = {(u, v): sign * w for u, v, w in zip(rows.src.tolist(), rows.dst.tolist(), rows.weight.tolist(), strict=True)}
    missing = 1 + 2 * len(lefts) * max([1.0, *(abs(w) for w in known.values())])
    flip = len(lefts) > len(rights)
    a, b = (rights, lefts) if flip else (lefts, rights)
    cost = [[known.get((y, x) if flip else (x, y), missing) for y in b] for x in a]
    columns, u, v = kernels.hungarian(cost)
    pairs = []
    for i, j in enumerate(columns):
        left, right = (b[j], a[i]) if flip else (a[i], b[j])
        if (left, right) not in known:
            raise ValueError("no assignment uses every vertex of the smaller side")
        pairs.append((left, right, sign * known[left, right]))
    rows_of, columns_of = dict(zip(a, u, strict=True)), dict(zip(b, v, strict=True))
    return sorted(pairs), (columns_of if flip else rows_of), (rows_of if flip else columns_of)


def assignment(g: Graph, sense: str = "min") -> DataFrame:
    """(left, right, cost): pairs of least (or largest) total weight that use the whole smaller side (Kuhn 1955), one vertex added at a time."""
    return on_graph(g, lambda rows: _assigned(rows, sense)[0], "left long, right long, cost double")


def assignment_labels(g: Graph, sense: str = "min") -> DataFrame:
    """(side, id, label): a certificate. left + right labels are at most the cost (negated for max) and add up to the total."""
    return on_graph(g, lambda rows: [(s, i, x) for s, labels in zip(("left", "right"), _assigned(rows, sense)[1:], strict=True) for i, x in sorted(labels.items())], "side string, id long, label double")


def certificate_report(g: Graph, matching: DataFrame, labels: DataFrame, sense: str = "min") -> DataFrame:
    """One row: total cost, sum of labels in the same sense, and edges whose labels exceed the cost."""
    sign = -1.0 if sense == "max" else 1.0
    left = labels.where("side = 'left'").select(F.col("id").alias("src"), F.col("label").alias("a"))
    right = labels.where("side = 'right'").select(F.col("id").alias("dst"), F.col("label").alias("b"))
    broken = g.edges.join(left, "src").join(right, "dst").agg(F.count_if(F.col("a") + F.col("b") > F.col("weight") * sign + FEASIBLE).alias("violations"))
    return matching.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).crossJoin(labels.agg((F.coalesce(F.sum("label"), F.lit(0.0)) * sign).alias("labels"))).crossJoin(broken)
