"""Shortest paths over non-negative weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.kernels import search
from arcweave.plans.kernels import on_graph
from arcweave.plans.lineage import materialize, partitioned

PATH = "step int, src long, dst long, cost double"


def _weighted(g: Graph, weight: str | Column | None) -> Graph:
    """The graph with an expression over its edge columns as weight; negative weights are an error."""
    if weight is not None:
        cost = F.expr(weight) if isinstance(weight, str) else weight
        g = Graph(g.edges.select("src", "dst", cost.cast("double").alias("weight"), "ord"), g.vertices, g.directed)
    if not g.edges.where("weight < 0").limit(1).isEmpty():
        raise ValueError("weights must not be negative")
    return g


def _arcs_of(rows: pd.DataFrame, both: bool) -> search.Arcs:
    return search.adjacency(rows.src.tolist(), rows.dst.tolist(), rows.weight.tolist(), rows.ord.tolist(), both)


LABELS = "id long, distance double, hops long"


def _step(labels: DataFrame, open_: DataFrame, arcs: DataFrame, best: float | None) -> DataFrame:
    """Labels after one round of relaxing the open ones; ``moved`` marks the better ones. Fewer hops break ties, so zero weights can't cycle."""
    near = F.struct((F.col("distance") + F.col("weight")).alias("distance"), (F.col("hops") + 1).alias("hops"))
    new = open_.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(near).alias("new"))
    if best is not None:
        new = new.where(F.col("new.distance") <= best)
    old = F.when(F.col("id").isNotNull(), F.struct("distance", "hops"))
    merged = labels.join(new, F.col("id") == F.col("dst"), "full").select(
        F.coalesce("id", "dst").alias("id"), F.least(old, F.col("new")).alias("label"), (F.col("new").isNotNull() & (old.isNull() | (F.col("new") < old))).alias("moved")
    )
    return materialize(merged.select("id", "label.distance", "label.hops", "moved"), "labels")


def _relaxed(g: Graph, source: int, bound: int | None = None) -> DataFrame:
    """(id, distance, hops) by rounds of relaxation; ``bound`` is a target whose label prunes longer ones."""
    arcs = partitioned(g.arcs().select("src", "dst", "weight"), "src")
    labels = open_ = g.edges.sparkSession.createDataFrame([(source, 0.0, 0)], LABELS)
    while True:
        best = None if bound is None else labels.where(F.col("id") == bound).agg(F.min("distance")).first()[0]
        merged = _step(labels, open_, arcs, best)
        labels, open_ = merged.select("id", "distance", "hops"), merged.where("moved").select("id", "distance", "hops")
        if open_.isEmpty():
            arcs.unpersist()
            return labels


def tight_parents(g: Graph, labels: DataFrame) -> DataFrame:
    """(id, distance, parent): of the arcs that give a distance, the one from the nearest vertex, ties to the largest id.

    With positive weights these are the parents that a binary-heap program finds;
    an arc of weight 0 counts only from a vertex with fewer hops.
    """
    arcs = g.arcs().select("src", "dst", "weight")
    near = labels.select(F.col("id").alias("src"), F.col("distance").alias("d"), F.col("hops").alias("h"))
    far = labels.select(F.col("id").alias("dst"), F.col("distance").alias("e"), F.col("hops").alias("k"))
    tight = arcs.join(near, "src").join(far, "dst").where("d + weight = e and (weight > 0 or h < k)").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", F.struct("d", -F.col("src"))).alias("parent"))
    return labels.join(tight, "id", "left").select("id", "distance", "parent")


def sssp(g: Graph, source: int, weight: str | Column | None = None, parents: bool = True, engine: str = "auto", self_parent: bool = False) -> DataFrame:
    """(id, distance, parent) of the vertices reachable from ``source``; its parent is null, or itself on request."""
    g = _weighted(g, weight)
    g.require(source)
    if engine == "kernel" or (engine == "auto" and g.small()):
        both = not g.directed

        def kernel(rows: pd.DataFrame) -> list[tuple]:
            distance, parent = search.dijkstra(_arcs_of(rows, both), source)
            return [(v, d, parent[v]) for v, d in distance.items()]

        out = on_graph(g, kernel, "id long, distance double, parent long")
    else:
        labels = _relaxed(g, source)
        out = tight_parents(g, labels) if parents else labels
    if self_parent and parents:
        out = out.withColumn("parent", F.when(F.col("id") == source, source).otherwise(F.col("parent")))
    return out if parents else out.select("id", "distance")


def st_path(g: Graph, source: int, target: int, method: str = "uni", weight: str | Column | None = None, heuristic: DataFrame | None = None, engine: str = "auto") -> DataFrame:
    """(step, src, dst, cost, distance): the arcs of a shortest path, with running distance; no rows if there is none.

    ``method``: from the source ("uni"), from both ends ("bi"), or guided by
    lower bounds of the distance to the target ("astar"): ``heuristic`` has id and
    bound, ids left out count 0. Only the kernel looks at bounds.
    """
    g = _weighted(g, weight)
    g.require(source, target)
    if method == "astar" and heuristic is not None:
        bound = heuristic.select(F.col("id").alias("_id"), F.col("bound").cast("double").alias("bound"))
        marked = g.edges
        for end in ("src", "dst"):
            marked = marked.join(bound.withColumnRenamed("bound", f"{end}_bound"), F.col(end) == F.col("_id"), "left").drop("_id")
        g = Graph(marked, g.vertices, g.directed)
    if engine == "kernel" or (engine == "auto" and g.small()):
        both = not g.directed

        def kernel(rows: pd.DataFrame) -> list[tuple]:
            arcs = _arcs_of(rows, both)
            if method == "bi":
                into = arcs if both else search.adjacency(rows.dst.tolist(), rows.src.tolist(), rows.weight.tolist(), rows.ord.tolist())
                found = search.two_sided(arcs, into, source, target) or []
            else:
                guess = None
                if "dst_bound" in rows:
                    known = {v: b for end in ("src", "dst") for v, b in zip(rows[end].tolist(), rows[f"{end}_bound"].tolist(), strict=True) if b == b}
                    guess = lambda v: known.get(v, 0.0)
                distance, parent = search.dijkstra(arcs, source, target, guess)
                found = search.path_arcs(arcs, parent, target) if target in distance else []
            return [(k, u, v, w) for k, (u, v, w) in enumerate(found)]

        path = on_graph(g, kernel, PATH)
    elif method == "bi":
        path = _two_sided(g, source, target)
    else:
        path = _walk(g, _relaxed(g, source, target), source, target)
    total = F.sum("cost").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    # a path has at most as many rows as a shortest path has arcs
    return path.withColumn("distance", total)


def st_cost(g: Graph, source: int, target: int, method: str = "uni", weight: str | Column | None = None, engine: str = "auto") -> DataFrame:
    """One row ``cost``: null if the target can't be reached, 0 from a vertex to itself."""
    path = st_path(g, source, target, method, weight, engine=engine)
    cost = F.sum("cost")
    return path.agg((F.lit(0.0) if source == target else cost).alias("cost"))


def _walk(g: Graph, labels: DataFrame, source: int, target: int) -> DataFrame:
    """Arcs (step, src, dst, cost) back from the target, each from a vertex one hop nearer; one narrow join a step."""
    arcs, rows, at = g.arcs().select("src", "dst", "weight"), [], target
    near = labels.select(F.col("id").alias("src"), F.col("distance").alias("d"), F.col("hops").alias("h"))
    end = labels.where(F.col("id") == target).select("distance", "hops").first()
    while end is not None and at != source:
        step = arcs.where(F.col("dst") == at).join(near, "src").where((F.col("d") + F.col("weight") == end[0]) & (F.col("h") == end[1] - 1)).orderBy("d", F.desc("src")).select("src", "weight", "d", "h").first()
        rows.append((step[0], at, step[1]))
        at, end = step[0], (step[2], step[3])
    return g.edges.sparkSession.createDataFrame([(k, u, v, w) for k, (u, v, w) in enumerate(reversed(rows))], PATH)


def _two_sided(g: Graph, source: int, target: int) -> DataFrame:
    """Rounds from the side with fewer open labels until no meeting point can improve."""
    spark = g.edges.sparkSession
    if source == target:
        return spark.createDataFrame([], PATH)
    graphs = [g, g.reverse()]
    sides = [partitioned(x.arcs().select("src", "dst", "weight"), "src") for x in graphs]
    labels = [spark.createDataFrame([(v, 0.0, 0)], LABELS) for v in (source, target)]
    open_ = list(labels)
    best = None
    while True:
        tops = [o.agg(F.count(F.lit(1)), F.min("distance")).first() for o in open_]
        if not tops[0][0] or not tops[1][0] or (best is not None and tops[0][1] + tops[1][1] >= best):
            break
        k = 0 if tops[0][0] <= tops[1][0] else 1
        merged = _step(labels[k], open_[k], sides[k], best)
        labels[k], open_[k] = merged.select("id", "distance", "hops"), merged.where("moved").select("id", "distance", "hops")
        best = labels[0].join(labels[1].select("id", F.col("distance").alias("back")), "id").agg(F.min(F.col("distance") + F.col("back"))).first()[0]
    for side in sides:
        side.unpersist()
    if best is None:
        return spark.createDataFrame([], PATH)
    middle = labels[0].join(labels[1].select("id", F.col("distance").alias("back")), "id").where(F.col("distance") + F.col("back") == best).agg(F.min("id")).first()[0]
    there = _walk(graphs[0], labels[0], source, middle)
    back = _walk(graphs[1], labels[1], target, middle)
    n = there.count()
    m = back.count()
    return there.union(back.select((F.lit(n + m - 1) - F.col("step")).cast("int"), F.col("dst"), F.col("src"), "cost"))
