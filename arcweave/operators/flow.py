"""Maximum flows, cuts and random cuts. ``weight`` is the capacity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.kernels import flow as kernels
from arcweave.kernels import walks
from arcweave.kernels.arrays import BLOCK, Csr
from arcweave.plans.kernels import on_arcs, on_components, on_graph
from arcweave.plans.lineage import materialize

METHODS = {"edmonds_karp": kernels.edmonds_karp, "ford_fulkerson": kernels.edmonds_karp, "dinitz": kernels.dinitz, "preflow": kernels.preflow}
ARRAYS = {"edmonds_karp": walks.edmonds_karp, "ford_fulkerson": walks.edmonds_karp, "dinitz": walks.dinitz, "preflow": walks.preflow}


def _check(g: Graph, s: int, t: int) -> None:
    if s == t:
        raise ValueError("source and target must differ")
    if not g.directed:
        raise ValueError("flows need a directed graph")
    g.require(s, t)
    if not g.edges.where("weight < 0").limit(1).isEmpty():
        raise ValueError("capacities must not be negative")


def max_flow(g: Graph, s: int, t: int, method: str = "dinitz", engine: str = "kernel") -> DataFrame:
    """(src, dst, capacity, flow) of a maximum flow from s to t.

    The relational engine augments along shortest residual paths (Edmonds and
    Karp) as joins; kernels run in one task, on compact adjacency without a limit of edges.
    """
    _check(g, s, t)
    if engine == "relational":
        return _augment(g, s, t)

    def kernel(n: Csr) -> Iterator[list]:
        r = walks.network(n)
        ARRAYS[method](r, n.find(s), n.find(t))
        for lo in range(0, len(n.to), BLOCK):
            at = slice(lo, lo + BLOCK)
            yield [n.ids[r.tail[at]], n.ids[n.to[at]], (r.room[at] + r.flow[at]).astype(float), r.flow[at].astype(float)]

    return on_arcs(g.edges.select("src", "dst", "weight"), [F.col("src"), F.col("dst")], kernel, "src long, dst long, capacity double, flow double", weighted=True)


def residual(flow: DataFrame) -> DataFrame:
    """(src, dst, weight): what can still be sent along each arc or back, where positive."""
    there = flow.select("src", "dst", (F.col("capacity") - F.col("flow")).alias("weight"))
    back = flow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flow").alias("weight"))
    return there.union(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")


def _augment(g: Graph, s: int, t: int) -> DataFrame:
    spark = g.edges.sparkSession
    flow = materialize(g.edges.select("src", "dst", F.col("weight").alias("capacity"), F.lit(0.0).alias("flow")), "flow")
    while True:
        open_ = materialize(residual(flow), "residual")
        near = tree = materialize(spark.createDataFrame([(s, None, None)], "id long, parent long, room double"), "near")
        while not near.isEmpty() and tree.where(F.col("id") == t).limit(1).isEmpty():
            step = near.select(F.col("id").alias("src")).join(open_, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.col("src").alias("parent"), F.col("weight").alias("room"))).alias("by"))
            near = materialize(step.join(tree.select("id"), "id", "left_anti").select("id", "by.parent", "by.room"), "near")
            tree = tree.union(near)
        path, at = [], t
        while at != s:  # one lookup a step; a path has as many as the search had levels
            row = tree.where(F.col("id") == at).first()
            if row is None:
                return flow
            path.append((row[1], at, row[2]))
            at = row[1]
        least = min(r for _, _, r in path)
        used = spark.createDataFrame([(u, v) for u, v, _ in path], "src long, dst long")
        # first against flow on the opposite arc, then along the arc
        there, back = used.withColumn("go", F.lit(True)), used.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("undo"))
        moved = flow.join(there, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
        twin = flow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flow").alias("opposite"))
        moved = moved.join(twin, ["src", "dst"], "left").na.fill(0.0, ["opposite"])
        up = F.when(F.col("go"), F.greatest(F.lit(0.0), F.lit(least) - F.col("opposite"))).otherwise(0.0)
        down = F.when(F.col("undo"), F.least(F.lit(least), F.col("flow"))).otherwise(0.0)
        flow = materialize(moved.select("src", "dst", "capacity", (F.col("flow") + up - down).alias("flow")), "flow")


def flow_report(flow: DataFrame, s: int, t: int) -> DataFrame:
    """One row: value, vertices that don't conserve, arcs out of bounds."""
    ends = flow.select(F.col("src").alias("id"), F.col("flow").alias("out"), F.lit(0.0).alias("into")).union(flow.select("dst", F.lit(0.0), "flow"))
    net = ends.groupBy("id").agg((F.sum("out") - F.sum("into")).alias("net"))
    value = net.agg(F.coalesce(F.sum(F.when(F.col("id") == s, F.col("net"))), F.lit(0.0)).alias("value"), F.count_if(~F.col("id").isin(s, t) & (F.abs("net") > 1e-8)).alias("unbalanced"))
    return value.crossJoin(flow.agg(F.count_if((F.col("flow") < 0) | (F.col("flow") > F.col("capacity"))).alias("out_of_bounds")))


def min_st_cut(g: Graph, s: int, t: int, method: str = "dinitz") -> DataFrame:
    """(id, side): 0 for what the residual network of a maximum flow reaches from s, else 1."""
    _check(g, s, t)

    def kernel(rows: pd.DataFrame) -> list[tuple]:
        arcs = list(zip(rows.src.tolist(), rows.dst.tolist(), rows.weight.tolist(), strict=True))
        network = kernels.Network(arcs)
        METHODS[method](network, s, t)
        reached = kernels.reachable(network, s)
        return [(v, int(v not in reached)) for v in sorted(network.out)]

    return on_graph(g, kernel, "id long, side int")


def cut_value(g: Graph, sides: DataFrame) -> DataFrame:
    """One row: weight from side 0 to side 1 (forward), back (backward), and both (total)."""
    a = sides.select(F.col("id").alias("src"), F.col("side").alias("a"))
    b = sides.select(F.col("id").alias("dst"), F.col("side").alias("b"))
    ends = g.edges.join(a, "src").join(b, "dst")
    part = lambda x, y: F.coalesce(F.sum(F.when((F.col("a") == x) & (F.col("b") == y), F.col("weight"))), F.lit(0.0))
    return ends.agg(part(0, 1).alias("forward"), part(1, 0).alias("backward"), (part(0, 1) + part(1, 0)).alias("total"))


def flow_across(flow: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: flow forward less flow back over a cut; the same for every cut between s and t."""
    a = sides.select(F.col("id").alias("src"), F.col("side").alias("a"))
    b = sides.select(F.col("id").alias("dst"), F.col("side").alias("b"))
    return flow.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.when(F.col("a") < F.col("b"), F.col("flow")).when(F.col("a") > F.col("b"), -F.col("flow"))), F.lit(0.0)).alias("across"))


def hash_digits(key: Column, seed: int) -> Column:
    """32 hexadecimal digits that depend on a key and a seed alone; equal in other engines."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def max_cut_random(g: Graph, seeds: int = 8) -> DataFrame:
    """(id, side, value): the best of several random halvings, sides by the first digit of a hash; value counts edges across."""
    side = lambda key, seed: F.when(F.substring(hash_digits(F.col(key), seed), 1, 1) < "8", 0).otherwise(1)
    # one scan counts for all seeds
    counts = g.edges.agg(*[F.count_if(side("src", k) != side("dst", k)) for k in range(seeds)]).first()
    best = max(range(seeds), key=lambda k: (counts[k], -k))
    return g.vertices.select("id", side("id", best).alias("side"), F.lit(counts[best]).cast("long").alias("value"))


def sampled_independent_set(g: Graph, seed: int = 0) -> DataFrame:
    """(id): vertices kept with probability 1 over the mean degree, less the larger end of each edge that is left."""
    simple = g.undirected().without_loops()
    n, m = g.stats().first()
    rate = min(1.0, n / (2 * m)) if m else 1.0
    drawn = F.conv(F.substring(hash_digits(F.col("id"), seed), 1, 8), 16, 10).cast("long") < int(rate * 2**32)
    kept = materialize(g.vertices.where(drawn).select("id"), "kept")
    inside = simple.edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.join(inside.select(F.greatest("src", "dst").alias("id")).distinct(), "id", "left_anti")


def min_cut(g: Graph, method: str = "karger", trials: int = 50, seed: int = 0) -> DataFrame:
    """(id, side, value): the best global cut of random contractions; 0 if the graph falls apart already.

    With several components the first one, by smallest id, is a side.
    """
    u = g.undirected().without_loops()
    solve = {"karger": kernels.karger, "karger_stein": kernels.karger_stein}[method]

    def kernel(rows: pd.DataFrame) -> list[tuple]:
        arcs = list(zip(rows.src.tolist(), rows.dst.tolist(), [w if w > 0 else 1.0 for w in rows.weight.tolist()], strict=True))
        vertices = sorted({v for a in arcs for v in a[:2]})
        value, side = solve(vertices, arcs, trials, seed)
        return [(v, int(v not in side), float(value), vertices[0]) for v in vertices]

    found = materialize(on_components(u, kernel, "id long, side int, value double, component long"), "cuts")
    names = found.select("component").distinct().orderBy("component").limit(2).collect()
    if len(names) < 2:
        return found.select("id", "side", "value")
    return found.select("id", (F.col("component") != names[0][0]).cast("int").alias("side"), F.lit(0.0).alias("value"))


def trials_for_cut(m: int, confidence: float = 0.99) -> int:
    """Halvings after which one with at least half of ``m`` edges across is found with this probability.

    One succeeds with probability 1 / (m / 2 + 1) or more.
    """
    from math import ceil, log

    p = 1 / (m / 2 + 1)
    return 1 if p >= confidence else ceil(log(1 - confidence) / log(1 - p))
