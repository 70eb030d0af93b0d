"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.lineage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u, the larger end of its edges, and its neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v); component is the smallest id.

    Each round is two joins and four aggregates over a shrinking edge set and is
    written to the shared folder; rounds grow with the logarithm of the vertices.
    Self-loops only name their vertex.
    """
    u, v = F.col("u"), F.col("v")
    given = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    alone, now = given.where(u == v).select(u.alias("id")), given.where(u != v)
    sign = F.struct(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
    seen = now.agg(sign).first()[0]
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = materialize(_small_star(_large_star(now)), "stars")
        new = now.agg(sign).first()[0]
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    linked = now.select(u.alias("id"), v.alias("component")).union(now.select(v.alias("id"), v.alias("component")).distinct())
    return linked.union(alone.distinct().join(linked, "id", "left_anti").select("id", F.col("id").alias("component")))
