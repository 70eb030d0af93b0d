"""The graph model: an edge table and the vertices it names.

``edges`` has ``src``, ``dst``, ``weight`` and ``ord`` (input order); a repeated
edge keeps the last weight and the first place. ``vertices`` has ``id`` and
``ord``, the order of first appearance, source before target. Undirected graphs
hold each edge once with ``src <= dst``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.lineage import materialize
from arcweave.plans.ordering import number_rows

#: Edges up to which an operator may work in one group in memory; beyond it the relational form runs, or an error says so.
KERNEL_MAX_EDGES = 2_000_000


class Graph:
    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> None:
        """``edges`` must be deduplicated; use :meth:`from_edges` otherwise."""
        self.edges = edges
        self.directed = directed
        self._vertices = vertices

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = True, keep: bool = True) -> Graph:
        """Builds from rows of src, dst and perhaps weight (else 0) and ord (else ranked by src, dst); of rows of one ord the largest weight stays.

        ``keep`` writes the deduplicated edges to the shared folder, as loops read them often.
        """
        names = edges.columns
        weight = F.col("weight").cast("double") if "weight" in names else F.lit(0.0)
        ord_ = F.col("ord").cast("long") if "ord" in names else F.lit(0).cast("long")
        src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
        rows = edges.select((src if directed else F.least(src, dst)).alias("src"), (dst if directed else F.greatest(src, dst)).alias("dst"), weight.alias("weight"), ord_.alias("ord"), (src > dst).alias("_turned"))
        rows = rows.groupBy("src", "dst").agg(F.max_by("weight", F.struct("ord", "weight")).alias("weight"), F.min("ord").alias("ord"), F.min_by("_turned", F.struct("ord", "_turned")).alias("_turned"))
        if "ord" not in names:
            rows = number_rows(rows.drop("ord"), F.col("src"), F.col("dst"), name="ord")
        if keep:
            rows = materialize(rows, "graph")
        # the end that stands first on the line where an edge first appears comes first
        first = F.when(F.lit(directed) | ~F.col("_turned"), F.col("src")).otherwise(F.col("dst"))
        second = F.when(F.lit(directed) | ~F.col("_turned"), F.col("dst")).otherwise(F.col("src"))
        ends = rows.select(first.alias("id"), (F.col("ord") * 2).alias("ord")).union(rows.select(second, F.col("ord") * 2 + 1))
        return cls(rows.select("src", "dst", "weight", "ord"), ends.groupBy("id").agg(F.min("ord").alias("ord")), directed)

    @cached_property
    def vertices(self) -> DataFrame:
        if self._vertices is not None:
            return self._vertices
        ends = self.edges.select(F.col("src").alias("id"), (F.col("ord") * 2).alias("ord")).union(self.edges.select("dst", F.col("ord") * 2 + 1))
        return ends.groupBy("id").agg(F.min("ord").alias("ord"))

    @cached_property
    def size(self) -> int:
        """Number of edges."""
        return self.edges.count()

    def small(self, limit: int | None = None) -> bool:
        return self.size <= (KERNEL_MAX_EDGES if limit is None else limit)

    def arcs(self) -> DataFrame:
        """Edges as they can be walked: an undirected edge both ways, a loop once."""
        if self.directed:
            return self.edges
        return self.edges.union(self.edges.where("src <> dst").select(F.col("dst"), F.col("src"), "weight", "ord"))

    def reverse(self) -> Graph:
        if not self.directed:
            return self
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "ord"), self.vertices)

    def undirected(self) -> Graph:
        """The same edges without direction; of two opposite arcs the later one's weight stays."""
        return Graph.from_edges(self.edges, directed=False) if self.directed else self

    def without_loops(self) -> Graph:
        return Graph(self.edges.where("src <> dst"), self.vertices, self.directed)

    def stats(self) -> DataFrame:
        """One row: n vertices and m edges."""
        n = self.vertices.agg(F.count(F.lit(1)).alias("n"))
        return n.crossJoin(self.edges.agg(F.count(F.lit(1)).alias("m")))

    def degrees(self, mode: str = "all") -> DataFrame:
        """(id, degree) of every vertex; ``mode`` out, in or all; a loop counts twice in all."""
        out, into = self.edges.select(F.col("src").alias("id")), self.edges.select(F.col("dst").alias("id"))
        ends = out.union(into) if mode == "all" or not self.directed else out if mode == "out" else into
        counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def neighbors(self, ids: DataFrame) -> DataFrame:
        """(id, neighbor, weight) along arcs out of ``ids``."""
        return ids.select("id").distinct().join(self.arcs(), F.col("id") == F.col("src")).select("id", F.col("dst").alias("neighbor"), "weight")

    def edge_weight(self, pairs: DataFrame) -> DataFrame:
        """src, dst and weight of the pairs that are edges."""
        return pairs.select("src", "dst").distinct().join(self.arcs().select("src", "dst", "weight"), ["src", "dst"])

    def require(self, *ids: int) -> None:
        """Raises ValueError for the first id that is no vertex."""
        wanted = dict.fromkeys(ids)
        known = {r[0] for r in self.vertices.where(F.col("id").isin(list(wanted))).select("id").collect()}
        for i in wanted:
            if i not in known:
                raise ValueError(f"vertex {i} is not in the graph")

    def max_degree_vertex(self) -> DataFrame:
        """The vertex of largest degree, the first to appear among equal ones."""
        return self.degrees().join(self.vertices, "id").orderBy(F.desc("degree"), "ord").limit(1).select("id", "degree")
