"""Running a sequential kernel on a whole small graph or on each component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.graph import KERNEL_MAX_EDGES, Graph
from arcweave.kernels.arrays import Arcs, Csr


def on_graph(g: Graph, kernel: Callable[[pd.DataFrame], list[tuple]], schema: str, limit: int | None = None) -> DataFrame:
    """``kernel`` gets all edges (src, dst, weight, ord) in one task and returns rows; raises beyond ``limit`` edges."""
    if not g.small(limit):
        raise ValueError(f"this operator works on at most {limit or KERNEL_MAX_EDGES} edges in one group; the graph has {g.size}")
    return _grouped(g.edges.withColumn("_group", F.lit(0)), kernel, schema, limit)


def on_components(g: Graph, kernel: Callable[[pd.DataFrame], list[tuple]], schema: str, limit: int | None = None) -> DataFrame:
    """``kernel`` gets the edges of one connected component, and the ranks of their ends, at a time; a group over ``limit`` is an error."""
    from arcweave.operators.traversal import connected_components

    labels = connected_components(g)
    ranks = g.vertices.select("id", F.col("ord").alias("_rank"))
    edges = g.edges.join(labels.select(F.col("id").alias("src"), F.col("component").alias("_group")), "src")
    edges = edges.join(ranks.select(F.col("id").alias("src"), F.col("_rank").alias("src_rank")), "src").join(ranks.select(F.col("id").alias("dst"), F.col("_rank").alias("dst_rank")), "dst")
    return _grouped(edges, kernel, schema, limit)


def _grouped(edges: DataFrame, kernel: Callable[[pd.DataFrame], list[tuple]], schema: str, limit: int | None) -> DataFrame:
    most = KERNEL_MAX_EDGES if limit is None else limit
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"this operator works on at most {most} edges in one component, not {len(rows)}")
        found = kernel(rows.sort_values("ord", kind="stable"))
        # objects, so that integers beside nulls don't become floats
        return pd.DataFrame({n: pd.Series([x[k] for x in found], dtype=object) for k, n in enumerate(names)})

    return edges.groupBy("_group").applyInPandas(run, schema)


def on_arcs(arcs: DataFrame, order: list[Column], kernel: Callable[[Csr], list | Iterator[list]], schema: str, weighted: bool = False, groups: bool = False) -> DataFrame:
    """``kernel`` gets all arcs (src, dst, perhaps weight) as :class:`Csr`, or those of one ``_group`` at a time, and returns a column for each name of ``schema``, or yields such lists.

    Arcs arrive in Arrow batches ordered by ``order``, whose first key but for
    ties must be the source, and take 4 bytes each (and their weight 1 to 8), so
    a group has no limit but one task's memory.
    """
    keys = [*(["_group"] if groups else []), *order]
    dealt = arcs.repartition("_group") if groups else arcs.withColumn("_group", F.lit(0)).repartition(1)
    names = ["src", "dst", *(["weight"] if weighted else [])]
    types = [(c.strip().split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.strip().split()[1]]) for c in schema.split(",")]

    def solved(held: Arcs) -> Iterator[pa.RecordBatch]:
        found = kernel(held.close())
        for columns in [found] if isinstance(found, list) else found:
            for lo in range(0, len(columns[0]), 1 << 18):
                part = [c[lo : lo + (1 << 18)] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.ma.getdata(c), t, mask=np.ma.getmaskarray(c) if np.ma.isMaskedArray(c) else None, safe=False) for c, (_, t) in zip(part, types, strict=True)], [n for n, _ in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group_of, *columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("_group", *names)]
            cuts = [0, *(np.flatnonzero(group_of[1:] != group_of[:-1]) + 1).tolist(), len(group_of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held is None or group_of[lo] != group:
                    if held is not None:
                        yield from solved(held)
                    group, held = group_of[lo], Arcs()
                held.add(*[c[lo:hi] for c in columns])
        if held is not None:
            yield from solved(held)

    return dealt.sortWithinPartitions(*keys).select("_group", *names).mapInArrow(run, schema)


def on_neighbours(g: Graph, kernel: Callable[[Csr], list], schema: str) -> DataFrame:
    """``kernel`` gets a connected component of an undirected graph at a time, without loops, vertices numbered by their order of appearance."""
    from arcweave.operators.traversal import connected_components

    named = connected_components(g).join(g.vertices.select("id", F.col("ord").alias("_rank")), "id").select(F.col("id").alias("src"), F.col("component").alias("_group"), "_rank")
    arcs = g.arcs().select("src", "dst").join(named, "src")
    return on_arcs(arcs, [F.col("_rank"), F.col("src")], lambda n: kernel(n.without_loops()), schema, groups=True)
