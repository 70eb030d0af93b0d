"""Compact forms of adjacency lists: gaps, references to an earlier list, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.graph import Graph


def adjacency_lists(g: Graph) -> DataFrame:
    """(id, neighbors): sorted neighbours along outgoing arcs; every vertex has a row."""
    lists = g.arcs().groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))
    return g.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def gap_encode(lists: DataFrame) -> DataFrame:
    """(id, gaps): the first neighbour less the vertex, then differences of neighbours."""
    n = F.col("neighbors")
    return lists.select("id", F.transform(n, lambda x, i: x - F.when(i > 0, F.get(n, i - 1)).otherwise(F.col("id"))).alias("gaps"))


def gap_decode(gaps: DataFrame) -> DataFrame:
    step = lambda acc, x: F.concat(acc, F.array(x + F.element_at(acc, -1)))
    return gaps.select("id", F.aggregate("gaps", F.array("id"), step, lambda acc: F.slice(acc, F.lit(2), F.size(acc))).alias("neighbors"))


def reference_encode(lists: DataFrame, window: int = 3) -> DataFrame:
    """(id, reference, mask, residual): against the one of the ``window`` vertices before that shares most neighbours.

    ``mask`` says for each neighbour of the reference whether it is left out;
    ``residual`` holds the vertex's other neighbours. Without shared neighbours the
    reference is null, the mask empty and the residual the whole list. Vertices
    count in order of id; the order is a window over ranks dealt in buckets.
    """
    from arcweave.plans.ordering import number_rows

    ranked = number_rows(lists.select("id", "neighbors"), F.col("id"))
    earlier = ranked.select(F.col("id").alias("reference"), F.col("neighbors").alias("theirs"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: F.col("position") + k)).alias("position"))
    both = ranked.join(earlier, "position", "left").withColumn("shared", F.coalesce(F.size(F.array_intersect("neighbors", "theirs")), F.lit(0)))
    best = F.row_number().over(Window.partitionBy("position").orderBy(F.desc("shared"), F.desc("reference")))
    chosen = both.withColumn("k", best).where("k = 1")
    used = F.col("shared") > 0
    return chosen.select(
        "id", F.when(used, F.col("reference")).alias("reference"),
        F.when(used, F.array_join(F.transform("theirs", lambda x: F.when(F.array_contains("neighbors", x), "0").otherwise("1")), "")).otherwise("").alias("mask"),
        F.when(used, F.array_except("neighbors", "theirs")).otherwise(F.col("neighbors")).alias("residual"),
    )


def reference_encode_pair(neighbors: Column, theirs: Column) -> Column:
    """(mask, residual) of one list against another."""
    return F.struct(F.array_join(F.transform(theirs, lambda x: F.when(F.array_contains(neighbors, x), "0").otherwise("1")), "").alias("mask"), F.array_except(neighbors, theirs).alias("residual"))


def reference_decode_pair(mask: Column, residual: Column, theirs: Column) -> Column:
    copied = F.filter(theirs, lambda x, i: F.substring(mask, i + 1, F.lit(1)) == "0")
    return F.sort_array(F.concat(copied, residual))


def interval_encode(lists: DataFrame, least: int = 3) -> DataFrame:
    """(id, intervals, residual): runs of ``least`` or more consecutive neighbours as (start, length less ``least``); the others."""
    n = F.col("neighbors")
    starts = F.filter(F.transform(n, lambda x, i: F.when((i == 0) | (F.get(n, i - 1) != x - 1), i)), lambda i: i.isNotNull())
    runs = F.transform(F.col("_s"), lambda i, k: F.struct(F.get(n, i).alias("start"), (F.coalesce(F.get(F.col("_s"), k + 1), F.size(n)) - i).cast("long").alias("n")))
    marked = lists.withColumn("_s", starts).withColumn("_r", runs)
    long_ = F.filter("_r", lambda r: r["n"] >= least)
    short = F.filter("_r", lambda r: r["n"] < least)
    return marked.select(
        "id", F.transform(long_, lambda r: F.struct(r["start"].alias("start"), (r["n"] - least).alias("extra"))).alias("intervals"),
        F.flatten(F.transform(short, lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))).alias("residual"),
    )


def interval_decode(encoded: DataFrame, least: int = 3) -> DataFrame:
    runs = F.flatten(F.transform("intervals", lambda r: F.sequence(r["start"], r["start"] + r["extra"] + least - 1)))
    return encoded.select("id", F.sort_array(F.concat(runs, F.col("residual"))).alias("neighbors"))
