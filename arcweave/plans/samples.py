"""Graphs derived from the relational test tables, and the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.graph import Graph

#: ord of an edge: its place by (src, dst), without numbering rows.
ORD = "src * 4294967296 + dst"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, q): a line's part, the part of the order's next line, and the quantity."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(line).alias("dst"), F.col("l_quantity").alias("q"))
    return rows.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def part_seq(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """Parts that follow each other in an order; the weight is the smallest quantity."""
    edges = _follows(spark, sf_dir).groupBy("src", "dst").agg(F.min("q").alias("weight")).withColumn("ord", F.expr(ORD))
    return Graph.from_edges(edges, directed)


FOLLOWS_SQL = """seq AS (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst, l_quantity AS q FROM lineitem
)"""
PART_SEQ_SQL = f"""{FOLLOWS_SQL}, edges AS (
    SELECT src, dst, min(q) AS weight FROM seq WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst
)"""


def part_next(spark: SparkSession, sf_dir: str, directed: bool = True, k: int = 2) -> Graph:
    """From each part to the k parts that follow it with the most quantity in all, ties to the smaller id; the weight is that quantity.

    Sparse and deep where ``part_seq`` is dense and shallow.
    """
    sums = _follows(spark, sf_dir).groupBy("src", "dst").agg(F.sum("q").alias("weight"))
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    edges = sums.withColumn("k", best).where(F.col("k") <= k).select("src", "dst", "weight", F.expr(ORD).alias("ord"))
    return Graph.from_edges(edges, directed)


def part_next_sql(k: int = 2) -> str:
    return f"""{FOLLOWS_SQL}, edges AS (
    SELECT src, dst, sum(q) AS weight FROM seq WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY sum(q) DESC, dst) <= {k}
)"""


#: Edges both ways, each pair of opposite arcs once.
BOTH_SQL = "arcs AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def part_knn(spark: SparkSession, sf_dir: str, k: int = 3) -> Graph:
    """From each part to the k parts most often in the same orders, ties to the smaller id; the weight is that count."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src")).distinct()
    pairs = lines.join(lines.withColumnRenamed("src", "dst"), "l_orderkey").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    edges = pairs.withColumn("k", best).where(F.col("k") <= k).select("src", "dst", F.col("n").cast("double").alias("weight"), F.expr(ORD).alias("ord"))
    return Graph.from_edges(edges)


PART_KNN_SQL = """lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), pairs AS (
    SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2
), edges AS (
    SELECT src, dst, CAST(n AS DOUBLE) AS weight FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 3
)"""


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite: part p, as 2p, to supplier s, as 2s + 1."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    return Graph.from_edges(edges.select("src", "dst", F.expr(ORD).alias("ord")))


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """From the customer's nation to the supplier's; the weight is the number of lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = lines.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return Graph.from_edges(edges.withColumn("ord", F.expr(ORD)))


NATION_TRADE_SQL = """edges AS (
    SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
)"""
