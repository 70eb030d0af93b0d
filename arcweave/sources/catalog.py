"""Catalogs of datasets and programs, and the runs that fit together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a dataset catalog, and the kinds of problems a dataset is marked for.
DATASETS = "graph string, Nodes long, Edges long, Directed int, Weighted int, ext string, url string, Description string, Origin string, Website string, exe string, connectivity int, coloring int, flow int, shortest int, source long, target long"
PROGRAMS = "name string, exe string, problem string, directed array<int>, weighted array<int>"
PROBLEMS = ("connectivity", "coloring", "flow", "shortest")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row a dataset; empty cells are null."""
    return spark.read.csv(path, header=True, schema=DATASETS, mode="FAILFAST")


def programs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PROGRAMS)


def plan_runs(datasets: DataFrame, progs: DataFrame) -> DataFrame:
    """(graph, program, file, source, target): pairs whose direction and weights fit and where the dataset is marked for the problem."""
    marked = F.explode(F.array(*[F.when(F.col(p) == 1, F.lit(p)) for p in PROBLEMS]))
    wanted = datasets.select("*", marked.alias("problem"))
    takes = progs.select(F.col("name").alias("program"), "problem", F.explode(F.array_distinct("directed")).alias("Directed"), "weighted")
    takes = takes.select("program", "problem", "Directed", F.explode(F.array_distinct("weighted")).alias("Weighted"))
    return wanted.join(takes, ["problem", "Directed", "Weighted"]).select("graph", "program", F.concat("graph", F.lit("."), "ext", F.lit(".gz")).alias("file"), "source", "target")
