"""Edge-list files. All readers return src, dst, weight and ord (input order within the scan)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ID = 2**32


def _numbered(rows: DataFrame, columns: list[Column], where: Column) -> DataFrame:
    return rows.withColumn("ord", F.monotonically_increasing_id()).where(where).select(*columns, "ord")


def read_edges(spark: SparkSession, path: str, sep: str | None = None, comment: str = "#", default_weight: float = 0.0, on_error: str = "fail") -> DataFrame:
    """Lines of ``src dst [weight]``; further fields are ignored, ``.gz`` files are decompressed by suffix.

    Fields are split at runs of white space, or at ``sep``. Lines that begin
    with ``comment`` and blank lines are skipped; an indented comment is not a
    comment. A missing weight is ``default_weight``. Ids are 0 to 2^32 - 1. A line
    that can't be read is an error, or skipped with ``on_error="skip"``.
    """
    value = F.col("value")
    parts = F.split(F.trim(value), sep) if sep else F.regexp_extract_all(value, F.lit(r"(\S+)"), F.lit(1))
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    lines = lines.where(~value.startswith(comment) & value.rlike(r"\S")).select(parts.alias("p"), "value", "ord")
    src, dst = (F.get("p", F.lit(k)).try_cast("long") for k in (0, 1))
    weight = F.when(F.size("p") > 2, F.get("p", F.lit(2)).try_cast("double")).otherwise(F.lit(default_weight))
    rows = lines.select(src.alias("src"), dst.alias("dst"), weight.alias("weight"), "ord", "value")
    good = F.coalesce(F.col("src").between(0, MOST_ID - 1) & F.col("dst").between(0, MOST_ID - 1) & F.col("weight").isNotNull(), F.lit(False))
    if on_error == "skip":
        rows = rows.where(good)
    else:
        rows = rows.withColumn("src", F.when(good, F.col("src")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("long")))
    return rows.select("src", "dst", "weight", "ord")


def read_unweighted(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """As :func:`read_edges`, for graphs without weights: a third field is dropped."""
    return read_edges(spark, path, **options).withColumn("weight", F.lit(0.0))


def read_tab_weighted(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated src, dst, weight."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="src long, dst long, weight double", mode="FAILFAST")
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """Shortest-path challenge files: lines ``a src dst weight``; all others are dropped."""
    parts = F.split("value", " ")
    return _numbered(spark.read.text(path), [F.get(parts, F.lit(1)).cast("long").alias("src"), F.get(parts, F.lit(2)).cast("long").alias("dst"), F.get(parts, F.lit(3)).cast("double").alias("weight")], F.col("value").startswith("a"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated files whose first three fields are source, target and rating."""
    parts = F.split("value", ",")
    return _numbered(spark.read.text(path), [F.get(parts, F.lit(k)).cast(t).alias(n) for k, (n, t) in enumerate((("src", "long"), ("dst", "long"), ("weight", "double")))], F.col("value").rlike(r"\S"))


#: Readers by the name of a format; a dataset's converter is an entry here.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"edges": read_edges, "unweighted": read_unweighted, "tab": read_tab_weighted, "dimacs": read_dimacs, "ratings": read_ratings}


def read(spark: SparkSession, path: str, kind: str = "edges") -> DataFrame:
    return READERS[kind](spark, path)


def write_edges(edges: DataFrame, path: str, compression: str = "gzip") -> None:
    """Tab-separated text that :func:`read_edges` reads back."""
    rows = edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("value"))
    rows.write.option("compression", compression).text(path)
