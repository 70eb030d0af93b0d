"""A global row number without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.plans.lineage import materialize


def number_rows(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with its rows numbered from 0 in the given order.

    Rows are range-partitioned and sorted once, written with their partition and
    their place in it, and each partition's start is the sum of the sizes before.
    Only these sums, one a partition, pass through the driver.
    """
    ordered = df.sort(*order).withColumn("_seq", F.monotonically_increasing_id())
    kept = materialize(ordered, "ordered").withColumn("_part", F.shiftright("_seq", 33))
    sizes = sorted((r[0], r[1]) for r in kept.groupBy("_part").agg(F.count(F.lit(1))).collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    # one row a partition of the sort
    numbered = kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.select(*df.columns, name)
