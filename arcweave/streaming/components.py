"""Component labels that follow a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcweave.operators.components import component_labels


def labels(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame | None:
    """The labels after a batch, or after the newest one that was written; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = [s.getPath() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("batch=")]
    done = {int(p.getName()[6:]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    done = {b for b in done if batch is None or b <= batch}
    return spark.read.parquet(f"{path}/batch={max(done)}") if done else None


def follow_components(edges: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keeps (id, component) of all edges so far in ``path``, a folder for each micro-batch.

    A batch joins the last labels, as a star for each component, with its own
    edges, so its cost follows the vertices and the new edges, not all edges.
    A batch that is run again writes the same folder from the same input.
    """

    def merge(new: DataFrame, batch: int) -> None:
        pairs = new.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        before = labels(new.sparkSession, path, batch - 1)
        if before is not None:
            pairs = pairs.union(before.select(F.col("id"), F.col("component")))
        component_labels(pairs).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return edges.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
